"""Scores, assignments and the joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import patterns as P
from casefile.operators import changes, matching, similarity
from casefile.plans.catalog import query
from casefile.plans.citation_queries import CANDIDATE_STEPS, candidate_rows
from casefile.plans.sql import with_views
from casefile.plans.text_queries import sql_tokens
from casefile.session import stored
from casefile.sources import views

KEYS = ["matter_id"]

SCORE_STEPS = [
    *CANDIDATE_STEPS,
    ("ctok", f"SELECT *, list_sort({sql_tokens('concat_ws(' + chr(39) + ' ' + chr(39) + ', description, citation, date_text)')}) AS w FROM cand"),
    ("stok", (
        f"SELECT *, list_sort({sql_tokens('concat_ws(' + chr(39) + ' ' + chr(39) + ', name, text)')}) AS w, lower(text) AS low, "
        rf"regexp_extract(lower(text), '\d{{1,2}} (?:{P.MONTHS.lower()}) \d{{4}}') AS d FROM v_sources WHERE coalesce(marker <> 'N/A', true)")),
    ("cw", "SELECT matter_id, provisional_number, unnest(w) AS t FROM ctok"),
    ("sw", "SELECT matter_id, source_seq, unnest(w) AS t FROM stok"),
    ("shared", "SELECT matter_id, provisional_number, source_seq, count(*) AS c FROM cw JOIN sw USING (matter_id, t) GROUP BY ALL"),
    ("scores", (
        "SELECT c.matter_id, c.provisional_number, s.source_seq, CAST(least(88, floor(CASE WHEN len(c.w) = 0 THEN 0 ELSE coalesce(h.c, 0)::DOUBLE / len(c.w) * 65 END "
        "+ CASE WHEN c.date_text <> 'Date not stated' AND contains(s.low, lower(c.date_text)) THEN 23 ELSE 0 END + 0.5)) AS INT) AS score "
        "FROM ctok c JOIN stok s USING (matter_id) LEFT JOIN shared h USING (matter_id, provisional_number, source_seq)")),
]
_VIEWS = ["v_statement", "v_sources"]


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as a stored table, with what is matched: read several times."""
    return stored(views.sources(spark, folder).select("matter_id", "source_seq", "name", "text", "marker"))


@query(
    sql=with_views(
        _VIEWS, *SCORE_STEPS,
        ("fc", "SELECT matter_id, min(provisional_number) AS provisional_number, count(*) AS candidates FROM ctok GROUP BY matter_id, w, date_text"),
        ("fs", "SELECT matter_id, min(source_seq) AS source_seq, count(*) AS sources FROM stok GROUP BY matter_id, w, d"),
        select=(
            "SELECT matter_id, provisional_number AS first_candidate, source_seq AS first_source, candidates, sources, score FROM scores "
            "JOIN fc USING (matter_id, provisional_number) JOIN fs USING (matter_id, source_seq) WHERE score >= 1"
        ),
    )
)
def score_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = matching.score_pairs(candidate_rows(spark, folder), views.sources(spark, folder), KEYS)
    return pairs.select("matter_id", "first_candidate", "first_source", "candidates", "sources", "score")


@query(
    sql=with_views(
        _VIEWS, *CANDIDATE_STEPS,
        ("one", "SELECT matter_id, marker, min(source_seq) AS source_seq FROM v_sources WHERE marker IS NOT NULL GROUP BY ALL HAVING count(*) = 1"),
        select="SELECT c.matter_id, provisional_number, source_seq, 99 AS confidence FROM cand c JOIN one o ON o.matter_id = c.matter_id AND o.marker = replace(c.mark, ' ', '') WHERE resolution = 'none' AND citation_count <= 1",
    )
)
def match_explicit(spark: SparkSession, folder: str) -> DataFrame:
    # each is read once, and only a few of its columns: not stored
    return matching.match_explicit(candidate_rows(spark, folder), views.sources(spark, folder), KEYS)


@query(
    sql=with_views(
        _VIEWS, *SCORE_STEPS,
        select=(
            "SELECT matter_id, provisional_number, CAST(r AS INT) AS rank, source_seq, score FROM (SELECT *, row_number() OVER (PARTITION BY matter_id, provisional_number ORDER BY score DESC, source_seq) AS r FROM scores) x WHERE r <= 4"
        ),
    )
)
def top_k_sources(spark: SparkSession, folder: str) -> DataFrame:
    return matching.top_sources(candidate_rows(spark, folder), views.sources(spark, folder), KEYS)


@query(
    sql=with_views(
        _VIEWS, *SCORE_STEPS,
        ("edge", "SELECT matter_id, provisional_number, list({'s': source_seq, 'p': score} ORDER BY score DESC, source_seq) AS es FROM scores WHERE score >= 38 GROUP BY ALL"),
        ("expl", "SELECT c.matter_id, provisional_number, list(source_seq) AS xs FROM cand c JOIN v_sources s ON s.matter_id = c.matter_id AND s.marker = replace(c.mark, ' ', '') WHERE resolution = 'none' GROUP BY ALL"),
        ("best", "SELECT matter_id, provisional_number, max(score) AS best FROM scores GROUP BY ALL"),
        ("todo", (
            "SELECT matter_id, provisional_number AS n, citation_count AS k, coalesce(es, []) AS es, coalesce(xs, []) AS xs, coalesce(best, 0) AS best FROM cand "
            "LEFT JOIN edge USING (matter_id, provisional_number) LEFT JOIN expl USING (matter_id, provisional_number) LEFT JOIN best USING (matter_id, provisional_number)")),
        ("walk", (
            "SELECT matter_id, 0::BIGINT AS n, []::BIGINT[] AS claimed, NULL::BIGINT AS source_seq, 0 AS confidence, 'start' AS decision FROM (SELECT DISTINCT matter_id FROM cand) m UNION ALL "
            "SELECT matter_id, n, CASE WHEN src IS NULL THEN claimed ELSE list_append(claimed, src) END, src, conf, decision FROM ("
            "SELECT matter_id, n, claimed, CASE WHEN k > 1 THEN NULL WHEN len(fx) = 1 THEN fx[1] WHEN len(fe) > 0 AND fe[1].p >= 45 AND NOT (len(fe) > 1 AND fe[1].p - fe[2].p < 8) THEN fe[1].s END AS src, "
            "CASE WHEN k > 1 THEN best WHEN len(fx) = 1 THEN 99 WHEN len(fe) > 0 AND fe[1].p >= 45 THEN fe[1].p ELSE 0 END AS conf, "
            "CASE WHEN k > 1 THEN 'reviewer chooses' WHEN len(fx) = 1 THEN 'explicit' WHEN len(fe) > 0 AND fe[1].p >= 45 THEN CASE WHEN len(fe) > 1 AND fe[1].p - fe[2].p < 8 THEN 'ambiguous' ELSE 'matched' END ELSE 'none' END AS decision FROM ("
            "SELECT t.matter_id, t.n, w.claimed, t.k, t.best, list_filter(t.xs, lambda x: NOT list_contains(w.claimed, x)) AS fx, list_filter(t.es, lambda e: NOT list_contains(w.claimed, e.s)) AS fe "
            "FROM walk w JOIN todo t ON t.matter_id = w.matter_id AND t.n = w.n + 1) a) b")),
        select="SELECT matter_id, n AS provisional_number, source_seq, confidence, decision FROM walk WHERE n > 0",
        recursive=True,
    )
)
def greedy_assign(spark: SparkSession, folder: str) -> DataFrame:
    return matching.greedy_assign(candidate_rows(spark, folder), _sources(spark, folder), KEYS)


_CLAIMS = "SELECT DISTINCT matter_id, evidence_id AS source_id FROM v_candidates WHERE included AND evidence_id IS NOT NULL"


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.candidates(spark, folder).filter("evidence_id is not null")
    return rows.select("matter_id", F.col("evidence_id").alias("source_id"), "included")


@query(
    sql=with_views(
        ["v_sources", "v_candidates"], ("claims", _CLAIMS),
        select="SELECT matter_id, source_id, name FROM v_sources ANTI JOIN claims USING (matter_id, source_id)",
    )
)
def unreferenced(spark: SparkSession, folder: str) -> DataFrame:
    claims = _claims(spark, folder).filter("included")
    rows = matching.unreferenced(views.sources(spark, folder), claims, ["matter_id", "source_id"])
    return rows.select("matter_id", "source_id", "name")


@query(
    sql=with_views(
        ["v_sources", "v_candidates"], ("claims", _CLAIMS),
        select="SELECT matter_id, source_id, name, sha256 FROM v_sources SEMI JOIN claims USING (matter_id, source_id)",
    )
)
def selected_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = matching.selected_sources(views.sources(spark, folder), _claims(spark, folder), ["matter_id", "source_id"])
    return rows.select("matter_id", "source_id", "name", "sha256")


@query(
    sql=with_views(
        ["v_sources", "v_candidates"], ("claims", _CLAIMS),
        ("chosen", "SELECT DISTINCT matter_id, sha256 FROM v_sources SEMI JOIN claims USING (matter_id, source_id)"),
        select="SELECT matter_id, source_id, sha256 FROM v_sources ANTI JOIN claims USING (matter_id, source_id) SEMI JOIN chosen USING (matter_id, sha256)",
    )
)
def duplicate_copies(spark: SparkSession, folder: str) -> DataFrame:
    selected = _claims(spark, folder).filter("included")
    rows = similarity.unselected_copies(views.sources(spark, folder), selected, KEYS, "source_id")
    return rows.select("matter_id", "source_id", "sha256")


def checks_table(spark: SparkSession, folder: str) -> DataFrame:
    """One text-recognition or encryption check per order."""
    key = F.col("o_orderkey")
    orders = views.table(spark, folder, "orders")
    return orders.select(
        F.col("o_custkey").alias("matter_id"),
        F.concat(F.when(key % 3 == 0, "ocr-").otherwise("encrypted-"), key.cast("string")).alias("check_id"),
        F.when(key % 6 == 0, "ocr.failed").when(key % 3 == 0, "ocr.unavailable").otherwise("source.encrypted").alias("code"),
        F.when(key % 6 == 0, "OCR failed").when(key % 3 == 0, "OCR unavailable").otherwise("Encrypted PDF").alias("label"),
        F.when(key % 3 == 0, "exception-eligible").otherwise("hard-technical").alias("policy"),
        F.lit("blocking").alias("severity"),
        F.lit("Needs attention.").alias("detail"),
        F.concat(F.lit("h"), (key % 7).cast("string")).alias("source_sha256"),
        F.concat(F.lit("e"), (key % 9).cast("string")).alias("source_id"),
        F.concat(F.lit("c"), key.cast("string")).alias("candidate_id"),
    )


CHECKS_SQL = (
    "SELECT o_custkey AS matter_id, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'ocr-' ELSE 'encrypted-' END, o_orderkey) AS check_id, "
    "CASE WHEN o_orderkey % 6 = 0 THEN 'ocr.failed' WHEN o_orderkey % 3 = 0 THEN 'ocr.unavailable' ELSE 'source.encrypted' END AS code, "
    "CASE WHEN o_orderkey % 6 = 0 THEN 'OCR failed' WHEN o_orderkey % 3 = 0 THEN 'OCR unavailable' ELSE 'Encrypted PDF' END AS label, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'exception-eligible' ELSE 'hard-technical' END AS policy, 'blocking' AS severity, 'Needs attention.' AS detail, "
    "concat('h', o_orderkey % 7) AS source_sha256, concat('e', o_orderkey % 9) AS source_id, concat('c', o_orderkey) AS candidate_id FROM orders"
)


def resolutions_table(spark: SparkSession, folder: str) -> DataFrame:
    """One reviewer resolution per order of a third kind of key."""
    key = F.col("o_orderkey")
    action = (
        F.when(key % 5 == 0, "proceed-without-ocr").when(key % 5 == 1, "exclude-source").when(key % 5 == 2, "exclude-candidate")
        .otherwise("use-built-in-template")
    )
    return views.table(spark, folder, "orders").filter(key % 2 == 0).select(
        F.col("o_custkey").alias("matter_id"),
        key.alias("position"),
        F.concat(F.when(key % 3 == 0, "ocr-").otherwise("encrypted-"), key.cast("string")).alias("blocker_id"),
        F.when(key % 4 == 0, F.when(key % 6 == 0, "ocr.failed").otherwise("ocr.unavailable")).alias("check_code"),
        action.alias("action"),
        F.concat(F.lit("e"), (key % 9).cast("string")).alias("source_id"),
        F.when(key % 10 != 4, F.concat(F.lit("h"), (key % 7).cast("string"))).alias("source_sha256"),
        F.when(key % 5 == 2, F.concat(F.lit("c"), key.cast("string"))).alias("candidate_id"),
        (key % 15 != 0).alias("visual_review_confirmed"),
        F.when(key % 8 == 0, F.concat(F.lit("note "), key.cast("string"))).alias("note"),
        F.col("o_orderdate").cast("date").cast("string").alias("approved_at"),
    )


RESOLUTIONS_SQL = (
    "SELECT o_custkey AS matter_id, o_orderkey AS position, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'ocr-' ELSE 'encrypted-' END, o_orderkey) AS blocker_id, "
    "CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'ocr.failed' ELSE 'ocr.unavailable' END END AS check_code, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'proceed-without-ocr' WHEN 1 THEN 'exclude-source' WHEN 2 THEN 'exclude-candidate' ELSE 'use-built-in-template' END AS action, "
    "concat('e', o_orderkey % 9) AS source_id, CASE WHEN o_orderkey % 10 <> 4 THEN concat('h', o_orderkey % 7) END AS source_sha256, "
    "CASE WHEN o_orderkey % 5 = 2 THEN concat('c', o_orderkey) END AS candidate_id, o_orderkey % 15 <> 0 AS visual_review_confirmed, "
    "CASE WHEN o_orderkey % 8 = 0 THEN concat('note ', o_orderkey) END AS note, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS approved_at FROM orders WHERE o_orderkey % 2 = 0"
)

MATCH_STEPS = [
    ("checks", CHECKS_SQL),
    ("resolutions", RESOLUTIONS_SQL),
    ("pairs", (
        "SELECT c.matter_id, c.check_id, r.position, r.action, r.visual_review_confirmed AS v, "
        "coalesce(r.action = 'proceed-without-ocr' AND r.check_code LIKE 'ocr.%' AND c.code LIKE 'ocr.%', false) AS wide, r.blocker_id = c.check_id AS same_id, r.check_code, r.source_sha256 AS bound, c.code, c.source_sha256 AS h "
        "FROM checks c JOIN resolutions r USING (matter_id)")),
    ("first_hit", (
        "SELECT matter_id, check_id, min(position) AS position, arg_min(action, position) AS action, arg_min(v, position) AS v FROM pairs "
        "WHERE (same_id OR wide) AND (NOT wide OR bound = h) AND (check_code IS NULL OR check_code = code) AND (bound IS NULL OR bound = h) GROUP BY ALL")),
]


@query(
    sql=with_views(
        [], *MATCH_STEPS,
        select="SELECT matter_id, check_id, position, action, coalesce(v, false) AS visual_review_confirmed FROM checks LEFT JOIN first_hit USING (matter_id, check_id)",
    )
)
def match_resolutions(spark: SparkSession, folder: str) -> DataFrame:
    rows = matching.match_resolutions(checks_table(spark, folder), resolutions_table(spark, folder), KEYS)
    return rows.select("matter_id", "check_id", "position", "action", "visual_review_confirmed")


@query(
    sql=with_views(
        [],
        ("res", RESOLUTIONS_SQL),
        ("now", "SELECT o_custkey AS matter_id, concat('e', o_orderkey % 9) AS source_id, max(concat('h', o_orderkey % 7)) AS sha256 FROM orders GROUP BY ALL"),
        ("cand", "SELECT DISTINCT o_custkey AS matter_id, concat('c', o_orderkey) AS candidate_id FROM orders WHERE o_orderkey % 3 = 0"),
        select=(
            "SELECT r.matter_id, r.position, r.action, r.source_id, r.source_sha256, r.candidate_id FROM res r LEFT JOIN now n ON n.matter_id = r.matter_id AND n.source_id = r.source_id LEFT JOIN cand c ON c.matter_id = r.matter_id AND c.candidate_id = r.candidate_id "
            "WHERE (r.source_sha256 IS NULL OR n.sha256 = r.source_sha256) AND (r.candidate_id IS NULL OR c.candidate_id IS NOT NULL)"
        ),
    )
)
def valid_resolutions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = views.table(spark, folder, "orders").withColumn("matter_id", F.col("o_custkey"))
    source, content = F.concat(F.lit("e"), (key % 9).cast("string")), F.concat(F.lit("h"), (key % 7).cast("string"))
    hashes = orders.groupBy("matter_id", source.alias("source_id")).agg(F.max(content).alias("sha256"))
    verified = orders.filter(key % 3 == 0).select("matter_id", F.concat(F.lit("c"), key.cast("string")).alias("candidate_id"))
    rows = changes.valid_resolutions(resolutions_table(spark, folder), hashes, verified, KEYS)
    return rows.select("matter_id", "position", "action", "source_id", "source_sha256", "candidate_id")
