"""The decision journal and the audit rows of a build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import text as T
from casefile.operators import report
from casefile.plans import matching_queries as M
from casefile.plans import planning_queries as PL
from casefile.plans.catalog import query
from casefile.plans.sql import with_views
from casefile.session import cut_lineage, stored
from casefile.sources import views
from casefile.streaming import journal

KEYS = ["matter_id"]


def _journal(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.journal(spark, folder)
    return rows.withColumn("action", F.when(F.col("action") == "error", journal.CLEAN).otherwise("write"))


STATE_STEPS = [
    ("e", "SELECT journal_id, arrival, revision, CASE WHEN action = 'error' THEN 'clean' ELSE 'write' END AS action, row_number() OVER (PARTITION BY journal_id ORDER BY arrival) AS n FROM v_journal"),
    ("walk", (
        "SELECT DISTINCT journal_id, 0::BIGINT AS n, NULL::BIGINT AS arrival, NULL::VARCHAR AS action, NULL::BIGINT AS revision, false AS accepted, NULL::BIGINT AS cur, false AS dirty FROM e UNION ALL "
        "SELECT journal_id, n, arrival, action, revision, ok, CASE WHEN ok THEN CASE WHEN action = 'clean' THEN revision + 1 ELSE revision END ELSE cur END, CASE WHEN ok THEN action <> 'clean' ELSE dirty END FROM ("
        "SELECT e.*, w.cur, w.dirty, e.revision >= 1 AND CASE WHEN e.action = 'clean' THEN w.cur IS NOT NULL AND e.revision >= w.cur ELSE w.cur IS NULL OR e.revision > w.cur END AS ok FROM walk w JOIN e ON e.journal_id = w.journal_id AND e.n = w.n + 1) q")),
]


@query(
    sql=with_views(["v_journal"], *STATE_STEPS, select="SELECT journal_id, arrival, action, revision, accepted, cur AS current_revision FROM walk WHERE n > 0", recursive=True)
)
def journal_states(spark: SparkSession, folder: str) -> DataFrame:
    return journal.journal_states(_journal(spark, folder), ["journal_id"])


@query(
    sql=with_views(
        ["v_journal"], *STATE_STEPS,
        select="SELECT journal_id, arg_max(cur, arrival) AS revision, arg_max(action, arrival) <> 'clean' AS dirty, max(arrival) AS last_arrival FROM walk WHERE accepted GROUP BY 1",
        recursive=True,
    )
)
def journal_latest(spark: SparkSession, folder: str) -> DataFrame:
    return journal.journal_latest(_journal(spark, folder), ["journal_id"])


def _review_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each user is a matter of twelve candidates; each event edits one of them."""
    events = views.table(spark, folder, "events").select("event_id", "user_id", "value")
    matters = events.select(F.col("user_id").alias("matter_id")).distinct()
    k = F.col("k")
    baseline = matters.select("matter_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select(
        "matter_id", F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), F.concat(F.lit("e"), (k % 8).cast("string")).alias("evidence_id"),
        F.concat(F.lit("h"), (k % 4).cast("string")).alias("source_sha256"), F.lit("pending").alias("repeat_decision"), (k % 2 == 0).alias("confirmed"),
    )
    e, tenth = F.col("event_id"), F.floor(F.col("value") * 100).cast("long")
    kind = e % 7
    action = F.when(kind.isin(0, 1), "source").when(kind.isin(2, 3, 4), "confirm").when(kind == 5, "pages").otherwise("repeat")
    changes = events.select(
        F.col("user_id").alias("matter_id"), F.concat(F.lit("c"), (tenth % 12).cast("string")).alias("candidate_id"), (e + 1).alias("at"), action.alias("action"),
        F.concat(F.lit("e"), (tenth % 5).cast("string")).alias("new_evidence"), F.concat(F.lit("h"), (tenth % 5 % 4).cast("string")).alias("new_sha256"),
        F.when(tenth % 3 == 0, "same").otherwise("pending").alias("new_decision"),
    )
    return baseline, changes


@query(
    sql=with_views(
        [],
        ("ev", "SELECT user_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CAST(floor(value * 100) AS BIGINT) AS t, event_id % 7 AS kind FROM events"),
        ("walk", (
            "SELECT m, 0::BIGINT AS n, list({'k': k, 'e': concat('e', k % 8), 'h': concat('h', k % 4), 'd': 'pending', 'c': k % 2 = 0} ORDER BY k) AS s FROM (SELECT DISTINCT m FROM ev) x, (SELECT unnest(range(0, 12)) AS k) y GROUP BY m UNION ALL "
            "SELECT q.m, q.n, CASE WHEN kind IN (0, 1) AND old.e <> concat('e', t % 5) THEN list_transform(s, lambda r: {'k': r.k, 'e': CASE WHEN r.k = t % 12 THEN concat('e', t % 5) ELSE r.e END, 'h': CASE WHEN r.k = t % 12 THEN concat('h', t % 5 % 4) ELSE r.h END, 'd': r.d, 'c': CASE WHEN r.k = t % 12 OR r.h = old.h OR r.h = concat('h', t % 5 % 4) THEN false ELSE r.c END}) "
            "WHEN kind IN (0, 1, 5) THEN list_transform(s, lambda r: {'k': r.k, 'e': r.e, 'h': CASE WHEN r.k = t % 12 AND kind < 2 THEN concat('h', t % 5 % 4) ELSE r.h END, 'd': r.d, 'c': CASE WHEN r.k = t % 12 THEN false ELSE r.c END}) "
            "WHEN kind IN (2, 3, 4) THEN list_transform(s, lambda r: {'k': r.k, 'e': r.e, 'h': r.h, 'd': r.d, 'c': CASE WHEN r.k = t % 12 THEN true ELSE r.c END}) "
            "ELSE list_transform(s, lambda r: {'k': r.k, 'e': r.e, 'h': r.h, 'd': CASE WHEN r.k = t % 12 THEN CASE WHEN t % 3 = 0 THEN 'same' ELSE 'pending' END ELSE r.d END, 'c': CASE WHEN r.k = t % 12 AND r.d <> CASE WHEN t % 3 = 0 THEN 'same' ELSE 'pending' END THEN false ELSE r.c END}) END "
            "FROM (SELECT w.m, e.n, w.s, e.t, e.kind, w.s[e.t % 12 + 1] AS old FROM walk w JOIN ev e ON e.m = w.m AND e.n = w.n + 1) q")),
        ("fin", "SELECT m, unnest(arg_max(s, n)) AS r FROM walk GROUP BY m"),
        select="SELECT m AS matter_id, concat('c', r.k) AS candidate_id, r.e AS evidence_id, r.h AS source_sha256, r.d AS repeat_decision, r.c AS confirmed FROM fin",
        recursive=True,
    )
)
def review_changes(spark: SparkSession, folder: str) -> DataFrame:
    baseline, changes = _review_inputs(spark, folder)
    return journal.review_changes(cut_lineage(baseline), cut_lineage(changes), KEYS)


_PAYLOAD = (
    "concat('{\"sources\":[', CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{\"id\":\"a\"},{\"id\":\"a\"}' ELSE '{\"id\":\"a\"}' END, '],\"candidates\":[]', CASE WHEN event_id % 7 = 0 THEN ',\"arrangement\":{\"version\":1}' ELSE '' END, "
    "CASE WHEN event_id % 3 = 0 THEN ',\"finalOrder\":[\"x\",\"x\"]' WHEN event_id % 3 = 1 THEN ',\"finalOrder\":[\"x\"]' ELSE '' END, CASE WHEN event_id % 11 = 0 THEN ',\"extra\":1' ELSE '' END, CASE WHEN event_id % 13 = 0 THEN ',\"pageSizeChoices\":{\"a\":\"other\"}' ELSE '' END, '}')"
)


@query(
    sql=(
        "SELECT event_id, unnest(list_filter([CASE WHEN event_id % 11 = 0 THEN 'unsupported field' END, CASE WHEN event_id % 5 = 0 THEN 'invalid number of sources' END, CASE WHEN event_id % 5 = 1 THEN 'duplicate source ids' END, "
        "CASE WHEN event_id % 7 = 0 AND event_id % 3 <> 2 THEN 'arrangement and legacy order' END, CASE WHEN event_id % 3 = 0 THEN 'invalid or duplicate order ids' END, CASE WHEN event_id % 13 = 0 THEN 'invalid page-size choice' END], lambda x: x IS NOT NULL)) AS issue FROM events"
    )
)
def journal_issues(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "events").select("event_id", F.expr(_PAYLOAD).alias("payload"))
    return journal.validate_journal(rows, ["event_id"])


@query(
    sql=with_views(
        ["v_candidates"],
        select="SELECT matter_id, candidate_id, CASE WHEN s >= 90 THEN 'High' WHEN s >= 65 THEN 'Medium' ELSE 'Review' END AS band, CASE WHEN manual_addition THEN 'Selected by you' WHEN s >= 90 THEN 'Strong suggested match' WHEN s >= 65 THEN 'Possible suggested match' ELSE 'Needs review' END AS strength FROM (SELECT *, seq * 17 % 101 AS s FROM v_candidates) x",
    )
)
def confidence_bands(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("seq") * 17 % 101
    return views.candidates(spark, folder).select(
        "matter_id", "candidate_id", T.confidence_band(score).alias("band"), T.match_strength(score, F.col("manual_addition")).alias("strength")
    )


def _excluded(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    sources = stored(views.sources(spark, folder).select("matter_id", "source_id", "source_seq", "name", F.concat(F.lit("h"), (F.col("source_seq") % 7).cast("string")).alias("sha256")))
    return report.exclusion_reasons(sources, rows, M.resolutions_table(spark, folder), KEYS)


REASON_STEPS = [
    ("res", M.RESOLUTIONS_SQL),
    ("src", "SELECT matter_id, source_id, source_seq, name, concat('h', source_seq % 7) AS sha256 FROM v_sources"),
    ("chosen", "SELECT DISTINCT matter_id, evidence_id AS source_id FROM v_candidates WHERE included AND evidence_id IS NOT NULL"),
    ("cop", "SELECT DISTINCT matter_id, sha256 FROM src SEMI JOIN chosen USING (matter_id, source_id)"),
    ("own", "SELECT matter_id, source_id, source_sha256 AS sha256, arg_min(coalesce(note, ''), position) AS n FROM res WHERE action = 'exclude-source' AND source_sha256 IS NOT NULL GROUP BY ALL"),
    ("byc", "SELECT matter_id, candidate_id, arg_min(coalesce(note, ''), position) AS n, min(position) AS p, arg_min(approved_at, position) AS a FROM res WHERE action = 'exclude-candidate' GROUP BY ALL"),
    ("ofc", "SELECT matter_id, evidence_id AS source_id, arg_min(n, seq) AS n FROM v_candidates JOIN byc USING (matter_id, candidate_id) WHERE evidence_id IS NOT NULL GROUP BY ALL"),
    ("reasons", (
        "SELECT s.matter_id, s.source_id, s.source_seq, s.name, s.sha256, coalesce(nullif(o.n, ''), nullif(f.n, ''), CASE WHEN c.sha256 IS NOT NULL THEN 'Unselected duplicate physical copy of a selected source' ELSE 'No confirmed citation match' END) AS reason "
        "FROM src s ANTI JOIN chosen USING (matter_id, source_id) LEFT JOIN own o ON o.matter_id = s.matter_id AND o.source_id = s.source_id AND o.sha256 = s.sha256 LEFT JOIN ofc f ON f.matter_id = s.matter_id AND f.source_id = s.source_id LEFT JOIN cop c ON c.matter_id = s.matter_id AND c.sha256 = s.sha256")),
    ("bys", "SELECT matter_id, source_id, source_sha256, arg_min(coalesce(note, ''), position) AS n, min(position) AS p, arg_min(approved_at, position) AS a FROM res WHERE action = 'exclude-source' AND source_sha256 IS NOT NULL GROUP BY ALL"),
    ("omit", (
        "SELECT v.matter_id, v.candidate_id, v.paragraph, v.description, CASE WHEN s.p IS NULL OR c.p < s.p THEN coalesce(nullif(c.n, ''), 'Reviewer excluded this cited item from the exhibit bundle.') ELSE coalesce(nullif(s.n, ''), 'Reviewer excluded this source from the exhibit bundle.') END AS reason, "
        "CASE WHEN s.p IS NULL OR c.p < s.p THEN 'exclude-candidate' ELSE 'exclude-source' END AS decision_action, CASE WHEN s.p IS NULL OR c.p < s.p THEN c.a ELSE s.a END AS decided_at "
        "FROM v_candidates v LEFT JOIN byc c USING (matter_id, candidate_id) LEFT JOIN bys s ON s.matter_id = v.matter_id AND s.source_id = v.evidence_id AND s.source_sha256 = v.source_sha256 WHERE NOT manual_addition AND (c.p IS NOT NULL OR s.p IS NOT NULL)")),
]


@query(sql=with_views(["v_sources", "v_candidates"], *REASON_STEPS, select="SELECT matter_id, source_id, name, sha256, reason FROM reasons"))
def exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _excluded(spark, folder, PL.candidates(spark, folder)).drop("source_seq")


@query(sql=with_views(["v_sources", "v_candidates"], *REASON_STEPS, select="SELECT * FROM omit"))
def omitted_citations(spark: SparkSession, folder: str) -> DataFrame:
    return report.omitted_citations(PL.candidates(spark, folder), M.resolutions_table(spark, folder), KEYS)


def _exhibits(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    rows = plan.withColumnRenamed("item_id", "candidate_id").drop("mark").join(candidates, ["matter_id", "candidate_id"])

    def span(a: str, b: str) -> Column:
        return F.concat(F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))

    return rows.select(
        "matter_id", F.col("position").alias("number"), "description", F.concat(F.col("candidate_id"), F.lit(".pdf")).alias("source_file"),
        F.coalesce("source_sha256", F.lit("none")).alias("source_sha256"), "date_text", "volume", span("physical_start", "physical_end").alias("physical_pages"),
        span("legal_start", "legal_end").alias("reference_pages"), "manual_addition",
        F.when(~F.col("manual_addition"), F.concat(F.lit("paragraph "), F.col("paragraph").cast("string"))).otherwise("").alias("references"),
    )


EXHIBITS = ("ex", (
    "SELECT p.matter_id, p.position AS number, c.description, concat(c.candidate_id, '.pdf') AS source_file, coalesce(c.source_sha256, 'none') AS source_sha256, c.date_text, p.volume, concat(CAST(physical_start AS BIGINT), '-', CAST(physical_end AS BIGINT)) AS physical_pages, "
    "concat(CAST(legal_start AS BIGINT), '-', CAST(legal_end AS BIGINT)) AS reference_pages, c.manual_addition, CASE WHEN NOT c.manual_addition THEN concat('paragraph ', c.paragraph) ELSE '' END AS refs FROM plan p JOIN v_candidates c ON c.matter_id = p.matter_id AND c.candidate_id = p.item_id"))
_REPORT_LINES = [
    "concat('- Exhibit ', number, ': ', description)", "concat('  Source: ', source_file)", "concat('  Source SHA-256: ', source_sha256)", "concat('  Document date: ', date_text)", "concat('  Volume: ', volume)",
    "concat('  Printed PDF pages: ', physical_pages)", "concat('  Statement reference pages: ', reference_pages)", "concat('  Citation status: ', CASE WHEN manual_addition THEN 'not-cited-manual-addition' ELSE 'cited' END)",
    "CASE WHEN manual_addition THEN '  Provenance: Added by reviewer; not cited in the statement' END", "CASE WHEN refs <> '' THEN concat('  Statement references: ', refs) END",
]


def _sql_section(source: str, section: int, lines: list[str], order: str) -> str:
    return " UNION ALL ".join(f"SELECT matter_id, {section} AS section, {order} AS row_order, {i} AS line_no, {line} AS line FROM {source}" for i, line in enumerate(lines))


@query(
    sql=with_views(
        ["v_sources", "v_candidates"], *PL.COUNTED_STEPS, EXHIBITS, *REASON_STEPS, ("ck", f"{M.CHECKS_SQL}"),
        ("outp", "SELECT c_custkey AS matter_id, c_name AS project FROM customer"),
        ("lines", " UNION ALL ".join([
            _sql_section("outp", 1, ["'Readable build report'", "concat('Project: ', project)", "'Output file: Bundle.pdf'", "'Output SHA-256: —'", "'Output pages: 10'", "''", "'Exhibits'"], "0"),
            _sql_section("ex", 2, _REPORT_LINES, "number"),
            _sql_section("(SELECT DISTINCT matter_id FROM ex WHERE manual_addition) q", 3, ["''", "'Added exhibits (not cited in the statement)'"], "-1"),
            _sql_section("(SELECT * FROM ex WHERE manual_addition) q", 3, ["concat('- ', description, ' (', source_file, '); SHA-256 ', source_sha256)"], "number"),
            _sql_section("(SELECT DISTINCT matter_id FROM omit) q", 4, ["''", "'Omitted citations'"], "-1"),
            _sql_section("omit", 4, ["concat('- ', description, ' (paragraph ', paragraph, ')')"], "paragraph"),
            _sql_section("(SELECT DISTINCT matter_id FROM reasons) q", 5, ["''", "'Excluded files'"], "-1"),
            _sql_section("reasons", 5, ["concat('- ', name, '; SHA-256 ', sha256, '; ', reason)"], "source_seq"),
            _sql_section("(SELECT DISTINCT matter_id FROM ck) q", 6, ["''", "'Final preflight'"], "-1"),
            _sql_section("ck", 6, ["concat('- [', severity, '] ', label, ': ', detail)"], "0"),
        ])),
        select="SELECT matter_id, section, CASE WHEN section = 6 AND line_no = 0 AND line <> '' THEN 0 ELSE row_order END AS row_order, line_no, line FROM lines WHERE line IS NOT NULL",
        recursive=True,
    )
)
def build_report(spark: SparkSession, folder: str) -> DataFrame:
    outputs = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("matter_id"), F.col("c_name").alias("project"), F.lit("Bundle.pdf").alias("file_name"), F.lit("").alias("sha256"), F.lit(10).alias("page_count")
    )
    rows = PL.candidates(spark, folder)
    omitted = report.omitted_citations(rows, M.resolutions_table(spark, folder), KEYS)
    exhibits, excluded = stored(_exhibits(PL._planned(spark, folder, rows), rows)), stored(_excluded(spark, folder, rows))  # for three and two parts
    lines = report.build_report(outputs, exhibits, stored(omitted), excluded, M.checks_table(spark, folder), KEYS)
    # the order key of checks is a hash; it is left out of the comparison
    is_check = (F.col("section") == 6) & (F.col("line") != "") & (F.col("line_no") == 0)
    return lines.withColumn("row_order", F.when(is_check, 0).otherwise(F.col("row_order")))


MANIFEST = [
    ("vols", "SELECT DISTINCT matter_id, volume, CAST(total_pages AS BIGINT) AS total_pages FROM plan"),
    ("man", (
        "SELECT matter_id, 'exhibit' AS kind, concat('{\"number\":', number, ',\"description\":\"', description, '\",\"source_sha256\":\"', source_sha256, '\"}') AS entry FROM ex "
        "UNION ALL SELECT matter_id, 'excluded-file', concat('{\"name\":\"', name, '\",\"reason\":\"', reason, '\"}') FROM reasons "
        "UNION ALL SELECT matter_id, 'omitted-citation', concat('{\"candidate_id\":\"', candidate_id, '\",\"reason\":\"', reason, '\"}') FROM omit "
        "UNION ALL SELECT matter_id, 'volume', concat('{\"volume\":', volume, ',\"total_pages\":', total_pages, '}') FROM vols")),
]


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = PL.candidates(spark, folder)
    plan = PL._planned(spark, folder, rows)
    volumes = plan.select("matter_id", "volume", F.col("total_pages").cast("long").alias("total_pages")).distinct()
    omitted = report.omitted_citations(rows, M.resolutions_table(spark, folder), KEYS)
    return report.manifest_rows(
        _exhibits(plan, rows).select("matter_id", "number", "description", "source_sha256"), _excluded(spark, folder, rows).select("matter_id", "name", "reason"),
        omitted.select("matter_id", "candidate_id", "reason"), volumes, KEYS,
    )


@query(sql=with_views(["v_sources", "v_candidates"], *PL.COUNTED_STEPS, EXHIBITS, *REASON_STEPS, *MANIFEST, select="SELECT * FROM man", recursive=True))
def manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder)


@query(
    sql=with_views(
        ["v_sources", "v_candidates"], *PL.COUNTED_STEPS, EXHIBITS, *REASON_STEPS, *MANIFEST,
        select="SELECT matter_id, count(*) FILTER (kind = 'exhibit') AS exhibit_n, count(*) FILTER (kind = 'excluded-file') AS excluded_file_n, count(*) FILTER (kind = 'omitted-citation') AS omitted_citation_n, count(*) FILTER (kind = 'volume') AS volume_n FROM man GROUP BY 1",
        recursive=True,
    )
)
def manifest_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return report.manifest_rollup(_manifest(spark, folder), KEYS)
