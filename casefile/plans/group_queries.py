"""Groups of repeated citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.operators import groups
from casefile.plans.catalog import query
from casefile.plans.sql import with_views
from casefile.session import cut_lineage
from casefile.sources import views

KEYS = ["matter_id"]


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.candidates(spark, folder)
    pages = F.concat(F.col("page_start").cast("string"), F.lit("-"), (F.col("page_start") + F.col("content_pages") - 1).cast("string"))
    return cut_lineage(rows.withColumn("selection", F.when(F.col("extension") == "pdf", pages).otherwise("")))


GROUP_STEPS = [
    ("sel", (
        "SELECT *, CASE WHEN extension = 'pdf' THEN concat(page_start, '-', page_start + content_pages - 1) ELSE '' END AS selection, "
        "row_number() OVER (PARTITION BY matter_id, bundle_mark, source_sha256 ORDER BY seq) AS r, count(*) OVER (PARTITION BY matter_id, bundle_mark, source_sha256) AS copies "
        "FROM v_candidates WHERE included AND evidence_id IS NOT NULL AND source_sha256 IS NOT NULL")),
    ("clu", (
        "SELECT matter_id, bundle_mark, source_sha256, arg_min(candidate_id, seq) AS candidate_id, min(seq) AS seq, arg_min(coalesce(parent_sha256, ''), seq) AS p, any_value(copies) AS copies, copies > 1 AS collision, "
        "copies > 1 AND coalesce(bool_or(coalesce(repeat_decision, 'pending') = 'pending') FILTER (r > 1), false) AS decision_pending, "
        "copies > 1 AND count(DISTINCT selection) FILTER (r = 1 OR repeat_decision = 'same') > 1 AS selection_conflict, "
        "count(*) FILTER (r = 1 OR repeat_decision = 'same') AS members, count(*) FILTER ((r = 1 OR repeat_decision = 'same') AND NOT manual_addition) AS refs, "
        "coalesce(bool_or(NOT confirmed AND parent_sha256 IS NULL), false) AS has_outstanding FROM sel GROUP BY matter_id, bundle_mark, source_sha256, copies")),
    ("grp0", (
        "SELECT matter_id, bundle_mark, source_sha256, candidate_id, seq, nullif(p, '') AS parent_sha256, copies, collision, decision_pending, selection_conflict, members, refs, has_outstanding FROM clu UNION ALL "
        "SELECT matter_id, bundle_mark, source_sha256, candidate_id, seq, parent_sha256, 1, true, false, false, 1, CASE WHEN manual_addition THEN 0 ELSE 1 END, NOT confirmed AND parent_sha256 IS NULL FROM sel WHERE r > 1 AND repeat_decision = 'separate'")),
    ("grp", "SELECT *, concat('candidate-', candidate_id) AS group_id, row_number() OVER (PARTITION BY matter_id, bundle_mark ORDER BY seq) AS exhibit_number FROM grp0"),
]
_COLUMNS = "matter_id, group_id, source_sha256, seq, collision, decision_pending, selection_conflict, members, exhibit_number"


@query(sql=with_views(["v_candidates"], *GROUP_STEPS, select=f'SELECT {_COLUMNS}, copies, refs AS "references" FROM grp'))
def derive_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.derive_groups(candidates(spark, folder), KEYS).select(*_COLUMNS.split(", "), "copies", "references")


@query(
    sql=with_views(
        ["v_candidates"], *GROUP_STEPS,
        select=(
            "SELECT s.matter_id, concat('candidate-', c.candidate_id) AS group_id, s.candidate_id, CASE WHEN r = 1 THEN 'canonical' WHEN s.repeat_decision = 'same' THEN 'joined' ELSE 'collision' END AS kind "
            "FROM sel s JOIN clu c USING (matter_id, bundle_mark, source_sha256)"
        ),
    )
)
def group_members(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_members(candidates(spark, folder), KEYS).select("matter_id", "group_id", "candidate_id", "kind")


def _order(found: DataFrame) -> DataFrame:
    """A saved order that reverses every second group, names some by the older id and repeats one."""
    half = found.filter(F.col("seq") % 2 == 0)
    name = F.when(F.col("seq") % 4 == 0, F.col("group_id")).otherwise(F.col("legacy_id"))
    return half.select("matter_id", (F.lit(100000) - F.col("seq")).alias("position"), name.alias("group_id"))


ORDER_STEPS = [
    *GROUP_STEPS,
    ("ord", "SELECT *, CASE WHEN seq % 2 = 0 THEN 100000 - seq END AS place FROM grp"),
    ("ordered", (
        "SELECT *, row_number() OVER (PARTITION BY matter_id, bundle_mark ORDER BY place IS NULL, coalesce(place, seq)) AS new_number, "
        "row_number() OVER (PARTITION BY matter_id ORDER BY place IS NULL, coalesce(place, seq)) AS position FROM ord")),
]


@query(
    sql=with_views(
        ["v_candidates"], *ORDER_STEPS, select="SELECT matter_id, group_id, new_number AS exhibit_number, position FROM ordered"
    )
)
def order_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = groups.derive_groups(candidates(spark, folder), KEYS)
    return groups.order_groups(found, _order(found), KEYS).select("matter_id", "group_id", "exhibit_number", "position")


@query(
    sql=with_views(
        ["v_candidates"], *ORDER_STEPS,
        ("host", "SELECT s.matter_id, s.candidate_id, o.position - 0.5 AS hp FROM sel s JOIN clu c USING (matter_id, bundle_mark, source_sha256) JOIN ordered o ON o.matter_id = c.matter_id AND o.candidate_id = c.candidate_id"),
        ("shown", (
            "SELECT v.matter_id, v.candidate_id, v.seq, coalesce(o.position - 1, h.hp, 9e15) AS place FROM v_candidates v LEFT JOIN ordered o USING (matter_id, candidate_id) LEFT JOIN host h USING (matter_id, candidate_id) "
            "WHERE v.parent_sha256 IS NULL AND (v.evidence_id IS NULL OR o.position IS NOT NULL OR (v.included AND coalesce(v.repeat_decision NOT IN ('same', 'separate'), true)))")),
        select="SELECT matter_id, candidate_id, row_number() OVER (PARTITION BY matter_id ORDER BY place, seq) AS item_number FROM shown",
    )
)
def review_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    found = groups.derive_groups(rows, KEYS)
    return groups.review_list(rows, groups.order_groups(found, _order(found), KEYS), KEYS)


PENDING_STEPS = [
    *GROUP_STEPS,
    ("opn", "SELECT * FROM v_candidates WHERE included AND (evidence_id IS NULL OR NOT confirmed)"),
    ("gcard", "SELECT matter_id, source_sha256, arg_min(candidate_id, seq) AS gc FROM grp WHERE parent_sha256 IS NULL GROUP BY ALL"),
    ("lcard", "SELECT matter_id, source_sha256, arg_min(candidate_id, seq) AS lc FROM v_candidates WHERE parent_sha256 IS NULL AND evidence_id IS NOT NULL GROUP BY ALL"),
    ("pending", (
        "SELECT matter_id, candidate_id FROM opn WHERE parent_sha256 IS NULL UNION SELECT o.matter_id, coalesce(gc, lc) FROM opn o JOIN lcard l ON l.matter_id = o.matter_id AND l.source_sha256 = o.parent_sha256 "
        "LEFT JOIN gcard g ON g.matter_id = o.matter_id AND g.source_sha256 = o.parent_sha256 WHERE o.parent_sha256 IS NOT NULL "
        "UNION SELECT matter_id, candidate_id FROM grp WHERE parent_sha256 IS NULL AND (decision_pending OR selection_conflict OR has_outstanding)")),
]


@query(sql=with_views(["v_candidates"], *PENDING_STEPS, select="SELECT * FROM pending"))
def pending_reviews(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    return groups.pending_reviews(rows, groups.derive_groups(rows, KEYS), KEYS)


@query(
    sql=with_views(
        ["v_candidates"], *GROUP_STEPS,
        select=(
            "SELECT matter_id, candidate_id FROM v_candidates WHERE included AND evidence_id IS NOT NULL AND NOT confirmed AND parent_sha256 IS NULL "
            "AND (matter_id, candidate_id) NOT IN (SELECT (matter_id, candidate_id) FROM sel WHERE r > 1) AND (matter_id, candidate_id) NOT IN (SELECT (matter_id, candidate_id) FROM grp WHERE decision_pending OR selection_conflict)"
        ),
    )
)
def bulk_confirmable(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    return groups.bulk_confirmable(rows, groups.derive_groups(rows, KEYS), KEYS)


@query(
    sql=with_views(
        ["v_candidates"], *GROUP_STEPS,
        ("par", "SELECT matter_id, source_sha256, arg_min(group_id, seq) AS after_id FROM grp WHERE parent_sha256 IS NULL GROUP BY ALL"),
        select="SELECT g.matter_id, g.group_id, p.after_id FROM grp g JOIN par p ON p.matter_id = g.matter_id AND p.source_sha256 = g.parent_sha256",
    )
)
def child_insert_after(spark: SparkSession, folder: str) -> DataFrame:
    return groups.child_insert_after(groups.derive_groups(candidates(spark, folder), KEYS), KEYS)


@query(
    sql=with_views(
        ["v_candidates"], *PENDING_STEPS,
        ("rep", "SELECT matter_id, count(*) FILTER (copies > 1) AS repeats FROM grp WHERE parent_sha256 IS NULL GROUP BY 1"),
        ("pen", "SELECT matter_id, count(*) AS pending_n FROM pending GROUP BY 1"),
        ("cnt", (
            "SELECT matter_id, count(*) FILTER (included AND parent_sha256 IS NULL) AS included_n, count(*) FILTER (included AND evidence_id IS NOT NULL AND confirmed AND parent_sha256 IS NULL) AS confirmed_n, "
            "count(*) FILTER (included AND evidence_id IS NOT NULL AND NOT manual_addition) AS matched_citations, count(*) FILTER (included AND evidence_id IS NOT NULL AND NOT manual_addition AND confirmed) AS confirmed_citations, "
            "count(*) FILTER (included AND manual_addition) AS added_n FROM v_candidates GROUP BY 1")),
        select="SELECT cnt.*, coalesce(repeats, 0) AS repeats, coalesce(pending_n, 0) AS pending_n FROM cnt LEFT JOIN rep USING (matter_id) LEFT JOIN pen USING (matter_id)",
    )
)
def progress_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    found = groups.derive_groups(rows, KEYS)
    return groups.progress_counts(rows, found, groups.pending_reviews(rows, found, KEYS), KEYS)


@query(
    sql=with_views(
        ["v_candidates"],
        select=(
            "SELECT matter_id, min(m) <> max(m) AS conflict, min(m) AS low, max(m) AS high FROM (SELECT matter_id, concat('AH', 1 + (matter_id % 2) * (content_pages % 2)) AS m FROM v_candidates WHERE included AND NOT manual_addition) x GROUP BY matter_id"
        ),
    )
)
def mark_conflict(spark: SparkSession, folder: str) -> DataFrame:
    number = 1 + (F.col("matter_id") % 2) * (F.col("content_pages") % 2)
    rows = candidates(spark, folder).withColumn("identity", F.concat(F.lit("ah "), number.cast("string")))
    return groups.mark_conflict(rows, KEYS, "identity")
