"""Arrangement, volumes, page numbers and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.operators import arrangement, planning
from casefile.plans.catalog import query
from casefile.plans.sql import with_views
from casefile.plans.text_queries import sql_roman
from casefile.session import cut_lineage
from casefile.sources import views

KEYS = ["matter_id"]
NODE_COLUMNS = ["matter_id", "pos", "section_id", "heading", "inner_pos", "exhibit_id"]
_NODES = ["v_arrangement", "v_nodes"]


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(views.arrangement_nodes(spark, folder))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(views.candidates(spark, folder))


@query(
    sql=with_views(
        _NODES,
        ("bad", "SELECT matter_id, pos, section_id, CASE WHEN pos % 7 = 2 AND section_id IS NOT NULL THEN ' ' ELSE heading END AS heading, inner_pos, CASE WHEN pos % 5 = 0 THEN 'dup' ELSE exhibit_id END AS exhibit_id FROM v_nodes"),
        select=(
            "SELECT matter_id, 'exhibit occurs more than once' AS issue, exhibit_id AS subject, count(*) - 1 AS times FROM bad GROUP BY matter_id, exhibit_id HAVING count(*) > 1 "
            "UNION ALL SELECT matter_id, 'invalid section heading', CAST(pos AS VARCHAR), 1 FROM (SELECT DISTINCT matter_id, pos, section_id, heading FROM bad WHERE section_id IS NOT NULL) x WHERE trim(heading) = ''"
        ),
    )
)
def arrangement_issues(spark: SparkSession, folder: str) -> DataFrame:
    blank = (F.col("pos") % 7 == 2) & F.col("section_id").isNotNull()
    rows = nodes(spark, folder).withColumn("heading", F.when(blank, " ").otherwise(F.col("heading")))
    rows = rows.withColumn("exhibit_id", F.when(F.col("pos") % 5 == 0, "dup").otherwise(F.col("exhibit_id")))
    return arrangement.arrangement_issues(rows, KEYS)


@query(
    sql=with_views(_NODES, select="SELECT matter_id, exhibit_id, row_number() OVER (PARTITION BY matter_id ORDER BY pos, inner_pos) AS position FROM v_nodes")
)
def flatten_arrangement(spark: SparkSession, folder: str) -> DataFrame:
    return arrangement.flatten_arrangement(nodes(spark, folder), KEYS).select("matter_id", "exhibit_id", "position")


CONTAINERS = ("box", "SELECT *, block AS container, seq - block * 3 - 1 AS idx, count(*) OVER (PARTITION BY matter_id, block) AS len, min(pos) OVER (PARTITION BY matter_id, block) - 1 AS start FROM v_nodes JOIN (SELECT matter_id, exhibit_id, block, seq FROM v_arrangement) a USING (matter_id, exhibit_id)")


@query(
    sql=with_views(
        _NODES, CONTAINERS,
        select='SELECT matter_id, exhibit_id, section_id, idx AS "index", len AS length, CASE WHEN section_id IS NOT NULL THEN 0 ELSE start END AS top_level_start FROM box',
    )
)
def container_location(spark: SparkSession, folder: str) -> DataFrame:
    rows = arrangement.container_location(nodes(spark, folder), KEYS)
    return rows.select("matter_id", "exhibit_id", "section_id", "index", "length", "top_level_start")


def _current_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Exhibits of today: some are gone, two new ones appear per matter."""
    rows = views.arrangement(spark, folder).filter(F.col("seq") % 5 != 3).select("matter_id", F.col("seq").alias("ord"), "exhibit_id")
    fresh = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("matter_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    fresh = fresh.select("matter_id", (F.col("n") + 1000000).alias("ord"), F.concat(F.lit("new"), F.col("n").cast("string")).alias("exhibit_id"))
    return rows.unionByName(fresh)


def _glue(ids: DataFrame) -> DataFrame:
    """Every exhibit whose order ends in 4 is an attachment of the one two places earlier."""
    parents = ids.select("matter_id", (F.col("ord") + 2).alias("ord"), F.col("exhibit_id").alias("after_id"))
    return ids.filter(F.col("ord") % 10 == 4).join(parents, ["matter_id", "ord"]).select("matter_id", "exhibit_id", "after_id")


@query(
    sql=with_views(
        [*_NODES],
        ("ids", "SELECT matter_id, seq AS ord, exhibit_id FROM v_arrangement WHERE seq % 5 <> 3 UNION ALL SELECT c_custkey, 1000000 + n, concat('new', n) FROM customer, (VALUES (1), (2)) t(n)"),
        ("glue", "SELECT a.matter_id, a.exhibit_id, b.exhibit_id AS after_id FROM ids a JOIN ids b ON b.matter_id = a.matter_id AND b.ord = a.ord - 2 WHERE a.ord % 10 = 4"),
        ("base", (
            "SELECT i.matter_id, i.exhibit_id, i.ord, g.after_id, n.pos, n.inner_pos, n.section_id, n.heading FROM ids i LEFT JOIN glue g USING (matter_id, exhibit_id) LEFT JOIN v_nodes n USING (matter_id, exhibit_id)")),
        ("seat", (
            "SELECT matter_id, exhibit_id, section_id, heading, CASE WHEN pos IS NULL THEN 1 ELSE 0 END AS phase, CAST(coalesce(pos, ord) AS DOUBLE) AS t, CAST(coalesce(inner_pos, 0) AS DOUBLE) AS i FROM base WHERE after_id IS NULL "
            "UNION ALL SELECT c.matter_id, c.exhibit_id, p.section_id, p.heading, 0, p.pos + CASE WHEN p.section_id IS NULL THEN 0.5 ELSE 0 END, CASE WHEN p.section_id IS NULL THEN 0 ELSE p.inner_pos + 0.5 END FROM base c JOIN base p ON p.matter_id = c.matter_id AND p.exhibit_id = c.after_id "
            "UNION ALL SELECT DISTINCT matter_id, NULL, section_id, heading, 0, CAST(pos AS DOUBLE), 0.0 FROM v_nodes v WHERE section_id IS NOT NULL")),
        ("slim", "SELECT * FROM seat s WHERE exhibit_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM seat k WHERE k.matter_id = s.matter_id AND k.section_id = s.section_id AND k.exhibit_id IS NOT NULL)"),
        select=(
            "SELECT matter_id, dense_rank() OVER (PARTITION BY matter_id ORDER BY phase, t) AS pos, section_id, heading, "
            "CASE WHEN section_id IS NOT NULL AND exhibit_id IS NOT NULL THEN row_number() OVER (PARTITION BY matter_id, phase, t ORDER BY i) END AS inner_pos, exhibit_id FROM slim"
        ),
    )
)
def reconcile_arrangement(spark: SparkSession, folder: str) -> DataFrame:
    ids = cut_lineage(_current_ids(spark, folder))
    rows = arrangement.reconcile_arrangement(nodes(spark, folder), ids, KEYS, _glue(ids))
    return rows.select(*NODE_COLUMNS)


@query(
    sql=with_views(
        [*_NODES, "v_candidates"], CONTAINERS,
        ("attr", "SELECT matter_id, candidate_id AS exhibit_id, manual_addition, date_text, paragraph FROM v_candidates"),
        ("ranked", "SELECT matter_id, container, exhibit_id, row_number() OVER (PARTITION BY matter_id, container ORDER BY manual_addition, date_text, paragraph) - 1 AS idx FROM box JOIN attr USING (matter_id, exhibit_id)"),
        select="SELECT b.matter_id, b.pos, b.section_id, b.heading, b.inner_pos, r.exhibit_id FROM box b JOIN ranked r USING (matter_id, container, idx)",
    )
)
def sort_within_sections(spark: SparkSession, folder: str) -> DataFrame:
    attributes = candidates(spark, folder).select(
        "matter_id", F.col("candidate_id").alias("exhibit_id"), "manual_addition", "date_text", "paragraph",
        F.substring("date_text", 1, 4).alias("day"),
    )
    order_by = ["manual_addition", "date_text", "paragraph"]
    rows = arrangement.sort_within_sections(nodes(spark, folder), attributes, KEYS, order_by, ["manual_addition", "day"])
    return rows.select(*NODE_COLUMNS)


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    """One edit per matter: kinds alternate with the customer key; some are impossible."""
    key = F.col("c_custkey")
    kind = key % 6
    action = (
        F.when(kind == 0, "rename").when(kind == 1, "delete-section").when(kind == 2, "move-section")
        .when(kind == 3, "rename").when(kind == 4, "add-section").otherwise("move-section")
    )
    section = F.when(kind == 3, "s99999").when(kind == 4, "fresh").otherwise("s1")
    index = F.when(kind == 4, F.lit(2)).when(kind == 5, F.lit(-1)).otherwise(F.lit(0))
    return views.table(spark, folder, "customer").select(
        key.alias("matter_id"), action.alias("action"), F.lit(None).cast("string").alias("exhibit_id"),
        section.alias("section_id"), F.when(kind == 4, "Fresh").otherwise("Renamed").alias("heading"), index.alias("index"),
    )


@query(
    sql=with_views(
        _NODES,
        ("k", "SELECT *, matter_id % 6 AS kind FROM v_nodes"),
        ("info", "SELECT matter_id, bool_or(section_id = 's1') AS has_s1, max(CASE WHEN section_id = 's1' THEN pos END) AS s_pos, count(DISTINCT pos) AS tops FROM v_nodes GROUP BY 1"),
        ("moved", (
            "SELECT matter_id, exhibit_id, CASE WHEN kind = 1 AND section_id = 's1' THEN NULL ELSE section_id END AS section_id, CASE WHEN kind = 0 AND section_id = 's1' THEN 'Renamed' WHEN kind = 1 AND section_id = 's1' THEN NULL ELSE heading END AS heading, "
            "CASE WHEN kind = 1 AND section_id = 's1' THEN pos + inner_pos / 10.0 WHEN kind = 2 AND section_id = 's1' THEN 0 ELSE pos END AS t, coalesce(inner_pos, 0) AS i FROM k "
            "UNION ALL SELECT matter_id, NULL, 'fresh', 'Fresh', 2.5, 0 FROM info WHERE matter_id % 6 = 4 AND tops >= 2")),
        select=(
            "SELECT matter_id, dense_rank() OVER (PARTITION BY matter_id ORDER BY t) AS pos, section_id, heading, CASE WHEN section_id IS NOT NULL AND exhibit_id IS NOT NULL THEN row_number() OVER (PARTITION BY matter_id, t ORDER BY i) END AS inner_pos, exhibit_id FROM moved"
        ),
    )
)
def edit_arrangement(spark: SparkSession, folder: str) -> DataFrame:
    changed, _ = arrangement.edit_arrangement(nodes(spark, folder), _edits(spark, folder), KEYS)
    return changed.select(*NODE_COLUMNS)


@query(
    sql=with_views(
        _NODES,
        ("info", "SELECT matter_id, coalesce(bool_or(section_id = 's1'), false) AS has_s1, count(DISTINCT pos) AS tops FROM v_nodes GROUP BY 1"),
        select=(
            "SELECT matter_id, CASE matter_id % 6 WHEN 0 THEN 'rename' WHEN 1 THEN 'delete-section' WHEN 2 THEN 'move-section' WHEN 3 THEN 'rename' WHEN 4 THEN 'add-section' ELSE 'move-section' END AS action, "
            "CASE WHEN matter_id % 6 IN (0, 1, 2, 5) AND NOT has_s1 THEN 'section does not exist' WHEN matter_id % 6 = 3 THEN 'section does not exist' WHEN matter_id % 6 = 5 THEN 'index is invalid' ELSE 'index is outside' END AS issue FROM info "
            "WHERE matter_id % 6 IN (3, 5) OR (matter_id % 6 IN (0, 1, 2) AND NOT has_s1) OR (matter_id % 6 = 4 AND tops < 2)"
        ),
    )
)
def refused_edits(spark: SparkSession, folder: str) -> DataFrame:
    _, refused = arrangement.edit_arrangement(nodes(spark, folder), _edits(spark, folder), KEYS)
    return refused


# a section around every third top-level node and the second exhibit of each section; some cannot be
_CHOSEN = "exhibit_id IS NOT NULL AND (pos % 3 = 1 OR coalesce(inner_pos = 2, false))"
_SECTION_STEPS = [
    ("k0", f"SELECT *, {_CHOSEN} AS chosen FROM v_nodes"),
    ("room", "SELECT matter_id, count(DISTINCT CASE WHEN NOT (chosen AND section_id IS NULL) THEN pos END) AS n, coalesce(bool_or(section_id = 's1'), false) AS s1, bool_or(chosen) AS any_chosen FROM k0 GROUP BY 1"),
    ("verdict", (
        "SELECT matter_id, any_chosen, CASE WHEN matter_id % 7 = 2 THEN 's1' ELSE 'fresh' END AS sid, CASE matter_id % 7 WHEN 3 THEN 'section id or heading is invalid' WHEN 4 THEN 'index is invalid' ELSE "
        "CASE WHEN matter_id % 7 = 2 AND s1 THEN 'section already exists' WHEN matter_id % 7 = 0 AND any_chosen THEN 'exhibit is selected more than once' WHEN matter_id % 7 = 1 THEN 'exhibit is not present' WHEN matter_id % 4 > n THEN 'index is outside' END END AS issue FROM room")),
    ("k", "SELECT k0.*, chosen AND issue IS NULL AS moved, sid FROM k0 JOIN verdict USING (matter_id)"),
    ("rem", "SELECT *, dense_rank() OVER (PARTITION BY matter_id ORDER BY pos) - 1 AS t FROM k WHERE NOT (moved AND section_id IS NULL)"),
    ("placed", (
        "SELECT matter_id, CAST(t AS DOUBLE) AS t, section_id, heading, coalesce(inner_pos, 0) AS i, 0 AS j, exhibit_id FROM rem WHERE NOT moved "
        "UNION ALL SELECT matter_id, matter_id % 4 - 0.5, sid, 'Fresh', pos, coalesce(inner_pos, 0), exhibit_id FROM k WHERE moved "
        "UNION ALL SELECT matter_id, t, section_id, heading, 0, 0, NULL FROM rem GROUP BY matter_id, t, section_id, heading HAVING bool_and(moved) "
        "UNION ALL SELECT matter_id, matter_id % 4 - 0.5, sid, 'Fresh', 0, 0, NULL FROM verdict WHERE issue IS NULL AND NOT any_chosen")),
]


def _sections(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = nodes(spark, folder)
    key = F.col("matter_id")
    sections = rows.select("matter_id").distinct().select(
        "matter_id", F.when(key % 7 == 2, "s1").otherwise("fresh").alias("section_id"), F.when(key % 7 == 3, " ").otherwise("Fresh").alias("heading"),
        F.when(key % 7 == 4, -1).otherwise(key % 4).alias("index"),
    )
    chosen = rows.filter(_CHOSEN).select("matter_id", "exhibit_id")
    missing = sections.filter(key % 7 == 1).select("matter_id", F.lit("missing").alias("exhibit_id"))
    return arrangement.add_sections(rows, sections, chosen.union(chosen.filter(key % 7 == 0)).union(missing), KEYS)


@query(
    sql=with_views(
        _NODES, *_SECTION_STEPS,
        select="SELECT matter_id, dense_rank() OVER (PARTITION BY matter_id ORDER BY t) AS pos, section_id, heading, CASE WHEN section_id IS NOT NULL AND exhibit_id IS NOT NULL THEN row_number() OVER (PARTITION BY matter_id, t ORDER BY i, j) END AS inner_pos, exhibit_id FROM placed",
    )
)
def add_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder)[0].select(*NODE_COLUMNS)


@query(sql=with_views(_NODES, *_SECTION_STEPS[:3], select="SELECT matter_id, sid AS section_id, issue FROM verdict WHERE issue IS NOT NULL"))
def refused_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder)[1]


@query(
    sql=with_views(
        ["v_arrangement"],
        select=(
            "SELECT matter_id, exhibit_id AS item_id, CASE WHEN n < 4 THEN seq WHEN seq = 2 THEN 4 WHEN seq IN (3, 4) THEN seq - 1 ELSE seq END AS position FROM (SELECT *, count(*) OVER (PARTITION BY matter_id) AS n FROM v_arrangement) x"
        ),
    )
)
def reorder_for_drop(spark: SparkSession, folder: str) -> DataFrame:
    items = cut_lineage(views.arrangement(spark, folder).select("matter_id", F.col("exhibit_id").alias("item_id"), F.col("seq").alias("position")))
    moved = items.filter("position = 2").select("matter_id", F.col("item_id").alias("moved_id"))
    target = items.filter("position = 4").select("matter_id", F.col("item_id").alias("target_id"))
    return arrangement.reorder_for_drop(items, moved.join(target, "matter_id"), KEYS)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    pages = F.col("content_pages")
    return candidates(spark, folder).select(
        "matter_id", F.col("candidate_id").alias("exhibit_id"), F.col("seq").alias("exhibit_number"), "description", "date_text",
        F.col("seq").cast("string").alias("label_start"), (F.col("seq") + pages - 1).cast("string").alias("label_end"),
        (F.col("seq") % 3 + 1).alias("volume"), (F.col("matter_id") % 2 == 0).alias("multi_volume"),
    )


INDEX_STEPS = [
    ("flat", "SELECT *, row_number() OVER (PARTITION BY matter_id ORDER BY pos, inner_pos) AS position FROM v_nodes"),
    ("nb", "SELECT *, lag(section_id) OVER (PARTITION BY matter_id ORDER BY position) AS ps FROM flat"),
    ("idx", (
        "SELECT f.matter_id, position * 2 AS row_order, 'exhibit' AS kind, concat('exhibit:', exhibit_id) AS row_id, CAST(c.seq AS VARCHAR) AS exhibit_label, c.description AS title, "
        "concat(CASE WHEN f.matter_id % 2 = 0 THEN concat('Vol. ', c.seq % 3 + 1, ' / ') ELSE '' END, c.seq, CASE WHEN content_pages > 1 THEN concat('-', c.seq + content_pages - 1) ELSE '' END) AS page_label, "
        "f.section_id IS NULL AND ps IS NOT NULL AS group_break FROM nb f JOIN v_candidates c ON c.matter_id = f.matter_id AND c.candidate_id = f.exhibit_id "
        "UNION ALL SELECT matter_id, position * 2 - 1, 'section', concat('section:', section_id), NULL, heading, NULL, false FROM nb WHERE inner_pos = 1")),
]


@query(sql=with_views([*_NODES, "v_candidates"], *INDEX_STEPS, select="SELECT * FROM idx"))
def index_rows(spark: SparkSession, folder: str) -> DataFrame:
    return arrangement.index_rows(nodes(spark, folder), _records(spark, folder), KEYS)


def _measured_rows(spark: SparkSession, folder: str) -> DataFrame:
    from casefile.functions.ordered import chunk_of, number_rows

    rows = arrangement.index_rows(nodes(spark, folder), _records(spark, folder), KEYS).withColumn("_chunk", chunk_of("row_order"))
    rows = cut_lineage(number_rows(rows, KEYS, ["row_order"], "position", ["_chunk"]))
    height = F.when(F.col("kind") == "section", 30.0).otherwise(20.0 + F.length("title"))
    return rows.select("matter_id", "position", "row_id", "kind", "group_break", height.alias("height"))


@query(
    sql=with_views(
        [*_NODES, "v_candidates"], *INDEX_STEPS,
        ("m", "SELECT matter_id, row_number() OVER (PARTITION BY matter_id ORDER BY row_order) AS n, row_id, kind, group_break, CASE WHEN kind = 'section' THEN 30.0 ELSE 20.0 + length(title) END::DOUBLE AS h FROM idx"),
        ("mm", "SELECT *, lead(kind) OVER w AS nk, lead(h) OVER w AS nh, lead(group_break) OVER w AS nb FROM m WINDOW w AS (PARTITION BY matter_id ORDER BY n)"),
        ("walk", (
            "SELECT matter_id, 0::BIGINT AS n, NULL::VARCHAR AS row_id, NULL::VARCHAR AS kind, 1::BIGINT AS page, 0.0::DOUBLE AS used FROM (SELECT DISTINCT matter_id FROM m) z UNION ALL "
            "SELECT matter_id, n, row_id, kind, CASE WHEN brk THEN page + 1 ELSE page END, CASE WHEN brk OR used = 0 THEN h ELSE used + gap + h END FROM ("
            "SELECT t.matter_id, t.n, t.row_id, t.kind, w.page, w.used, t.h, 2.0 + CASE WHEN t.kind = 'exhibit' AND t.group_break THEN 12.0 ELSE 0 END AS gap, "
            "w.used > 0 AND w.used + 2.0 + CASE WHEN t.kind = 'exhibit' AND t.group_break THEN 12.0 ELSE 0 END + CASE WHEN t.kind = 'section' AND t.nk = 'exhibit' THEN t.h + 2.0 + CASE WHEN t.nb THEN 12.0 ELSE 0 END + t.nh ELSE t.h END > 120 AS brk "
            "FROM walk w JOIN mm t ON t.matter_id = w.matter_id AND t.n = w.n + 1) q")),
        select="SELECT matter_id, n AS position, row_id, kind, page FROM walk WHERE n > 0",
        recursive=True,
    )
)
def paginate_rows(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = planning.paginate_rows(_measured_rows(spark, folder), KEYS, 120.0, 2.0, 12.0)
    return placed


def _plan_items(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    rows = candidates(spark, folder) if rows is None else rows
    return rows.select(
        "matter_id", F.col("candidate_id").alias("item_id"), F.col("seq").alias("position"), "content_pages", "optional_pages",
        (F.col("content_pages") + F.col("optional_pages")).alias("physical_pages"),
    )


def fit_walk(limit: int, weight: str) -> tuple[str, str]:
    return (
        "walk",
        f"SELECT matter_id, 0::BIGINT AS n, NULL::VARCHAR AS item_id, 0::BIGINT AS volume, {limit}::BIGINT AS used FROM (SELECT DISTINCT matter_id FROM v_candidates) z UNION ALL "
        f"SELECT c.matter_id, c.seq, c.candidate_id, CASE WHEN w.n = 0 OR w.used + {weight} > {limit} THEN w.volume + 1 ELSE w.volume END, CASE WHEN w.n = 0 OR w.used + {weight} > {limit} THEN {weight} ELSE w.used + {weight} END "
        "FROM walk w JOIN v_candidates c ON c.matter_id = w.matter_id AND c.seq = w.n + 1",
    )


@query(
    sql=with_views(
        ["v_candidates"], fit_walk(18, "greatest(1, content_pages)"),
        ("vol", "SELECT w.matter_id, w.item_id, w.volume, content_pages AS pages FROM walk w JOIN v_candidates c ON c.matter_id = w.matter_id AND c.candidate_id = w.item_id"),
        select="SELECT matter_id, item_id, volume, sum(pages) OVER (PARTITION BY matter_id, volume) AS volume_pages, sum(pages) OVER (PARTITION BY matter_id, volume) > 18 AS oversize FROM vol",
        recursive=True,
    )
)
def plan_volumes(spark: SparkSession, folder: str) -> DataFrame:
    planned = planning.plan_volumes(_plan_items(spark, folder), KEYS, 18, pages="content_pages")
    return planned.select("matter_id", "item_id", "volume", "volume_pages", "oversize")


def plan_steps(legal: str, counted: str) -> list[tuple[str, str]]:
    return [
        fit_walk(28, "(content_pages + optional_pages)"),
        ("vol", "SELECT w.matter_id, w.n AS position, w.item_id, w.volume, c.content_pages AS cp, c.optional_pages AS op, c.content_pages + c.optional_pages AS pp FROM walk w JOIN v_candidates c ON c.matter_id = w.matter_id AND c.candidate_id = w.item_id"),
        ("tot", f"SELECT matter_id, volume, sum(pp) + 2 AS total_pages, sum(cp + {counted}) AS ref_pages FROM vol GROUP BY ALL"),
        ("off", "SELECT *, coalesce(sum(total_pages) OVER w, 0) AS pdf_before, coalesce(sum(ref_pages) OVER w, 0) AS ref_before FROM tot WINDOW w AS (PARTITION BY matter_id ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
        ("run", f"SELECT v.*, total_pages, pdf_before, ref_before, coalesce(sum(pp) OVER w, 0) AS earlier, coalesce(sum(cp + {counted}) OVER w, 0) AS ref_earlier FROM vol v JOIN off USING (matter_id, volume) WINDOW w AS (PARTITION BY matter_id, volume ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
        ("plan", f"SELECT matter_id, item_id, position, volume, 3 + earlier AS physical_start, 3 + earlier + op AS content_start, 3 + earlier + pp - 1 AS physical_end, {legal} AS legal_start, {legal} + cp - 1 AS legal_end, total_pages, total_pages > 30 AS oversize FROM run"),
    ]


COUNTED_STEPS = plan_steps("5 + ref_earlier + op + ref_before", "op")


@query(sql=with_views(["v_candidates"], *COUNTED_STEPS, select="SELECT * FROM plan", recursive=True))
def build_plan(spark: SparkSession, folder: str) -> DataFrame:
    return planning.build_plan(_plan_items(spark, folder), KEYS, page_limit=30, count_optional=True, start_at=5)


@query(
    sql=with_views(["v_candidates"], *plan_steps("3 + earlier + op + pdf_before", "0"), select="SELECT * FROM plan", recursive=True)
)
def build_plan_pdf_order(spark: SparkSession, folder: str) -> DataFrame:
    return planning.build_plan(_plan_items(spark, folder), KEYS, page_limit=30, match_pdf_order=True)


LABEL_WIDTH, LINE, INDEX_PAGE, MOST_PAGES = 7, 34.0, 400.0, 12
"""Characters of a page label in a line, height of a line, height of an index page; index pages the SQL tries."""

CONVERGED_STEPS = [
    # what every matter would be planned to with 1, 2, ... index pages
    ("tries", f"SELECT matter_id, unnest(range(1, {MOST_PAGES} + 1)) AS k FROM (SELECT DISTINCT matter_id FROM v_candidates) z"),
    ("fit", (
        "SELECT matter_id, k, 0::BIGINT AS n, NULL::VARCHAR AS item_id, 0::BIGINT AS volume, 0::BIGINT AS used FROM tries UNION ALL "
        "SELECT c.matter_id, f.k, c.seq, c.candidate_id, CASE WHEN f.n = 0 OR f.used + pp > 29 - f.k THEN f.volume + 1 ELSE f.volume END, CASE WHEN f.n = 0 OR f.used + pp > 29 - f.k THEN pp ELSE f.used + pp END "
        "FROM fit f JOIN (SELECT *, content_pages + optional_pages AS pp FROM v_candidates) c ON c.matter_id = f.matter_id AND c.seq = f.n + 1")),
    ("vol", "SELECT f.matter_id, f.k, f.n AS position, f.item_id, f.volume, c.content_pages AS cp, c.optional_pages AS op, c.content_pages + c.optional_pages AS pp FROM fit f JOIN v_candidates c ON c.matter_id = f.matter_id AND c.candidate_id = f.item_id"),
    ("tot", "SELECT matter_id, k, volume, sum(pp) + 1 + k AS total_pages, sum(cp + op) AS ref_pages FROM vol GROUP BY matter_id, k, volume"),
    ("off", "SELECT *, max(volume) OVER (PARTITION BY matter_id, k) > 1 AS several, coalesce(sum(ref_pages) OVER (PARTITION BY matter_id, k ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref_before FROM tot"),
    ("run", "SELECT v.*, total_pages, several, ref_before, coalesce(sum(pp) OVER w, 0) AS earlier, coalesce(sum(cp + op) OVER w, 0) AS ref_earlier FROM vol v JOIN off USING (matter_id, k, volume) WINDOW w AS (PARTITION BY matter_id, k, volume ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    ("plans", "SELECT matter_id, k, item_id, position, volume, several, 2 + k + earlier AS physical_start, 5 + ref_earlier + op AS legal_start, 5 + ref_earlier + op + cp - 1 AS legal_end, total_pages FROM run"),
    ("flat", "SELECT *, row_number() OVER (PARTITION BY matter_id ORDER BY pos, inner_pos) AS place FROM v_nodes"),
    ("nb", "SELECT *, lag(section_id) OVER (PARTITION BY matter_id ORDER BY place) AS ps FROM flat"),
    ("lab", (
        "SELECT f.matter_id, k, place * 2 AS row_order, 'exhibit' AS kind, f.section_id IS NULL AND ps IS NOT NULL AS gb, "
        "concat(CASE WHEN several THEN concat('Vol. ', volume, ' / ') ELSE '' END, legal_start, CASE WHEN legal_end > legal_start THEN concat('-', legal_end) ELSE '' END) AS label FROM nb f JOIN plans p ON p.matter_id = f.matter_id AND p.item_id = f.exhibit_id "
        "UNION ALL SELECT f.matter_id, k, place * 2 - 1, 'section', false, NULL FROM nb f JOIN tries USING (matter_id) WHERE inner_pos = 1")),
    ("hgt", f"SELECT matter_id, k, row_number() OVER (PARTITION BY matter_id, k ORDER BY row_order) AS n, kind, gb, CASE WHEN kind = 'section' THEN {LINE} ELSE {LINE} * ceil(length(label) / {LABEL_WIDTH}.0) END::DOUBLE AS h FROM lab"),
    ("mm", "SELECT *, lead(kind) OVER w AS nk, lead(h) OVER w AS nh, lead(gb) OVER w AS ngb FROM hgt WINDOW w AS (PARTITION BY matter_id, k ORDER BY n)"),
    ("walk", (
        "SELECT matter_id, k, 0::BIGINT AS n, 1::BIGINT AS page, 0.0::DOUBLE AS used FROM tries UNION ALL "
        "SELECT matter_id, k, n, CASE WHEN brk THEN page + 1 ELSE page END, CASE WHEN brk OR used = 0 THEN h ELSE used + gap + h END FROM ("
        "SELECT t.matter_id, t.k, t.n, w.page, w.used, t.h, 2.0 + CASE WHEN t.kind = 'exhibit' AND t.gb THEN 12.0 ELSE 0 END AS gap, "
        "w.used > 0 AND w.used + 2.0 + CASE WHEN t.kind = 'exhibit' AND t.gb THEN 12.0 ELSE 0 END + CASE WHEN t.kind = 'section' AND t.nk = 'exhibit' THEN t.h + 2.0 + CASE WHEN t.ngb THEN 12.0 ELSE 0 END + t.nh ELSE t.h END > " + str(INDEX_PAGE) + " AS brk "
        "FROM walk w JOIN mm t ON t.matter_id = w.matter_id AND t.k = w.k AND t.n = w.n + 1) q")),
    ("pages", "SELECT matter_id, k, max(page) AS pages FROM walk GROUP BY ALL"),
    ("steps", (
        "SELECT matter_id, 1::BIGINT AS pass, k, pages, [k] AS seen FROM pages WHERE k = 1 UNION ALL "
        "SELECT s.matter_id, s.pass + 1, p.k, p.pages, list_append(s.seen, p.k) FROM steps s JOIN pages p ON p.matter_id = s.matter_id AND p.k = s.pages WHERE s.pages <> s.k AND NOT list_contains(s.seen, s.pages) AND s.pass < 16")),
]


def _converged(spark: SparkSession, folder: str) -> tuple:
    details = candidates(spark, folder).select("matter_id", F.col("candidate_id").alias("item_id"), F.col("seq").alias("exhibit_number"), "description", "date_text")
    height = F.when(F.col("kind") == "section", LINE).otherwise(F.ceil(F.length("page_label") / LABEL_WIDTH) * LINE)
    return planning.converged_plan(
        cut_lineage(_plan_items(spark, folder)), nodes(spark, folder), details, KEYS, height, INDEX_PAGE, 30, 2.0, 12.0, count_optional=True, start_at=5, continuous=False
    )


PLANNED = ["matter_id", "item_id", "position", "volume", "physical_start", "legal_start", "legal_end", "total_pages", "index_pages", "passes"]


@query(
    sql=with_views(
        [*_NODES, "v_candidates"], *CONVERGED_STEPS,
        select=(
            "SELECT p.matter_id, item_id, position, volume, physical_start, legal_start, legal_end, total_pages, k AS index_pages, pass AS passes, NULL AS problem FROM plans p JOIN steps s USING (matter_id, k) WHERE s.pages = s.k "
            "UNION ALL SELECT matter_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN list_contains(seen, pages) THEN '" + planning.NOT_STABLE + "' ELSE '" + planning.TOO_MANY_PASSES + "' END FROM steps WHERE pages <> k AND (list_contains(seen, pages) OR pass = 16)"
        ),
        recursive=True,
    )
)
def converged_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan, problems = _converged(spark, folder)
    return plan.select(*PLANNED, F.lit(None).cast("string").alias("problem")).unionByName(problems, allowMissingColumns=True)


@query(
    sql=with_views(
        ["v_candidates"],
        select=(
            "SELECT matter_id, CASE WHEN min(m) = max(m) THEN min(m) ELSE 'Exhibit Bundle' END AS identity FROM (SELECT matter_id, concat('AH ', 1 + (matter_id % 2) * (content_pages % 2)) AS m FROM v_candidates) x GROUP BY 1"
        ),
    )
)
def bundle_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).withColumn("initials", F.lit(" ah"))
    rows = rows.withColumn("sequence", 1 + (F.col("matter_id") % 2) * (F.col("content_pages") % 2))
    return planning.bundle_identity(rows, KEYS)


@query(
    sql=with_views(
        ["v_candidates"],
        select=(
            "SELECT matter_id, candidate_id, e - content_pages + 1 AS page_start_in_bundle, e AS page_end_in_bundle FROM (SELECT *, sum(content_pages + optional_pages) OVER (PARTITION BY matter_id, bundle_mark ORDER BY seq) AS e FROM v_candidates) x"
        ),
    )
)
def bundle_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).withColumn("position", F.col("seq"))
    rows = planning.allocate_bundle_pages(rows, KEYS, count_optional=True)
    return rows.select("matter_id", "candidate_id", "page_start_in_bundle", "page_end_in_bundle")


@query(
    sql=with_views(
        ["v_candidates"],
        ("m", "SELECT matter_id, candidate_id, description AS group_id, seq, source_sha256 AS sha256, content_pages AS pages FROM v_candidates WHERE source_sha256 IS NOT NULL"),
        ("f", "SELECT matter_id, group_id, sha256, min(seq) AS seq, arg_min(pages, seq) AS pages FROM m GROUP BY ALL"),
        ("r", "SELECT *, sum(pages) OVER (PARTITION BY matter_id, group_id ORDER BY seq) AS range_end FROM f"),
        select="SELECT m.matter_id, m.group_id, m.candidate_id, m.sha256, range_end - r.pages + 1 AS range_start, range_end FROM m JOIN r USING (matter_id, group_id, sha256)",
    )
)
def segment_ranges(spark: SparkSession, folder: str) -> DataFrame:
    members = candidates(spark, folder).filter("source_sha256 is not null").select(
        "matter_id", "candidate_id", F.col("description").alias("group_id"), "seq", F.col("source_sha256").alias("sha256"),
        F.col("content_pages").alias("pages"),
    )
    return planning.segment_ranges(members, KEYS).select("matter_id", "group_id", "candidate_id", "sha256", "range_start", "range_end")


def _planned(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    plan = planning.build_plan(_plan_items(spark, folder, rows), KEYS, page_limit=30, count_optional=True, start_at=5)
    return cut_lineage(plan.withColumn("mark", F.lit("AH 1")))


@query(
    sql=with_views(
        ["v_candidates"], *COUNTED_STEPS,
        select=(
            f"SELECT matter_id, volume, page, {sql_roman('page')} AS label FROM (SELECT DISTINCT matter_id, volume FROM plan) v, (VALUES (1), (2)) t(page) "
            "UNION ALL SELECT matter_id, volume, page, concat('AH1-', lpad(CAST(5 + page - 3 AS VARCHAR), 4, '0')) FROM (SELECT matter_id, volume, unnest(range(physical_start::BIGINT, physical_end::BIGINT + 1)) AS page FROM plan) x"
        ),
        recursive=True,
    )
)
def page_labels(spark: SparkSession, folder: str) -> DataFrame:
    plan = _planned(spark, folder)
    volumes = plan.select("matter_id", "volume").distinct()
    return planning.page_labels(plan, volumes, KEYS, scheme="section", padding=4, preliminary="roman", start_at=5)


@query(
    sql=with_views(
        ["v_candidates"], *COUNTED_STEPS,
        ("n", "SELECT *, max(volume) OVER (PARTITION BY matter_id) > 1 AS multi FROM plan"),
        select="SELECT matter_id, item_id, concat('AH1/', CASE WHEN multi THEN concat('Vol. ', volume, '/') ELSE '' END, CAST(legal_start AS BIGINT), CASE WHEN legal_end <> legal_start THEN concat('-', CAST(legal_end AS BIGINT)) ELSE '' END) AS reference FROM n",
        recursive=True,
    )
)
def volume_references(spark: SparkSession, folder: str) -> DataFrame:
    plan = _planned(spark, folder)
    volumes = plan.groupBy("matter_id").agg((F.max("volume") > 1).alias("multi"))
    reference = planning.volume_reference(F.lit("AH1"), F.col("volume"), F.col("legal_start"), F.col("legal_end"), F.col("multi"))
    return plan.join(volumes, "matter_id").select("matter_id", "item_id", reference.alias("reference"))


@query(
    sql=with_views(
        ["v_candidates"], *COUNTED_STEPS,
        ("n", (
            "SELECT p.matter_id, p.item_id, p.volume, CAST(legal_start AS BIGINT) AS a, CAST(legal_end AS BIGINT) AS b, max(p.volume) OVER (PARTITION BY p.matter_id) > 1 AS multi, c.* EXCLUDE (matter_id) "
            "FROM plan p JOIN v_candidates c ON c.matter_id = p.matter_id AND c.candidate_id = p.item_id")),
        ("s", (
            "SELECT *, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END AS span, CASE WHEN seq % 6 = 0 THEN concat(a + 1, '-', b + 1) END AS wanted, CASE WHEN seq % 9 = 0 THEN NULL ELSE 'AH1' END AS ex, CASE WHEN multi THEN concat('Vol. ', volume, '/') ELSE '' END AS vp FROM n")),
        select=(
            "SELECT matter_id, 1 AS block, paragraph AS line_order, item_id AS reference_id, CAST(paragraph AS BIGINT) AS paragraph, coalesce(ex, 'citation') AS exhibit, span AS page_range, "
            "CASE WHEN wanted IS NOT NULL AND wanted <> span THEN concat('Paragraph ', paragraph, ' - [', coalesce(ex, 'citation'), '/', vp, span, '] (requested ', CASE WHEN a = b THEN CAST(a + 1 AS VARCHAR) ELSE wanted END, '; review)') "
            "WHEN ex IS NULL THEN concat('Paragraph ', paragraph, ' - [citation/xx]') ELSE concat('Paragraph ', paragraph, ' - [', ex, '/', vp, span, ']') END AS line, (wanted IS NOT NULL AND wanted <> span) OR ex IS NULL AS needs_review FROM s WHERE NOT manual_addition "
            "UNION ALL SELECT DISTINCT matter_id, 2, 0, NULL, CAST(NULL AS BIGINT), '', NULL, 'Uncited exhibits — no statement reference', false FROM s WHERE manual_addition "
            "UNION ALL SELECT matter_id, 3, seq, NULL, CAST(NULL AS BIGINT), CAST(seq AS VARCHAR), span, concat(seq, '. ', description, ' — ', CASE WHEN multi THEN concat('Vol. ', volume, ', ') ELSE '' END, CASE WHEN a = b THEN 'page ' ELSE 'pages ' END, span), false FROM s WHERE manual_addition"
        ),
        recursive=True,
    )
)
def statement_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    plan = _planned(spark, folder)
    volumes = plan.groupBy("matter_id").agg((F.max("volume") > 1).alias("multi_volume"))
    rows = plan.drop("mark").withColumnRenamed("item_id", "candidate_id").join(candidates(spark, folder), ["matter_id", "candidate_id"])
    rows = rows.join(volumes, "matter_id").withColumn("label_start", F.lit(None).cast("string")).withColumn("label_end", F.lit(None).cast("string"))
    rows = rows.withColumn("reference_id", F.col("candidate_id")).withColumn("exhibit_number", F.col("seq"))
    rows = rows.drop("page_start").withColumn("page_start", F.col("legal_start")).withColumn("page_end", F.col("legal_end"))
    asked = F.col("seq") % 6 == 0
    rows = rows.withColumn("requested_start", F.when(asked, F.col("legal_start") + 1)).withColumn("requested_end", F.when(asked, F.col("legal_end") + 1))
    rows = rows.withColumn("initials", F.when(F.col("seq") % 9 != 0, "A H")).withColumn("sequence", F.lit(1))
    return planning.statement_suggestions(rows.filter("not manual_addition"), rows.filter("manual_addition"), KEYS)


CLASSIFY = (
    "cls",
    "SELECT *, CASE WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation, abs(width - tw) < 2 AND abs(height - th) < 2 AS is_a4, "
    "NOT (abs(width - tw) < 2 AND abs(height - th) < 2) AND abs(width / greatest(1.0, height) - tw / th) > 0.01 AS adds_margins FROM ("
    "SELECT *, CASE WHEN width > height THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS tw, CASE WHEN width > height THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS th FROM v_pages) x",
)


@query(sql=with_views(["v_pages"], CLASSIFY, select="SELECT source_id, page, orientation, is_a4, adds_margins, false AS unsafe FROM cls"))
def classify_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = planning.classify_pages(views.source_pages(spark, folder))
    return rows.select("source_id", "page", "orientation", "is_a4", "adds_margins", "unsafe")


@query(
    sql=with_views(
        ["v_pages"],
        ("t", "SELECT source_id, CASE WHEN rotation IN (90, 270) THEN height ELSE width END AS w, CASE WHEN rotation IN (90, 270) THEN width ELSE height END AS h FROM v_pages"),
        ("f", "SELECT source_id, abs(w - 595.28) < 0.02 AND abs(h - 841.89) < 0.02 AS p, abs(w - 841.89) < 0.02 AND abs(h - 595.28) < 0.02 AS l FROM t"),
        select="SELECT source_id, count(*) FILTER (p) AS portrait, count(*) FILTER (l) AS landscape, count(*) FILTER (NOT p AND NOT l) AS non_a4 FROM f GROUP BY 1",
    )
)
def orientation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return planning.orientation_counts(views.source_pages(spark, folder), ["source_id"])


@query(
    sql=with_views(
        ["v_pages"], CLASSIFY,
        select="SELECT source_id, count(*) AS non_a4, count(*) FILTER (adds_margins) AS margins, count(*) FILTER (has_annotations) AS annotated FROM cls JOIN orders ON o_orderkey = source_id WHERE NOT is_a4 AND o_orderkey % 11 <> 0 GROUP BY 1",
    )
)
def page_size_review(spark: SparkSession, folder: str) -> DataFrame:
    selected = views.table(spark, folder, "orders").filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("source_id"))
    return planning.page_size_review(views.source_pages(spark, folder), selected, ["source_id"])
