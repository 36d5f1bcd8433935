"""The two-level order of exhibits and headed sections.

A row is one exhibit: keys, pos (top-level place), section_id, heading, inner_pos, exhibit_id.
An empty section is one row without an exhibit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.ordered import chunk_of, neighbours, number_rows, running_sum
from casefile.session import cut_lineage

MAX_NODES, MAX_ID, MAX_HEADING = 20_000, 1_024, 512


def arrangement_issues(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per issue: keys, issue, subject, times."""
    def bad_id(c: str) -> Column:
        return (F.col(c) == "") | (F.length(c) > MAX_ID) | F.col(c).contains("\0")

    exhibits = nodes.filter("exhibit_id IS NOT NULL").groupBy(*keys, "exhibit_id").agg(F.count(F.lit(1)).alias("n"))
    sections = nodes.filter("section_id IS NOT NULL").select(*keys, "pos", "section_id", "heading").distinct()
    repeated = sections.groupBy(*keys, "section_id").agg(F.count(F.lit(1)).alias("n"))
    heading = F.col("heading")
    bad_heading = heading.isNull() | (F.trim(heading) == "") | (F.length(heading) > MAX_HEADING) | heading.contains("\0")
    top = nodes.select(*keys, "pos").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("top"))
    inner = nodes.groupBy(*keys).agg(F.count_if(F.expr("section_id IS NOT NULL AND exhibit_id IS NOT NULL")).alias("inner"))
    sizes = top.join(inner, keys)

    def issue(rows: DataFrame, text: str, subject: Column, times: Column) -> DataFrame:
        return rows.select(*keys, F.lit(text).alias("issue"), subject.cast("string").alias("subject"), times.cast("long").alias("times"))

    one, nothing = F.lit(1), F.lit(None)
    parts = [
        issue(exhibits.filter("n > 1"), "exhibit occurs more than once", F.col("exhibit_id"), F.col("n") - 1),
        issue(exhibits.filter(bad_id("exhibit_id")), "invalid exhibit id", F.col("exhibit_id"), F.col("n")),
        issue(repeated.filter("n > 1"), "section occurs more than once", F.col("section_id"), F.col("n") - 1),
        issue(sections.filter(bad_id("section_id")), "invalid section id", F.col("pos"), one),
        issue(sections.filter(bad_heading), "invalid section heading", F.col("pos"), one),
        issue(sizes.filter(F.col("top") > MAX_NODES), "too many top-level nodes", nothing, one),
        issue(sizes.filter(F.col("top") + F.col("inner") > MAX_NODES), "too many total nodes", nothing, one),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def flatten_arrangement(nodes: DataFrame, keys: list[str]) -> DataFrame:
    rows = nodes.filter("exhibit_id IS NOT NULL").withColumn("_chunk", chunk_of("pos"))
    rows = rows.withColumn("_inner", chunk_of(F.coalesce("inner_pos", F.lit(1))))
    rows = rows.withColumn("_pos", F.col("pos"))
    flat = number_rows(rows, keys, ["pos", "inner_pos"], "position", ["_chunk", "_pos", "_inner"])
    return flat.drop("_chunk", "_pos", "_inner")


def legacy_order(order: DataFrame, keys: list[str]) -> DataFrame:
    """A flat saved order (keys, position, exhibit_id) as an arrangement without sections."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    return order.select(
        *keys, F.col("position").cast("long").alias("pos"), text.alias("section_id"), text.alias("heading"),
        number.alias("inner_pos"), "exhibit_id",
    )


def _with_containers(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``container``: the place of the section, or the number of sections before an unheaded run."""
    starts = nodes.filter("section_id IS NOT NULL").select(*keys, "pos").distinct()
    top = nodes.select(*keys, "pos").distinct().join(starts.withColumn("_start", F.lit(1)), [*keys, "pos"], "left")
    top = top.withColumn("_start", F.coalesce("_start", F.lit(0))).withColumn("_chunk", chunk_of("pos"))
    top = running_sum(top, keys, ["pos"], F.col("_start").cast("long"), "_run", ["_chunk"]).drop("_chunk", "_start")
    rows = nodes.join(top, [*keys, "pos"])
    label = F.when(F.col("section_id").isNotNull(), F.concat(F.lit("s"), F.col("pos").cast("string")))
    return rows.withColumn("container", F.coalesce(label, F.concat(F.lit("r"), F.col("_run").cast("string")))).drop("_run")


def container_location(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """0-based index and length inside the section or the contiguous unheaded run."""
    rows = _with_containers(nodes.filter("exhibit_id IS NOT NULL OR section_id IS NOT NULL"), keys).filter("exhibit_id IS NOT NULL")
    rows = rows.withColumn("_at", F.coalesce("inner_pos", "pos")).withColumn("_chunk", chunk_of("_at"))
    sizes = rows.groupBy(*keys, "container").agg(
        F.count(F.lit(1)).alias("length"), (F.min("pos") - 1).alias("_start")
    )
    rows = number_rows(rows, [*keys, "container"], ["_at"], "_n", ["_chunk"]).join(sizes, [*keys, "container"])
    headed = F.col("section_id").isNotNull()
    return rows.select(
        *keys, "exhibit_id", "section_id", (F.col("_n") - 1).alias("index"), "length",
        F.when(headed, 0).otherwise(F.col("_start")).alias("top_level_start"), "container", "pos", "inner_pos", "heading",
    )


def renumber(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Dense places from sort keys (``_top``, ``_tie``), one value per node, and (``_inner``, ``_deeper``).

    ``_phase`` separates what stays from what is appended; ``_top`` is a double that keeps
    the old place in its whole part, so that chunks of places bound every window. What shares
    a place is told apart by a whole number in a column of its own, which loses no precision.
    """
    for column in ("_tie", "_deeper"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(0).cast("long"))
    rows = cut_lineage(rows)  # read by both numberings
    node = [*keys, "_phase", "_top", "_tie"]
    tops = rows.groupBy(*node).agg(F.first("section_id", True).alias("_s")).drop("_s")
    tops = tops.withColumn("_chunk", F.floor(F.col("_top") / 65536))
    tops = number_rows(tops, keys, ["_phase", "_top", "_tie"], "pos", ["_phase", "_chunk"]).drop("_chunk")
    base = rows.drop("pos", "inner_pos").withColumn("_held", F.col("exhibit_id").isNotNull())
    base = base.withColumn("_deep", F.floor(F.col("_inner") / 65536))
    inner = running_sum(base, node, ["_inner", "_deeper"], F.col("_held").cast("long"), "inner_pos", ["_deep"])
    placed = inner.join(tops, node)
    in_section = F.col("section_id").isNotNull() & F.col("_held")
    return placed.select(
        *keys, "pos", "section_id", "heading", F.when(in_section, F.col("inner_pos")).alias("inner_pos"), "exhibit_id"
    )


def reconcile_arrangement(
    nodes: DataFrame, ids: DataFrame, keys: list[str], insert_after: DataFrame | None = None
) -> DataFrame:
    """Drops missing exhibits, keeps sections, seats attachments behind their parent, appends the rest.

    ``ids``: keys, ord, exhibit_id. ``insert_after``: keys, exhibit_id, after_id; a parent is
    never itself an attachment.
    """
    ids = ids.select(*keys, F.col("ord").cast("long").alias("ord"), "exhibit_id")
    if insert_after is None:
        ids = ids.withColumn("after_id", F.lit(None).cast("string"))
    else:
        ids = cut_lineage(ids.join(insert_after.select(*keys, "exhibit_id", "after_id"), [*keys, "exhibit_id"], "left"))
    free = ids.filter("after_id IS NULL")
    exhibits = nodes.filter("exhibit_id IS NOT NULL")
    kept = exhibits.join(free.select(*keys, "exhibit_id", "ord"), [*keys, "exhibit_id"])
    place = ["_phase", "_top", "_tie", "_inner", "_deeper", "section_id", "heading"]
    zero = F.lit(0).cast("long")
    kept = kept.select(
        *keys, "exhibit_id", F.lit(-1).cast("long").alias("seated"), F.lit(0).alias("_phase"),
        F.col("pos").cast("double").alias("_top"), zero.alias("_tie"), F.coalesce("inner_pos", F.lit(0)).cast("double").alias("_inner"),
        zero.alias("_deeper"), "section_id", "heading",
    )
    nothing = F.lit(None).cast("string")
    fresh = free.join(exhibits.select(*keys, "exhibit_id"), [*keys, "exhibit_id"], "left_anti").select(
        *keys, "exhibit_id", F.col("ord").alias("seated"), F.lit(1).alias("_phase"), F.col("ord").cast("double").alias("_top"),
        zero.alias("_tie"), F.lit(0.0).alias("_inner"), zero.alias("_deeper"), nothing.alias("section_id"), nothing.alias("heading"),
    )
    # kept, like the children: no join is planned above a union whose parts may still change their partitions
    seats = cut_lineage(kept.unionByName(fresh))
    # a parent that is appended later than its attachment is not there yet: the attachment is appended too
    children = ids.filter("after_id IS NOT NULL").join(
        seats.select(*keys, F.col("exhibit_id").alias("after_id"), "seated", *place), [*keys, "after_id"], "left"
    )
    has_seat = F.coalesce(F.col("seated") < F.col("ord"), F.lit(False))
    headed = has_seat & F.col("section_id").isNotNull()
    children = children.select(
        *keys, "exhibit_id", "seated",
        F.when(has_seat, F.col("_phase")).otherwise(1).alias("_phase"),
        F.when(has_seat, F.col("_top")).otherwise(F.col("ord").cast("double")).alias("_top"),
        # children of one parent follow it in their own order
        F.when(headed, F.col("_tie")).when(has_seat, F.col("ord") + 1).otherwise(0).alias("_tie"),
        F.when(headed, F.col("_inner")).otherwise(0.0).alias("_inner"),
        F.when(headed, F.col("ord") + 1).otherwise(0).alias("_deeper"),
        F.when(has_seat, F.col("section_id")).alias("section_id"), F.when(has_seat, F.col("heading")).alias("heading"),
    )
    rows = seats.unionByName(cut_lineage(children)).drop("seated")
    sections = nodes.filter("section_id IS NOT NULL").select(*keys, "section_id", "heading", "pos").distinct()
    held = rows.filter("section_id IS NOT NULL").select(*keys, "section_id").distinct()
    empty = sections.join(held, [*keys, "section_id"], "left_anti").select(
        *keys, nothing.alias("exhibit_id"), F.lit(0).alias("_phase"), F.col("pos").cast("double").alias("_top"),
        zero.alias("_tie"), F.lit(0.0).alias("_inner"), zero.alias("_deeper"), "section_id", "heading",
    )
    return renumber(rows.unionByName(empty), keys)


def sort_within_sections(
    nodes: DataFrame, attributes: DataFrame, keys: list[str], order_by: Sequence[str], levels: Sequence[str] = ()
) -> DataFrame:
    """Sorts every section and every unheaded run by itself; no exhibit crosses a heading.

    ``attributes``: keys, exhibit_id and the sort columns. ``levels`` as in ``running_sum``.
    """
    slots = container_location(nodes, keys)
    sorted_rows = slots.select(*keys, "container", "exhibit_id").join(attributes, [*keys, "exhibit_id"])
    ranked = number_rows(sorted_rows, [*keys, "container"], [*order_by, "exhibit_id"], "_n", levels)
    ranked = ranked.select(*keys, "container", (F.col("_n") - 1).alias("index"), F.col("exhibit_id"))
    filled = slots.drop("exhibit_id").join(ranked, [*keys, "container", "index"])
    columns = [*keys, "pos", "section_id", "heading", "inner_pos", "exhibit_id"]
    return filled.select(*columns).unionByName(nodes.filter("exhibit_id IS NULL").select(*columns))


def edit_arrangement(nodes: DataFrame, edits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Applies one edit per matter; returns the arrangement and the refused edits.

    ``edits``: keys, action, exhibit_id, section_id, heading, index (0-based, after removal).
    Actions: move (to the top level or into a section), move-section, rename, delete-section,
    add-section (of the one exhibit named, or empty). A refused edit leaves its matter as it is.
    """
    e = edits.select(
        *keys, "action", F.col("exhibit_id").alias("e_exhibit"), F.col("section_id").alias("e_section"),
        F.col("heading").alias("e_heading"), F.col("index").cast("long").alias("e_index"),
    )
    tops = nodes.select(*keys, "pos").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("tops"))
    section = nodes.filter("section_id IS NOT NULL").groupBy(*keys, F.col("section_id").alias("e_section")).agg(
        F.min("pos").alias("s_pos"), F.count("exhibit_id").alias("s_size"), F.min("heading").alias("s_heading")
    )
    exhibit = nodes.filter("exhibit_id IS NOT NULL").select(
        *keys, F.col("exhibit_id").alias("e_exhibit"), F.col("pos").alias("x_pos"), F.col("section_id").alias("x_section"),
        F.col("inner_pos").alias("x_inner"),
    )
    e = e.join(tops, keys).join(section, [*keys, "e_section"], "left").join(exhibit, [*keys, "e_exhibit"], "left")
    action, index = F.col("action"), F.col("e_index")
    x_top = F.col("x_pos").isNotNull() & F.col("x_section").isNull()
    from_own = F.coalesce(F.col("x_section") == F.col("e_section"), F.lit(False))
    good_index = F.coalesce(index >= 0, F.lit(False))
    heading_ok = F.coalesce((F.trim("e_heading") != "") & (F.length("e_heading") <= MAX_HEADING), F.lit(False))
    removed = x_top.cast("int")
    issue = (
        F.when((action == "move") & F.col("x_pos").isNull(), "exhibit is not present")
        .when((action == "move") & F.col("e_section").isNotNull() & F.col("s_pos").isNull(), "section does not exist")
        .when(action.isin("move-section", "rename", "delete-section") & F.col("s_pos").isNull(), "section does not exist")
        .when(action.isin("rename", "add-section") & ~heading_ok, "heading is invalid")
        .when((action == "add-section") & F.col("s_pos").isNotNull(), "section already exists")
        .when((action == "add-section") & F.col("e_exhibit").isNotNull() & F.col("x_pos").isNull(), "exhibit is not present")
        .when(action.isin("move", "move-section", "add-section") & ~good_index, "index is invalid")
        .when((action == "move") & F.col("e_section").isNull() & (index > F.col("tops") - removed), "index is outside")
        .when((action == "move") & F.col("e_section").isNotNull() & (index > F.col("s_size") - from_own.cast("int")), "index is outside")
        .when((action == "move-section") & (index > F.col("tops") - 1), "index is outside")
        .when((action == "add-section") & (index > F.col("tops") - removed), "index is outside")
    )
    e = e.withColumn("issue", issue)
    refused = e.filter("issue IS NOT NULL").select(*keys, "action", "issue")
    good = e.filter("issue IS NULL").drop("issue", "tops")
    rows = nodes.join(good, keys, "left")
    act = F.coalesce("action", F.lit(""))
    is_x = (F.coalesce(F.col("exhibit_id") == F.col("e_exhibit"), F.lit(False))) & act.isin("move", "add-section")
    in_s = F.coalesce(F.col("section_id") == F.col("e_section"), F.lit(False))
    # 0-based place after the moved node is taken out
    gone = F.when(act.isin("move", "add-section") & F.col("x_section").isNull() & (F.col("pos") > F.col("x_pos")), 1).when(
        (act == "move-section") & (F.col("pos") > F.col("s_pos")), 1
    ).otherwise(0)
    top = (F.col("pos") - 1 - gone).cast("double")
    s_top = (F.col("s_pos") - 1 - F.when(F.col("x_section").isNull() & (F.col("s_pos") > F.col("x_pos")), 1).otherwise(0)).cast("double")
    before = F.col("e_index") - 0.5
    to_section = F.col("e_section").isNotNull()
    new_top = (
        F.when(is_x & (act == "move") & to_section, s_top)
        .when(is_x, before)
        .when((act == "move-section") & in_s, before)
        .otherwise(top)
    )
    # the exhibits of a deleted section stand where it stood, in their order
    new_tie = F.when((act == "delete-section") & in_s, F.coalesce("inner_pos", F.lit(0)).cast("long")).otherwise(0)
    inner = F.coalesce("inner_pos", F.lit(1)).cast("double") - 1
    inner = inner - F.when((act == "move") & (F.col("section_id") == F.col("x_section")) & (F.col("inner_pos") > F.col("x_inner")), 1).otherwise(0)
    new_inner = F.when(is_x & (act == "move") & to_section, before).when(is_x, F.lit(0.0)).otherwise(inner)
    new_section = (
        F.when(is_x, F.col("e_section")).when((act == "delete-section") & in_s, F.lit(None)).otherwise(F.col("section_id"))
    )
    new_heading = (
        F.when(is_x & (act == "move"), F.when(to_section, F.col("s_heading")))
        .when(is_x | ((act == "rename") & in_s), F.col("e_heading"))
        .when((act == "delete-section") & in_s, F.lit(None))
        .otherwise(F.col("heading"))
    )
    nothing = F.lit(None).cast("string")
    changed = rows.select(
        *keys, "exhibit_id", F.lit(0).alias("_phase"), new_top.cast("double").alias("_top"), new_tie.alias("_tie"), new_inner.cast("double").alias("_inner"),
        new_section.cast("string").alias("section_id"), new_heading.cast("string").alias("heading"),
    ).filter("exhibit_id IS NOT NULL OR section_id IS NOT NULL")
    added = good.filter("action = 'add-section' AND e_exhibit IS NULL").select(
        *keys, nothing.alias("exhibit_id"), F.lit(0).alias("_phase"), (F.col("e_index") - 0.5).alias("_top"), F.lit(0).cast("long").alias("_tie"), F.lit(0.0).alias("_inner"),
        F.col("e_section").alias("section_id"), F.col("e_heading").alias("heading"),
    )
    # a section that lost its only exhibit stays, as an empty one
    emptied = good.filter(
        "action IN ('move', 'add-section') AND x_section IS NOT NULL AND NOT coalesce(x_section = e_section, false)"
    ).select(*keys, F.col("x_section").alias("section_id"), F.col("x_pos").alias("_old"))
    lost = nodes.filter("section_id IS NOT NULL").groupBy(*keys, "section_id").agg(
        F.count("exhibit_id").alias("_n"), F.min("heading").alias("heading")
    ).filter("_n = 1")
    emptied = emptied.join(lost, [*keys, "section_id"]).select(
        *keys, nothing.alias("exhibit_id"), F.lit(0).alias("_phase"), (F.col("_old") - 1).cast("double").alias("_top"), F.lit(0).cast("long").alias("_tie"),
        F.lit(0.0).alias("_inner"), "section_id", "heading",
    )
    return renumber(changed.unionByName(added).unionByName(emptied), keys), refused


def add_sections(nodes: DataFrame, sections: DataFrame, members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Puts a new section around several exhibits of each matter; returns the arrangement and the refused sections.

    ``sections``: keys, section_id, heading, index (0-based, after the exhibits are taken out), one a matter. ``members``:
    keys, exhibit_id; none makes an empty section. Exhibits keep the order they have; a section that loses all of its own
    stays, as an empty one. A refused section leaves its matter as it is.
    """
    place = [*keys, "exhibit_id"]
    chosen = members.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    present = nodes.filter("exhibit_id IS NOT NULL").select(*place, F.lit(True).alias("_present")).distinct()
    faults = chosen.join(present, place, "left").groupBy(*keys).agg(F.max("_n").alias("_most"), F.count_if(F.col("_present").isNull()).alias("_absent"))
    rows = nodes.join(chosen, place, "left").withColumn("_chosen", F.col("_n").isNotNull()).drop("_n")
    alone = F.col("section_id").isNull()
    room = rows.filter(~(F.col("_chosen") & alone)).select(*keys, "pos").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_room"))
    taken = nodes.filter("section_id IS NOT NULL").select(*keys, "section_id", F.lit(True).alias("_taken")).distinct()
    e = sections.select(*keys, "section_id", "heading", F.col("index").cast("long").alias("index"))
    e = e.join(taken, [*keys, "section_id"], "left").join(faults, keys, "left").join(room, keys, "left")
    named = (F.col("section_id") != "") & (F.length("section_id") <= MAX_ID) & (F.trim("heading") != "") & (F.length("heading") <= MAX_HEADING)
    issue = (
        F.when(~F.coalesce(named, F.lit(False)), "section id or heading is invalid")
        .when(~F.coalesce(F.col("index") >= 0, F.lit(False)), "index is invalid")
        .when(F.col("_taken"), "section already exists")
        .when(F.col("_most") > 1, "exhibit is selected more than once")
        .when(F.col("_absent") > 0, "exhibit is not present")
        .when(F.col("index") > F.coalesce("_room", F.lit(0)), "index is outside")
    )
    e = e.withColumn("issue", issue)
    good = e.filter("issue IS NULL").select(*keys, F.col("section_id").alias("_new"), F.col("heading").alias("_name"), (F.col("index") - 0.5).alias("_at"))
    # read five times below
    good = cut_lineage(good)
    rows = cut_lineage(rows.join(good, keys, "left").withColumn("_moved", F.col("_chosen") & F.col("_new").isNotNull()))
    tops = rows.filter(~(F.col("_moved") & alone)).select(*keys, "pos").distinct().withColumn("_chunk", chunk_of("pos"))
    tops = number_rows(tops, keys, ["pos"], "_rank", ["_chunk"]).select(*keys, "pos", (F.col("_rank") - 1).cast("double").alias("_top"))
    nothing = F.lit(None).cast("string")

    def shape(df: DataFrame, exhibit: Column, top: str, inner: Column, deeper: Column, section: str, heading: str) -> DataFrame:
        return df.select(
            *keys, exhibit.alias("exhibit_id"), F.lit(0).alias("_phase"), F.col(top).cast("double").alias("_top"), inner.cast("double").alias("_inner"),
            deeper.cast("long").alias("_deeper"), F.col(section).alias("section_id"), F.col(heading).alias("heading"),
        )

    zero, inner = F.lit(0), F.coalesce("inner_pos", F.lit(0))
    stay = shape(rows.filter(~F.col("_moved")).join(tops, [*keys, "pos"]), F.col("exhibit_id"), "_top", inner, zero, "section_id", "heading")
    inside = shape(rows.filter("_moved"), F.col("exhibit_id"), "_at", F.col("pos"), inner, "_new", "_name")
    bare = shape(good.join(members.select(*keys).distinct(), keys, "left_anti"), nothing, "_at", zero, zero, "_new", "_name")
    lost = rows.filter("section_id IS NOT NULL").groupBy(*keys, "pos", "section_id").agg(F.min("heading").alias("heading"), F.min("_moved").alias("_all"))
    lost = shape(lost.filter("_all").join(tops, [*keys, "pos"]), nothing, "_top", zero, zero, "section_id", "heading")
    placed = renumber(stay.unionByName(inside).unionByName(bare).unionByName(lost), keys)
    return placed, e.filter("issue IS NOT NULL").select(*keys, "section_id", "issue")


def reorder_for_drop(items: DataFrame, drops: DataFrame, keys: list[str]) -> DataFrame:
    """One drag per matter in a flat list: moving down lands behind the target, moving up before it."""
    at = items.select(*keys, F.col("item_id").alias("moved_id"), F.col("position").alias("_from"))
    to = items.select(*keys, F.col("item_id").alias("target_id"), F.col("position").alias("_to"))
    d = drops.filter("moved_id <> target_id").join(at, [*keys, "moved_id"]).join(to, [*keys, "target_id"])
    rows = items.join(d.select(*keys, "_from", "_to"), keys, "left")
    p, a, b = F.col("position"), F.col("_from"), F.col("_to")
    place = (
        F.when(a.isNull(), p).when(p == a, b).when((p > a) & (p <= b), p - 1).when((p < a) & (p >= b), p + 1).otherwise(p)
    )
    return rows.select(*keys, "item_id", place.alias("position"))


def index_rows(nodes: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the printed index: a heading before its exhibits; empty sections are left out.

    ``records``: keys, exhibit_id, exhibit_number, description, date_text, label_start,
    label_end, volume, multi_volume. ``group_break`` marks the first unheaded exhibit after a section.
    """
    filled = nodes.filter("exhibit_id IS NOT NULL")
    flat = flatten_arrangement(filled, keys)
    flat = neighbours(flat, keys, "position", ["section_id"])
    rows = flat.join(records, [*keys, "exhibit_id"])
    same = F.col("label_start") == F.col("label_end")
    span = F.when(same, F.col("label_start")).otherwise(F.concat("label_start", F.lit("-"), "label_end"))
    label = F.when(
        F.col("multi_volume"), F.concat(F.lit("Vol. "), F.coalesce("volume", F.lit(1)).cast("string"), F.lit(" / "), span)
    ).otherwise(span)
    breaks = F.col("section_id").isNull() & F.col("prev_section_id").isNotNull()
    exhibits = rows.select(
        *keys, (F.col("position") * 2).alias("row_order"), F.lit("exhibit").alias("kind"),
        F.concat(F.lit("exhibit:"), "exhibit_id").alias("row_id"), F.col("exhibit_number").cast("string").alias("exhibit_label"),
        F.col("description").alias("title"), label.alias("page_label"), breaks.alias("group_break"),
    )
    heads = flat.filter("inner_pos = 1").select(
        *keys, (F.col("position") * 2 - 1).alias("row_order"), F.lit("section").alias("kind"),
        F.concat(F.lit("section:"), "section_id").alias("row_id"), F.lit(None).cast("string").alias("exhibit_label"),
        F.col("heading").alias("title"), F.lit(None).cast("string").alias("page_label"), F.lit(False).alias("group_break"),
    )
    return exhibits.unionByName(heads)
