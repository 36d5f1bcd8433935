"""Workbook sheets: used ranges, print areas, merged cells and print tiles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.ordered import running_max
from casefile.operators.planning import next_fit
from casefile.session import cut_lineage

LEVELS = 20
"""Aligned intervals have up to 2 ** 20 rows, as many as a sheet."""


def used_range(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Corner cells of the used range; a sheet without cells is A1."""
    agg = cells.groupBy("sheet_id").agg(
        F.min("col_no").alias("left_col"), F.min("row_no").alias("top_row"), F.max("col_no").alias("right_col"), F.max("row_no").alias("bottom_row")
    )
    rows = sheets.select("sheet_id").distinct().join(agg, "sheet_id", "left")
    return rows.na.fill(1, ["left_col", "top_row", "right_col", "bottom_row"])


def aligned_intervals(first: Column, last: Column) -> tuple[Column, Column]:
    """(column ``_rows``, expression over it): the rows ``first`` to ``last`` (0 or more) as an array of (level, node): node * 2 ** level to (node + 1) * 2 ** level - 1.

    At most two a level below ``LEVELS``; there as many as the range is long. An empty range has none.
    """
    rows = F.struct(first.cast("long").alias("a"), (last + 1).cast("long").alias("e"))
    span = "named_struct('level', j, 'l', shiftright(x.a + shiftleft(1L, j) - 1, j), 'r', shiftright(x.e, j))"
    odd = (
        f"filter(transform(sequence(0, {LEVELS - 1}), j -> {span}), y -> y.l < y.r)",
        "filter(array(if(y.l % 2 = 1, named_struct('level', y.level, 'node', y.l), null), if(y.r % 2 = 1, named_struct('level', y.level, 'node', y.r - 1), null)), z -> z is not null)",
    )
    top = f"shiftright(x.a + shiftleft(1L, {LEVELS}) - 1, {LEVELS})", f"shiftright(x.e, {LEVELS})"
    whole = f"if({top[0]} < {top[1]}, transform(sequence({top[0]}, {top[1]} - 1), k -> named_struct('level', {LEVELS}, 'node', k)), array())"
    parts = F.expr(f"transform(array(_rows), x -> concat(flatten(transform({odd[0]}, y -> {odd[1]})), {whole}))[0]")
    return rows, parts


def range_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersecting ranges of the same sheet; ``clipped``: the right one is cut by the left one.

    Two ranges share rows exactly if the one begins within the other, and then in one way only. A range is a few aligned
    intervals, whatever its length, and a first row lies in one interval a level: the two meet in an equi-join, each
    pair once.
    """
    corners = ["left_col", "top_row", "right_col", "bottom_row"]

    def named(rows: DataFrame, side: str) -> DataFrame:
        return rows.select("sheet_id", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "sheet_id"])

    def covering(rows: DataFrame, side: str, later: int) -> DataFrame:
        packed, parts = aligned_intervals(F.col(f"{side}_top_row") + later, F.col(f"{side}_bottom_row"))
        return rows.withColumn("_rows", packed).withColumn("_at", F.explode(parts)).drop("_rows")

    def starting(rows: DataFrame, side: str) -> DataFrame:
        at = F.expr(f"transform(sequence(0, {LEVELS}), j -> named_struct('level', j, 'node', shiftright(cast({side}_top_row as bigint), j)))")
        return rows.filter(F.col(f"{side}_top_row") <= F.col(f"{side}_bottom_row")).withColumn("_at", F.explode(at))

    ours, theirs = named(left, "l"), named(right, "r")
    keyed = lambda rows: rows.withColumn("_level", F.col("_at.level")).withColumn("_node", F.col("_at.node")).drop("_at")
    on = ["sheet_id", "_level", "_node"]
    columns = ["sheet_id", *[c for c in ours.columns if c != "sheet_id"], *[c for c in theirs.columns if c != "sheet_id"]]
    begins_inside = keyed(covering(ours, "l", 0)).join(keyed(starting(theirs, "r")), on).select(*columns)
    begins_before = keyed(covering(theirs, "r", 1)).join(keyed(starting(ours, "l")), on).select(*columns)
    pairs = begins_inside.unionByName(begins_before).filter("l_left_col <= r_right_col AND l_right_col >= r_left_col")
    clipped = F.expr(" OR ".join(f"r_{c} {'<' if i < 2 else '>'} l_{c}" for i, c in enumerate(corners)))
    return pairs.withColumn("clipped", clipped)


BAND = 4096
"""Rows or columns whose merged cells a sweep takes in one group."""
SINGLE = 6
"""Turns of one touching cell at a time, cheaper than sweeps, before ranges that still grow are swept."""


def _touched(ranges: DataFrame, merged: DataFrame) -> DataFrame:
    """Ranges grown over the merged cells they touch now."""
    corners = ["left_col", "top_row", "right_col", "bottom_row"]
    hits = range_overlaps(ranges, merged).groupBy("sheet_id").agg(
        *[(F.min if i < 2 else F.max)(f"r_{c}").alias(f"_{c}") for i, c in enumerate(corners)]
    )
    grown = [(F.least if i < 2 else F.greatest)(c, f"_{c}").alias(c) for i, c in enumerate(corners)]
    return ranges.join(hits, "sheet_id", "left").select("sheet_id", *grown)


def _swept(ranges: DataFrame, merged: DataFrame, first: str, last: str, side: str, far: str) -> DataFrame:
    """Ranges grown along one axis (``first`` to ``last``) as far as a chain of merged cells leads.

    Among the cells that share a column (row) with the range, those whose spans follow each other without a gap form
    islands: a span begins one where it starts beyond all ends before it. The range takes in the island it lies on.
    """
    corners = [first, last, side, far]
    own = ranges.select("sheet_id", *corners, F.col(first).alias("_from"))
    span = ranges.select("sheet_id", F.col(first).alias("_from"), F.col(side).alias("_side"), F.col(far).alias("_far"))
    met = merged.join(span, "sheet_id").filter((F.col(side) <= F.col("_far")) & (F.col(far) >= F.col("_side")))
    rows = own.unionByName(met.select("sheet_id", *corners, "_from")).withColumn("_band", F.floor(F.col(first) / BAND))
    rows = cut_lineage(running_max(rows, ["sheet_id"], [first], last, "_reach", ["_band"]))
    begins = rows.filter(F.col("_reach").isNull() | (F.col(first) > F.col("_reach")))
    island = begins.groupBy("sheet_id").agg(
        F.max(F.when(F.col(first) <= F.col("_from"), F.col(first))).alias("_begin"), F.min(F.when(F.col(first) > F.col("_from"), F.col(first))).alias("_next")
    )
    inside = rows.join(island, "sheet_id").filter((F.col(first) >= F.col("_begin")) & F.coalesce(F.col(first) < F.col("_next"), F.lit(True)))
    return inside.groupBy("sheet_id").agg(F.min(first).alias(first), F.max(last).alias(last), F.min(side).alias(side), F.max(far).alias(far))


def expand_ranges(initial: DataFrame, merges: DataFrame) -> DataFrame:
    """Grows each sheet's one range over the merged cells it touches until nothing changes.

    Most sheets settle in the first ``SINGLE`` turns. In later ones a turn sweeps along the rows and then along the columns,
    each for chains of any length at once. Only sheets whose range grew take part in the next turn. So turns grow with the
    changes of direction, not with the merged cells.
    """
    corners = ["left_col", "top_row", "right_col", "bottom_row"]
    active, done = initial.filter("sheet_id is not null").select("sheet_id", *corners), []
    merged = merges.select("sheet_id", *corners).filter(" and ".join(f"{c} is not null" for c in corners))
    for turn in count():
        if turn < SINGLE:
            grown = _touched(active, merged)
        else:
            down = _swept(active, merged, "top_row", "bottom_row", "left_col", "right_col")
            grown = _swept(down, merged, "left_col", "right_col", "top_row", "bottom_row")
        before = active.select("sheet_id", F.struct(*corners).alias("_before"))
        grown = cut_lineage(grown.join(before, "sheet_id").withColumn("_changed", F.struct(*corners) != F.col("_before")))
        done.append(grown.filter("not _changed").select("sheet_id", *corners))
        active = grown.filter("_changed").select("sheet_id", *corners)
        if active.isEmpty():
            break
    result = initial.filter("sheet_id is null").select("sheet_id", *corners)
    for settled in done:
        result = result.unionByName(settled)
    return result


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), lambda a, c: a * 26 + c)


def print_area(raw: Column | str, sheet: Column | str) -> Column:
    """(left_col, top_row, right_col, bottom_row, warning) of a defined print area."""
    text = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    sheet = F.col(sheet) if isinstance(sheet, str) else sheet
    pattern = r"(?i)^(?:'((?:[^']|'')+)'|([^!]+))!\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)$"

    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    owner = F.regexp_replace(F.when(part(1) != "", part(1)).otherwise(part(2)), "''", "'")
    # The warnings.
    warning = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None))
        .when(text.contains(","), "Discontiguous print areas are not supported; select one contiguous area in Excel.")
        .when(~text.rlike(pattern), "Print area is invalid and was not used.")
        .when(owner != sheet, "Print area belongs to another sheet and was not used.")
    )
    good = warning.isNull() & text.rlike(pattern)
    c1, c2 = column_number(part(3)), column_number(part(5))
    r1, r2 = part(4).try_cast("int"), part(6).try_cast("int")
    return F.struct(
        F.when(good, F.least(c1, c2)).alias("left_col"), F.when(good, F.least(r1, r2)).alias("top_row"),
        F.when(good, F.greatest(c1, c2)).alias("right_col"), F.when(good, F.greatest(r1, r2)).alias("bottom_row"), warning.alias("warning"),
    )


def tile_sheets(sheets: DataFrame, heights: DataFrame, widths: DataFrame) -> DataFrame:
    """Print tiles of each sheet: column tiles by count, row tiles by height.

    ``sheets``: sheet_id, left_col, top_row, right_col, bottom_row, title_top, title_bottom
    (null: no title rows). ``heights``: sheet_id, row_no, height. ``widths``: sheet_id,
    col_no, width. Title rows are repeated on later tiles and take their height there.
    """
    cols = sheets.select("sheet_id", F.explode(F.sequence("left_col", "right_col")).alias("col_no"))
    total = cols.join(widths, ["sheet_id", "col_no"], "left").groupBy("sheet_id").agg(F.sum(F.coalesce("width", F.lit(8.43))).alias("total"))
    # 70 characters wide turns the page; 9 or 7 columns; 430 or 675 points high.
    wide = F.round("total", 6) > 70
    base = sheets.join(total.withColumn("landscape", wide), "sheet_id")
    base = base.withColumn("columns", F.when(F.col("landscape"), 9).otherwise(7)).withColumn("budget", F.when(F.col("landscape"), 430.0).otherwise(675.0))

    def clamped(rows: DataFrame) -> DataFrame:
        joined = rows.join(heights, ["sheet_id", "row_no"], "left")
        return joined.withColumn("h", F.greatest(F.lit(15.0), F.least(F.lit(42.0), F.coalesce("height", F.lit(15.0)))))

    titles = base.filter("title_top IS NOT NULL").select("sheet_id", F.explode(F.sequence("title_top", "title_bottom")).alias("row_no"))
    title = clamped(titles).groupBy("sheet_id").agg(F.sum("h").alias("title_height"))
    base = base.join(title, "sheet_id", "left").withColumn("title_height", F.coalesce("title_height", F.lit(0.0)))
    rows = clamped(base.select("sheet_id", "top_row", "budget", "title_height", F.explode(F.sequence("top_row", "bottom_row")).alias("row_no")))
    # heights in shares of the first tile's budget; later tiles open with the title on top. The
    # first tile has no title, so it starts that much below empty.
    rows = rows.withColumn("position", (F.col("row_no") - F.col("top_row") + 1).cast("long"))
    bonus = F.when(F.col("position") == 1, F.lit(0.0)).otherwise(F.col("title_height"))
    rows = rows.withColumn("first", (F.col("h") + bonus) / F.col("budget")).withColumn("later", F.col("h") / F.col("budget"))
    packed = next_fit(rows.select("sheet_id", "row_no", "position", "first", "later"), ["sheet_id"], "position", "first", "later", 1.0)
    bands = packed.groupBy("sheet_id", "container").agg(F.min("row_no").alias("top"), F.max("row_no").alias("bottom"))
    strips = base.select(
        "sheet_id", "landscape", "right_col", "columns",
        F.explode(F.sequence(F.col("left_col"), F.col("right_col"), F.col("columns"))).alias("left"),
    )
    right = F.least(F.col("left") + F.col("columns") - 1, F.col("right_col"))
    return strips.join(bands, "sheet_id").select(
        "sheet_id", F.when(F.col("landscape"), "landscape").otherwise("portrait").alias("orientation"), "left", right.alias("right"), "top", "bottom"
    )
