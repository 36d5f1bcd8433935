"""Volumes, page numbers and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import text as T
from casefile.functions.ordered import CHUNK, chunk_of, cluster_sorted, number_rows, running_sum
from casefile.functions.scan import FAN, STEPS, entries, shortened
from casefile.session import cut_lineage

A4_WIDTH, A4_HEIGHT = 595.28, 841.89


def _chain(opening: np.ndarray, added: np.ndarray, capacity: float) -> tuple[np.ndarray, np.ndarray]:
    """For a container opened at each row: the row that opens the next one, and its fill there."""
    n = len(opening)
    prefix = np.concatenate([[0.0], np.cumsum(added)])
    # container opened at j holds rows j..k-1 while opening[j] + prefix[k] - prefix[j + 1] <= capacity
    reach = capacity - opening + prefix[1:] + 1e-9
    following = np.searchsorted(prefix, reach, side="right") - 1
    return np.clip(np.maximum(following, np.arange(n) + 1), 1, n), prefix


def _transfer(frame: pd.DataFrame, capacity: float) -> pd.DataFrame:
    """What a chunk does to the fill it is entered with, as steps: enter fill up to ``upto`` -> result.

    With fill u the first row that does not fit opens a container; everything after that
    row is independent of u. Rows where u still fits to the end add to the fill instead.
    """
    opening, added = frame["opening"].to_numpy(float), frame["added"].to_numpy(float)
    following, prefix = _chain(opening, added, capacity)
    n = len(opening)
    count, final = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1)
    for j in range(n - 1, -1, -1):
        k = following[j]
        if k >= n:
            count[j], final[j] = 1, opening[j] + prefix[n] - prefix[j + 1]
        else:
            count[j], final[j] = count[k] + 1, final[k]
    rows = [(capacity - prefix[n] + 1e-9, 0, prefix[n], True)]
    for j in range(n - 1, -1, -1):  # break at j: u in (capacity - prefix[j+1], capacity - prefix[j]]
        upto = capacity - prefix[j] + 1e-9 if j else np.inf
        if rows[-1][1] == count[j] and rows[-1][2] == final[j] and not rows[-1][3]:
            rows[-1] = (upto, *rows[-1][1:])
        else:
            rows.append((upto, int(count[j]), float(final[j]), False))
    short = shortened([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
    return pd.DataFrame([{**short, "whole_count": int(count[0]), "whole_fill": float(final[0])}])


def next_fit(
    items: DataFrame, keys: list[str], position: str, opening: str, added: str, capacity: float | str, size: int = CHUNK, fan: int = FAN
) -> DataFrame:
    """Next-fit packing in order: adds ``container`` (1-based) and ``used`` (fill before the row).

    ``opening`` is a row's weight as the first of a container, ``added`` its weight after
    another row; an item is never split. ``position`` is dense per key. ``capacity`` is a
    number, or a column with one value per key. Long key groups are packed chunk by chunk in
    parallel: a first pass condenses every chunk to the step function "fill on entry ->
    containers opened, fill at the end", a scan over these (``scan.entries``) tells the entry
    of every chunk, and a last pass packs every chunk from it. A step function has no more
    pieces than the first container of its chunk has items.
    """
    data = items.withColumn("_chunk", chunk_of(position, size)).withColumn("_capacity", F.col(capacity).cast("double") if isinstance(capacity, str) else F.lit(float(capacity)))
    types = dict(data.dtypes)
    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    group = [*keys, "_chunk"]
    long_keys = data.filter("_chunk > 0").select(*keys).distinct()
    slim = data.select(*group, "_capacity", F.col(position).alias("at"), F.col(opening).cast("double").alias("opening"), F.col(added).cast("double").alias("added"))

    def condense(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _transfer(frame.sort_values("at"), float(frame["_capacity"].iloc[0]))
        for place, name in enumerate(group):
            out.insert(place, name, key[place])
        return out

    steps = slim.join(long_keys, keys, "left_semi").groupBy(*group).applyInPandas(condense, f"{key_types}, _chunk long, {STEPS}")
    known = data.join(entries(steps, keys, "_chunk", fan), group, "left").withColumn("before", F.coalesce("before", F.lit(0)))
    known = known.withColumn("opening__", F.col(opening).cast("double")).withColumn("added__", F.col(added).cast("double"))
    packed_type = ", ".join(f"`{c}` {t}" for c, t in data.dtypes if c not in ("_chunk", "_capacity")) + ", container long, used double"
    columns = [c for c in data.columns if c not in ("_chunk", "_capacity")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by (keys, chunk, position); only the open container is remembered
        current, number, fill = None, 0, None
        for frame in batches:
            numbers, fills = [], []
            names = zip(*[frame[g].tolist() for g in group])
            for name, first, later, entered, before, most in zip(
                names, frame["opening__"].tolist(), frame["added__"].tolist(), frame["entered"].tolist(), frame["before"].tolist(), frame["_capacity"].tolist()
            ):
                if name != current:
                    current, number, fill = name, int(before), None if entered != entered or entered is None else entered
                if fill is None or fill + later > most + 1e-9:
                    number, used, fill = number + 1, 0.0, first
                else:
                    used, fill = fill, fill + later
                numbers.append(number)
                fills.append(used)
            yield frame[columns].assign(container=numbers, used=fills)

    return cluster_sorted(known, group, position).mapInPandas(pack, packed_type)


def plan_volumes(items: DataFrame, keys: list[str], limit: int, position: str = "position", pages: str = "pages") -> DataFrame:
    """Volumes of at most ``limit`` pages; an exhibit is never split; no limit: one volume."""
    weight = F.greatest(F.lit(1), F.col(pages))
    if limit <= 0:
        rows = items.withColumn("volume", F.lit(1).cast("long")).withColumn("item_pages", F.greatest(F.lit(0), F.col(pages)))
        totals = rows.groupBy(*keys, "volume").agg(F.sum("item_pages").alias("volume_pages"))
        return rows.join(totals, [*keys, "volume"]).withColumn("oversize", F.lit(False))
    rows = items.withColumn("item_pages", weight)
    packed = next_fit(rows, keys, position, "item_pages", "item_pages", limit)
    packed = packed.withColumnRenamed("container", "volume").drop("used")
    totals = packed.groupBy(*keys, "volume").agg(F.sum("item_pages").alias("volume_pages"))
    joined = packed.join(totals, [*keys, "volume"])
    return joined.withColumn("oversize", F.col("volume_pages") > limit)


def build_plan(
    items: DataFrame, keys: list[str], page_limit: int = 0, cover_pages: int = 1, index_pages: int | str = 1,
    count_optional: bool = False, match_pdf_order: bool = False, continuous: bool = True, start_at: int = 1,
) -> DataFrame:
    """Physical and reference pages of every exhibit.

    ``items``: keys, position (dense), item_id, physical_pages, optional_pages, content_pages.
    Cover and complete index are repeated in each volume and count towards the limit.
    ``index_pages`` is a number, or a column of ``items`` with one value per key.
    """
    varying = isinstance(index_pages, str)
    rows = items.withColumn("_overhead", F.lit(max(1, cover_pages)) + (F.col(index_pages) if varying else F.lit(index_pages)))
    if page_limit > 0:
        room = F.lit(page_limit) - F.col("_overhead")
        rows = next_fit(rows.withColumn("_room", room), keys, "position", "physical_pages", "physical_pages", "_room")
        rows = rows.withColumnRenamed("container", "volume").drop("used", "_room")
    else:
        rows = rows.withColumn("volume", F.lit(1).cast("long"))
    counted = F.when(F.lit(count_optional), F.col("optional_pages")).otherwise(0)
    rows = cut_lineage(rows.withColumn("_reference", F.col("content_pages") + counted).withColumn("_chunk", chunk_of("position")))
    volumes = rows.groupBy(*keys, "volume").agg(
        F.sum("physical_pages").alias("exhibit_pages"), F.sum("_reference").alias("reference_pages"), F.max("_overhead").alias("_before_exhibits")
    )
    volumes = volumes.withColumn("total_pages", F.col("exhibit_pages") + F.col("_before_exhibits")).withColumn("_vc", chunk_of("volume"))
    volumes = running_sum(volumes, keys, ["volume"], "total_pages", "_pdf_before", ["_vc"], exclusive=True)
    volumes = running_sum(volumes, keys, ["volume"], "reference_pages", "_ref_before", ["_vc"], exclusive=True).drop("_vc")
    volumes = volumes.withColumn("oversize", (F.lit(page_limit) > 0) & (F.col("total_pages") > page_limit))
    own = [*keys, "volume"]
    rows = running_sum(rows, own, ["position"], "physical_pages", "_earlier", ["_chunk"], exclusive=True)
    rows = running_sum(rows, own, ["position"], "_reference", "_ref_earlier", ["_chunk"], exclusive=True)
    rows = rows.join(volumes, own)
    start = F.col("_before_exhibits") + 1 + F.col("_earlier")
    content_start = start + F.col("optional_pages")
    if match_pdf_order:
        legal = content_start + (F.col("_pdf_before") if continuous else F.lit(0))
    else:
        legal = F.lit(max(1, start_at)) + F.col("_ref_earlier") + counted + (F.col("_ref_before") if continuous else F.lit(0))
    return rows.select(
        *keys, "item_id", "position", "volume",
        start.cast("long").alias("physical_start"), content_start.cast("long").alias("content_start"),
        (start + F.col("physical_pages") - 1).cast("long").alias("physical_end"),
        legal.cast("long").alias("legal_start"), (legal + F.col("content_pages") - 1).cast("long").alias("legal_end"),
        "total_pages", "oversize",
    )


PASSES = 16
NOT_STABLE = "Index and volume planning did not converge to a stable page count."
TOO_MANY_PASSES = "Index and volume planning exceeded the 16-pass convergence safety limit."


def converged_plan(
    items: DataFrame, nodes: DataFrame, details: DataFrame, keys: list[str], height: Column, page_height: float,
    page_limit: int, row_gap: float = 0.0, break_gap: float = 0.0, passes: int = PASSES, **options: object,
) -> tuple[DataFrame, DataFrame]:
    """Volumes and index planned until they agree. Returns (plan rows with ``index_pages`` and ``passes``, problems).

    The index is repeated in every volume, so its pages decide what a volume holds; the volumes decide the page labels,
    and these how high the rows of the index are. ``items`` as for ``build_plan``, ``nodes`` the arrangement, ``details``
    (keys, item_id, exhibit_number, description, date_text) what the index tells of an exhibit, ``height`` an expression
    over its rows (kind, title, page_label, ...). ``options`` go to ``build_plan``.

    A pass plans, lays out and counts; it carries only the matters that have not settled. A matter whose page count comes
    back to one it has had before goes round in a circle and is a problem, as is one still open after ``passes``, and one
    whose index has a row that fits no page.
    """
    from casefile.operators.arrangement import index_rows

    open_ = cut_lineage(items.select(*keys).distinct().select(*keys, F.lit(1).cast("long").alias("index_pages"), F.array(F.lit(1).cast("long")).alias("_seen")))
    settled, problems = [], []
    for number in range(1, passes + 1):
        rows = items.join(open_.select(*keys, "index_pages"), keys)
        plan = cut_lineage(build_plan(rows, keys, page_limit, index_pages="index_pages", **options))
        several = plan.groupBy(*keys).agg((F.max("volume") > 1).alias("multi_volume"))
        records = plan.join(several, keys).join(details, [*keys, "item_id"]).select(
            *keys, F.col("item_id").alias("exhibit_id"), "exhibit_number", "description", "date_text",
            F.col("legal_start").cast("string").alias("label_start"), F.col("legal_end").cast("string").alias("label_end"), "volume", "multi_volume",
        )
        index = index_rows(nodes.join(open_.select(*keys), keys, "left_semi"), records, keys).withColumn("height", height)
        index = index.withColumn("_chunk", chunk_of("row_order"))
        index = cut_lineage(number_rows(index, keys, ["row_order"], "position", ["_chunk"]))
        placed, errors = paginate_rows(index.select(*keys, "position", "row_id", "kind", "group_break", "height"), keys, page_height, row_gap, break_gap)
        bad = cut_lineage(errors.groupBy(*keys).agg(F.min("problem").alias("problem")))
        counts = placed.groupBy(*keys).agg(F.max("page").alias("_pages"))
        state = cut_lineage(open_.join(bad, keys, "left").join(counts, keys, "left").withColumn("_pages", F.coalesce("_pages", F.lit(1))))
        done = state.filter("problem IS NULL AND _pages = index_pages")
        settled.append(plan.join(done.select(*keys, "index_pages"), keys).withColumn("passes", F.lit(number)))
        again = state.filter("problem IS NULL AND _pages <> index_pages")
        round_ = F.array_contains("_seen", F.col("_pages"))
        problems += [state.filter("problem IS NOT NULL").select(*keys, "problem"), again.filter(round_).select(*keys, F.lit(NOT_STABLE).alias("problem"))]
        open_ = cut_lineage(again.filter(~round_).select(*keys, F.col("_pages").alias("index_pages"), F.concat("_seen", F.array("_pages")).alias("_seen")))
        if open_.isEmpty():
            break
    problems.append(open_.select(*keys, F.lit(TOO_MANY_PASSES).alias("problem")))
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[:-1]).unionByName(parts[-1])
    return union(settled), union(problems)


def bundle_identity(items: DataFrame, keys: list[str]) -> DataFrame:
    mark = F.concat(F.upper(F.regexp_replace("initials", r"\s+", "")), F.lit(" "), F.col("sequence").cast("string"))
    agg = items.groupBy(*keys).agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    return agg.select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("Exhibit Bundle").alias("identity"))


def allocate_bundle_pages(groups: DataFrame, keys: list[str], count_optional: bool = False) -> DataFrame:
    """Page range of each exhibit inside its own bundle. ``groups``: keys, bundle_mark, position, pages."""
    optional = F.when(F.lit(count_optional), F.col("optional_pages")).otherwise(0)
    rows = groups.withColumn("_len", F.col("content_pages") + optional).withColumn("_chunk", chunk_of("position"))
    rows = running_sum(rows, [*keys, "bundle_mark"], ["position"], F.col("_len").cast("long"), "_end", ["_chunk"])
    start = F.col("_end") - F.col("content_pages") + 1
    return rows.withColumn("page_start_in_bundle", start).withColumn("page_end_in_bundle", F.col("_end")).drop("_len", "_chunk", "_end")


def segment_ranges(members: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of the distinct documents of an exhibit, for every member.

    ``members``: keys, group_id, seq, sha256, pages. The first member of a hash sets its place.
    """
    firsts = members.groupBy(*keys, "group_id", "sha256").agg(
        F.min("seq").alias("seq"), F.min_by("pages", "seq").cast("long").alias("pages")
    )
    firsts = firsts.withColumn("_chunk", chunk_of("seq"))
    firsts = running_sum(firsts, [*keys, "group_id"], ["seq"], "pages", "range_end", ["_chunk"])
    ranges = firsts.select(*keys, "group_id", "sha256", (F.col("range_end") - F.col("pages") + 1).alias("range_start"), "range_end")
    return members.drop("pages").join(ranges, [*keys, "group_id", "sha256"])


def page_labels(
    items: DataFrame, volumes: DataFrame, keys: list[str], scheme: str = "bundle", prefix: str = "", suffix: str = "",
    padding: int = 0, preliminary: str = "arabic", count_templates: bool = True, match_pdf_order: bool = False,
    count_optional: bool = True, start_at: int = 1, number_offset: Column | None = None, first_content: int = 3,
    preliminary_offset: Column | None = None,
) -> DataFrame:
    """One label per page of every volume.

    ``items`` is a build plan (keys, volume, physical_start, content_start, physical_end,
    content_before, mark); ``volumes``: keys, volume, total_pages. Pages are generated from
    the items themselves, so no interval join is needed.
    """
    offset = number_offset if number_offset is not None else F.lit(0)
    front_offset = preliminary_offset if preliminary_offset is not None else F.lit(0)

    def padded(number: Column) -> Column:
        digits = number.cast("string")
        return F.lpad(digits, padding, "0") if padding else digits

    def dress(number: Column) -> Column:
        return F.concat(F.lit(prefix), padded(number), F.lit(suffix))

    front = volumes.select(*keys, "volume", F.explode(F.sequence(F.lit(1), F.lit(first_content - 1))).alias("page"))
    if match_pdf_order:
        front_label = dress(F.col("page") + offset)
    elif not count_templates or preliminary == "none":
        front_label = F.lit("")
    else:
        number = F.col("page") + front_offset
        front_label = T.roman(number) if preliminary == "roman" else number.cast("string")
    pages = items.select("*", F.explode(F.sequence("physical_start", "physical_end")).alias("page"))
    in_content = F.col("page") >= F.col("content_start")
    if match_pdf_order:
        label = dress(F.col("page") + offset)
    else:
        ordinal = F.col("page") - first_content if count_optional else F.col("content_before") + F.col("page") - F.col("content_start")
        number = F.lit(start_at) + offset + ordinal
        label = F.concat(F.regexp_replace("mark", r"\s+", ""), F.lit("-"), padded(number)) if scheme == "section" else dress(number)
        if not count_optional:
            label = F.when(in_content, label).otherwise("")
    return front.select(*keys, "volume", "page", front_label.alias("label")).unionByName(
        pages.select(*keys, "volume", "page", label.alias("label"))
    )


def volume_reference(bundle: Column, volume: Column, start: Column, end: Column, multi_volume: Column) -> Column:
    span = F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    named = F.concat(bundle, F.lit("/Vol. "), volume.cast("string"), F.lit("/"), span)
    return F.when(multi_volume | (volume > 1), named).otherwise(F.concat(bundle, F.lit("/"), span))


def statement_suggestions(references: DataFrame, uncited: DataFrame, keys: list[str]) -> DataFrame:
    """Suggested reference lines: cited ones by paragraph, then the uncited block under its own header.

    ``references``: keys, reference_id, paragraph, initials, sequence, page_start, page_end,
    label_start, label_end, requested_start, requested_end, volume, multi_volume.
    ``uncited``: keys, exhibit_number, description, page_start, page_end, label_start,
    label_end, volume, multi_volume. Order the result by (block, line_order, reference_id).
    """
    def span(start: str, end: str) -> Column:
        s, e = F.col(start).cast("string"), F.col(end).cast("string")
        return F.when(s == e, s).otherwise(F.concat(s, F.lit("-"), e))

    text = F.lit(None).cast("string")
    initials = F.coalesce(F.regexp_replace("initials", r"\s+", ""), F.lit(""))
    sequence = F.coalesce(F.col("sequence"), F.lit(0))
    named = (sequence != 0) & (initials != "")
    exhibit = F.when(named, F.concat(initials, sequence.cast("string"))).otherwise("citation")
    valid_pages = F.coalesce((F.col("page_start") >= 1) & (F.col("page_end") >= F.col("page_start")), F.lit(False))
    numeric = F.when(valid_pages, span("page_start", "page_end"))
    labelled = (F.coalesce("label_start", F.lit("")) != "") & (F.coalesce("label_end", F.lit("")) != "")
    shown = F.when(labelled, span("label_start", "label_end")).otherwise(numeric)
    volume = F.when(F.col("multi_volume"), F.concat(F.lit("Vol. "), F.coalesce("volume", F.lit(1)).cast("string"), F.lit("/"))).otherwise("")
    paragraph_ok = F.coalesce(F.col("paragraph") > 0, F.lit(False))
    wanted = F.when(F.col("requested_start").isNotNull() & F.col("requested_end").isNotNull(), span("requested_start", "requested_end"))
    conflict = F.coalesce(wanted != numeric, F.lit(False))
    review = conflict | shown.isNull() | ~named | ~paragraph_ok
    where = F.when(paragraph_ok, F.concat(F.lit("Paragraph "), F.col("paragraph").cast("string"))).otherwise("Statement paragraph")
    line = (
        F.when(conflict, F.concat(where, F.lit(" - ["), exhibit, F.lit("/"), volume, shown, F.lit("] (requested "), wanted, F.lit("; review)")))
        .when(review, F.concat(where, F.lit(" - ["), exhibit, F.lit("/xx]")))
        .otherwise(F.concat(where, F.lit(" - ["), exhibit, F.lit("/"), volume, shown, F.lit("]")))
    )
    cited = references.select(
        *keys, F.lit(1).alias("block"),
        F.when(paragraph_ok, F.col("paragraph")).otherwise(F.lit(2**62)).cast("long").alias("line_order"), "reference_id",
        F.when(paragraph_ok, F.col("paragraph")).cast("long").alias("paragraph"), exhibit.alias("exhibit"), shown.alias("page_range"),
        line.alias("line"), review.alias("needs_review"),
    )
    has_numeric = F.col("page_start").isNotNull() & F.col("page_end").isNotNull()
    pages = F.when(labelled, span("label_start", "label_end")).when(has_numeric, span("page_start", "page_end"))
    single = F.when(labelled, F.col("label_start") == F.col("label_end")).otherwise(~F.coalesce(pages.contains("-"), F.lit(False)))
    encodes = F.coalesce(
        F.concat_ws(" ", pages, "label_start", "label_end").rlike(r"(?i)Vol\.\s*\d+"), F.lit(False)
    )
    part = F.when(F.col("multi_volume") & ~encodes, F.concat(F.lit("Vol. "), F.coalesce("volume", F.lit(1)).cast("string"), F.lit(", "))).otherwise("")
    place = F.when(pages.isNotNull(), F.concat(part, F.when(single, "page ").otherwise("pages "), pages)).otherwise(F.regexp_replace(part, ", $", ""))
    head = F.concat(F.col("exhibit_number").cast("string"), F.lit(". "), "description")
    loose = uncited.select(
        *keys, F.lit(3).alias("block"), F.col("exhibit_number").cast("long").alias("line_order"), text.alias("reference_id"),
        F.lit(None).cast("long").alias("paragraph"), F.col("exhibit_number").cast("string").alias("exhibit"), pages.alias("page_range"),
        F.when(place == "", head).otherwise(F.concat(head, F.lit(" — "), place)).alias("line"), F.lit(False).alias("needs_review"),
    )
    header = uncited.select(*keys).distinct().select(
        *keys, F.lit(2).alias("block"), F.lit(0).cast("long").alias("line_order"), text.alias("reference_id"),
        F.lit(None).cast("long").alias("paragraph"), F.lit("").alias("exhibit"), text.alias("page_range"),
        F.lit("Uncited exhibits — no statement reference").alias("line"), F.lit(False).alias("needs_review"),
    )
    return cited.unionByName(header).unionByName(loose)


def classify_pages(pages: DataFrame) -> DataFrame:
    """Orientation, A4 test, margin test and size limits of measured pages."""
    width, height = F.col("width"), F.col("height")
    landscape = width > height
    target_w = F.when(landscape, A4_HEIGHT).otherwise(A4_WIDTH)
    target_h = F.when(landscape, A4_WIDTH).otherwise(A4_HEIGHT)
    is_a4 = (F.abs(width - target_w) < 2) & (F.abs(height - target_h) < 2)
    ratio = width / F.greatest(F.lit(1.0), height)
    unsafe = (width > 10_000) | (height > 10_000) | (width * height > 25_000_000)
    return (
        pages.withColumn("orientation", F.when(landscape, "landscape").otherwise("portrait"))
        .withColumn("is_a4", is_a4)
        .withColumn("adds_margins", ~is_a4 & (F.abs(ratio - target_w / target_h) > 0.01))
        .withColumn("unsafe", unsafe)
    )


def orientation_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Portrait, landscape and other pages of finished volumes (tolerance 0.02 points)."""
    turned = F.pmod("rotation", F.lit(360)).isin(90, 270)
    width = F.when(turned, F.col("height")).otherwise(F.col("width"))
    height = F.when(turned, F.col("width")).otherwise(F.col("height"))
    portrait = (F.abs(width - A4_WIDTH) < 0.02) & (F.abs(height - A4_HEIGHT) < 0.02)
    landscape = (F.abs(width - A4_HEIGHT) < 0.02) & (F.abs(height - A4_WIDTH) < 0.02)
    return pages.groupBy(*keys).agg(
        F.count_if(portrait).alias("portrait"), F.count_if(landscape).alias("landscape"),
        F.count_if(~portrait & ~landscape).alias("non_a4"),
    )


def page_size_review(pages: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Selected sources with pages that are not A4, with margin and annotation counts."""
    rows = classify_pages(pages).filter("NOT is_a4").join(selected.select(*keys).distinct(), keys, "left_semi")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("non_a4"), F.count_if("adds_margins").alias("margins"), F.count_if("has_annotations").alias("annotated")
    )


def paginate_rows(
    rows: DataFrame, keys: list[str], capacity: float, row_gap: float = 0.0, break_gap: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Index rows on pages: a heading stays with its first exhibit. Returns (placed rows, errors).

    ``rows``: keys, position (dense), row_id, kind, group_break, height. A heading and its
    exhibit are packed as one unit by ``next_fit``.
    """
    from casefile.functions.ordered import neighbours

    near = cut_lineage(neighbours(rows, keys, "position", ["kind", "height", "group_break"]))
    is_head = (F.col("kind") == "section") & F.coalesce(F.col("next_kind") == "exhibit", F.lit(False))
    follows = (F.col("kind") == "exhibit") & F.coalesce(F.col("prev_kind") == "section", F.lit(False))

    def gap(kind: str, flag: str) -> Column:
        extra = F.when((F.col(kind) == "exhibit") & F.coalesce(F.col(flag), F.lit(False)), break_gap).otherwise(0.0)
        return F.lit(row_gap) + extra

    pair = F.col("height") + gap("next_kind", "next_group_break") + F.col("next_height")
    first = F.when(is_head, pair).otherwise(F.col("height"))
    errors = near.filter(F.col("height") > capacity).select(*keys, "row_id", F.lit("ROW_TOO_TALL").alias("problem")).unionByName(
        near.filter(is_head & (pair > capacity)).select(*keys, "row_id", F.lit("ORPHAN_HEADING_UNAVOIDABLE").alias("problem"))
    )
    units = near.filter(~follows).withColumn("first", first).withColumn("later", first + gap("kind", "group_break"))
    units = units.withColumn("_chunk", chunk_of("position"))
    units = number_rows(units, keys, ["position"], "unit", ["_chunk"]).select(*keys, "unit", "position", "first", "later", is_head.alias("paired"))
    packed = next_fit(units, keys, "unit", "first", "later", capacity)
    second = packed.filter("paired").withColumn("position", F.col("position") + 1)
    placed = packed.select(*keys, "position", "container").unionByName(second.select(*keys, "position", "container"))
    result = near.join(placed, [*keys, "position"]).select(*keys, "position", "row_id", "kind", F.col("container").alias("page"))
    return result, errors
