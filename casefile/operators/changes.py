"""Comparing builds, and putting saved decisions back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.ordered import chunk_of, number_rows

# Categories of a comparison, in report order, and the snapshot columns behind them.
EXHIBIT_CATEGORIES = {
    "Source replaced or hash changed": ["evidence_id", "source_sha256"],
    "Selected source page range changed": ["page_start", "page_end"],
    "Worksheet selection or render plan changed": ["sheets"],
    "Index description changed": ["description"],
    "Document date changed": ["date_text"],
    "Manual exhibit status changed": ["manual_addition"],
    "Manual exhibit acknowledgement changed": ["manual_acknowledged_at"],
    "Repeat decision changed": ["repeat_decision"],
    "Included exhibit decisions changed": ["confirmed"],
}
SETTING_CATEGORIES = {
    "Statement source changed": ["statements"],
    "Template changed": ["templates"],
    "Optional-page rule changed": ["include_divider_pages", "include_exhibit_cover_pages", "count_optional_pages"],
    "Volume limit changed": ["volume_page_limit"],
    "Cover treatment changed": ["cover_insertion", "exact_cover_page_number", "exact_cover_volume_label"],
    "Volume boundary changed": ["volume_plan"],
    "Pagination changed": ["pagination"],
    "Non-A4 page treatment changed": ["page_size_choices"],
    "Build resolution or OCR exception changed": ["resolutions"],
    "Statement suggestions changed": ["statement_suggestions"],
}
CATEGORY_ORDER = [
    "Order changed", "Index sections changed", "Statement source changed", *EXHIBIT_CATEGORIES,
    "Template changed", "Optional-page rule changed", "Volume limit changed", "Cover treatment changed", "Volume boundary changed",
    "Pagination changed", "Non-A4 page treatment changed", "Build resolution or OCR exception changed", "Statement suggestions changed",
]
FIRST_VERSION = "This is the first version of this bundle."
OTHER_CHANGE = "Substantive build inputs changed"


def build_fingerprint(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """One digest per matter over its rows, equal exactly for equal sets of rows.

    Row digests are added up in eight 32-bit lanes, so the digest is a partial aggregate: no
    matter has to be sorted or collected. Order matters where a row carries its position.
    """
    columns = sorted(c for c in snapshot.columns if c not in keys)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    digest = F.sha2(F.concat_ws("\u001f", *fields), 256)
    lanes = [F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = [F.sum(lane).alias(f"_{i}") for i, lane in enumerate(lanes)]
    agg = snapshot.withColumn("_d", digest).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sums)
    parts = [F.col("rows").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(8)]]
    return agg.select(*keys, "rows", F.sha2(F.concat_ws(":", *parts), 256).alias("fingerprint"))


def _exhibit_changes(prev: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "exhibit_id"]
    both = [c for c in prev.columns if c in cur.columns and c not in on]
    left = prev.select(*on, F.lit(True).alias("_p"), *[F.col(c).alias(f"p_{c}") for c in both])
    right = cur.select(*on, F.lit(True).alias("_c"), *[F.col(c).alias(f"c_{c}") for c in both])
    return left.join(right, on, "full")


def _differs(columns: Sequence[str]) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | ~F.col(f"p_{c}").eqNullSafe(F.col(f"c_{c}"))
    return test


def compare_builds(
    prev: DataFrame, cur: DataFrame, keys: list[str], prev_settings: DataFrame | None = None, cur_settings: DataFrame | None = None,
    categories: Mapping[str, Sequence[str]] = EXHIBIT_CATEGORIES, fingerprints: DataFrame | None = None,
) -> DataFrame:
    """Named differences between two builds of each matter, in fixed order.

    Snapshots: keys, exhibit_id and any of the category columns, ``position`` (order) and
    ``section`` (heading over the exhibit). Settings: keys, setting, value. A matter counts that
    has exhibits or settings in either build; it is a first version if the earlier one has
    neither. ``fingerprints`` (keys, previous, current): a matter whose fingerprints differ has
    changed even if no category tells how.
    """
    def of(*frames: DataFrame | None) -> DataFrame:
        return reduce(DataFrame.union, [f.select(*keys) for f in frames if f is not None]).distinct()

    rows = _exhibit_changes(prev, cur, keys)
    have = [c[2:] for c in rows.columns if c.startswith("p_")]
    flags = [F.count_if("_p").alias("_prev_n"), F.count_if("_c").alias("_cur_n")]
    names = []
    for name, columns in {"Order changed": ["position"], "Index sections changed": ["section"], **categories}.items():
        used = [c for c in columns if c in have]
        if used:
            names.append(name)
            flags.append(F.max(_differs(used)).alias(f"_f{len(names) - 1}"))
    agg = of(prev, cur, prev_settings, cur_settings).join(rows.groupBy(*keys).agg(*flags), keys, "left")
    agg = agg.join(of(prev, prev_settings).withColumn("_known", F.lit(True)), keys, "left")
    hits = {name: F.col(f"_f{i}") for i, name in enumerate(names)}
    if "Included exhibit decisions changed" in hits:
        hits["Included exhibit decisions changed"] = hits["Included exhibit decisions changed"] | (F.col("_prev_n") != F.col("_cur_n"))
    if "Order changed" in hits and "Index sections changed" in hits:
        hits["Index sections changed"] = hits["Index sections changed"] & ~hits["Order changed"]
    if prev_settings is not None and cur_settings is not None:
        p = prev_settings.select(*keys, "setting", F.col("value").alias("p_value"))
        c = cur_settings.select(*keys, "setting", F.col("value").alias("c_value"))
        changed = p.join(c, [*keys, "setting"], "full").filter("NOT (p_value <=> c_value)")
        changed = changed.groupBy(*keys).agg(F.collect_set("setting").alias("_settings"))
        agg = agg.join(changed, keys, "left")
        for name, settings in SETTING_CATEGORIES.items():
            test = F.arrays_overlap("_settings", F.array(*[F.lit(s) for s in settings]))
            hits[name] = F.coalesce(test, F.lit(False))
    found = F.filter(F.array(*[F.when(hits[n], F.lit(n)) for n in CATEGORY_ORDER if n in hits]), lambda x: x.isNotNull())
    first = F.col("_known").isNull()
    if fingerprints is not None:
        agg = agg.join(fingerprints.select(*keys, (~F.col("previous").eqNullSafe(F.col("current"))).alias("_other")), keys, "left")
        found = F.when((F.size(found) == 0) & F.coalesce("_other", F.lit(False)), F.array(F.lit(OTHER_CHANGE))).otherwise(found)
    named = F.when(first, F.array(F.lit(FIRST_VERSION))).otherwise(found)
    rows = agg.select(*keys, named.alias("_names"), first.alias("_first"))
    summary = (
        F.when(F.col("_first"), "Bundle created.").when(F.size("_names") == 0, "No substantive change").otherwise(F.array_join("_names", "; "))
    )
    return rows.select(*keys, (F.size("_names") > 0).alias("changed"), F.array_join("_names", "; ").alias("categories"), summary.alias("summary"))


def snapshot_diff(prev: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and changed exhibits."""
    rows = _exhibit_changes(prev, cur, keys)
    have = [c[2:] for c in rows.columns if c.startswith("p_")]
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(_differs(have), "changed")
    return rows.select(*keys, "exhibit_id", change.alias("change")).filter("change IS NOT NULL")


def rehydrate_children(candidates: DataFrame, attachments: DataFrame, keys: list[str]) -> DataFrame:
    """Points attachment candidates at the source derived from their parent again.

    ``candidates``: keys, candidate_id, evidence_id, confirmed, parent_sha256, child_identity,
    child_sha256. ``attachments``: keys, parent_sha256, identity, child_sha256, source_id. The
    parent is found by hash, else as any owner of the identity; the child must agree in both
    identity and hash, otherwise source and confirmation are cleared.
    """
    owners = attachments.select(*keys, "parent_sha256").distinct().withColumn("_by_hash", F.lit(True))
    children = attachments.select(
        *keys, F.col("parent_sha256").alias("_owner"), F.col("identity").alias("child_identity"), F.col("child_sha256").alias("_child"), "source_id"
    )
    rows = candidates.join(owners, [*keys, "parent_sha256"], "left").join(children, [*keys, "child_identity"], "left")
    agrees = (F.col("_child") == F.col("child_sha256")) & (F.col("_by_hash").isNull() | (F.col("_owner") == F.col("parent_sha256")))
    rows = rows.withColumn("_ok", F.coalesce(agrees, F.lit(False)))
    best = F.max(F.when(F.col("_ok"), F.col("source_id"))).alias("_source")
    picked = rows.groupBy(*keys, "candidate_id").agg(best)
    joined = candidates.join(picked, [*keys, "candidate_id"], "left")
    is_child = F.col("child_identity").isNotNull()
    lost = is_child & F.col("_source").isNull()
    joined = joined.withColumn("evidence_id", F.when(is_child, F.col("_source")).otherwise(F.col("evidence_id")))
    return joined.withColumn("confirmed", F.col("confirmed") & ~lost).drop("_source")


REVIEWER_FIELDS = ["description", "date_text", "included", "page_start", "page_end", "sequence_order", "repeat_decision"]


def restore_decisions(current: DataFrame, saved: DataFrame, keys: list[str], fields: Sequence[str] = REVIEWER_FIELDS) -> DataFrame:
    """Reviewer fields from the saved row, generated identity fields from the current one.

    Confirmation survives only with a source (``evidence_id`` of the saved row).
    """
    on = [*keys, "candidate_id"]
    used = [f for f in fields if f in saved.columns and f in current.columns]
    picked = saved.select(*on, F.lit(True).alias("_s"), F.col("evidence_id").alias("_source"), F.col("confirmed").alias("_confirmed"), *[F.col(f).alias(f"_{f}__") for f in used])
    rows = current.join(picked, on, "left")
    has = F.col("_s").isNotNull()
    for f in used:
        rows = rows.withColumn(f, F.when(has, F.col(f"_{f}__")).otherwise(F.col(f)))
    rows = rows.withColumn("evidence_id", F.when(has, F.col("_source")).otherwise(F.col("evidence_id")))
    confirmed = F.col("_source").isNotNull() & F.coalesce("_confirmed", F.lit(False))
    rows = rows.withColumn("confirmed", F.when(has, confirmed).otherwise(F.col("confirmed")))
    return rows.select(*current.columns)


def merge_deltas(
    baseline: DataFrame, journal: DataFrame, source_hashes: DataFrame, keys: list[str], fields: Sequence[str] = ("description", "included")
) -> DataFrame:
    """Overlays journal decisions on a saved project; only hash-verified ones count.

    ``baseline``: keys, candidate_id, seq, evidence_id, child_sha256, confirmed, fields;
    ``journal``: keys, candidate_id, position, evidence_id, child_sha256, source_sha256,
    confirmed, fields; ``source_hashes``: keys, source_id, sha256. Rows are paired by id,
    then by child hash in order. Result: ``outcome`` is kept, merged, hash changed or appended.
    """
    saved_columns = ["position", "evidence_id", "child_sha256", "source_sha256", "confirmed", *fields]
    saved = journal.select(*keys, F.col("candidate_id").alias("saved_id"), *[F.col(c).alias(f"s_{c}") for c in saved_columns])
    on = [*keys, "saved_id"]
    ids = baseline.select(*keys, F.col("candidate_id").alias("saved_id"))
    by_id = baseline.withColumn("saved_id", F.col("candidate_id")).join(saved, on)
    open_base = baseline.join(journal.select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_anti")
    open_saved = saved.join(ids, on, "left_anti").withColumn("_hash", F.coalesce("s_child_sha256", "s_source_sha256"))

    def nth(rows: DataFrame, order: str) -> DataFrame:
        rows = rows.filter("_hash IS NOT NULL").withColumn("_chunk", chunk_of(order))
        return number_rows(rows, [*keys, "_hash"], [order], "_nth", ["_chunk"]).drop("_chunk")

    left = nth(open_base.withColumn("_hash", F.col("child_sha256")), "seq")
    right = nth(open_saved, "s_position")
    by_hash = left.join(right, [*keys, "_hash", "_nth"]).drop("_hash", "_nth")
    paired = by_id.unionByName(by_hash)
    untouched = open_base.join(by_hash.select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_anti")
    hashes = source_hashes.select(*keys, F.col("source_id").alias("_source"), F.col("sha256").alias("_actual"))

    def verified(rows: DataFrame, evidence: Column, child: Column) -> DataFrame:
        rows = rows.withColumn("_source", evidence).withColumn("_child", child).join(hashes, [*keys, "_source"], "left")
        ok = (F.col("_actual") == F.col("s_source_sha256")) | (F.col("_child") == F.col("s_source_sha256"))
        return rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))

    checked = verified(paired, F.coalesce("s_evidence_id", "evidence_id"), F.coalesce("s_child_sha256", "child_sha256"))
    bound = F.col("s_source_sha256").isNotNull()
    stale = bound & ~F.col("_ok")
    columns = ["candidate_id", "evidence_id", "confirmed", *fields]
    merged = checked.select(
        *keys, "candidate_id", F.when(stale, F.col("evidence_id")).otherwise(F.col("s_evidence_id")).alias("evidence_id"),
        F.when(stale, False).otherwise(bound & F.coalesce("s_confirmed", F.lit(False))).alias("confirmed"),
        *[F.when(stale, F.col(f)).otherwise(F.col(f"s_{f}")).alias(f) for f in fields],
        F.when(stale, "hash changed").otherwise("merged").alias("outcome"),
    )
    kept = untouched.select(*keys, *columns, F.lit("kept").alias("outcome"))
    taken = by_hash.select(*keys, "saved_id")
    loose = open_saved.join(taken, on, "left_anti").filter("s_source_sha256 IS NOT NULL")
    known = baseline.filter("child_sha256 IS NOT NULL").select(*keys, F.col("child_sha256").alias("s_child_sha256")).distinct()
    loose = verified(loose.join(known, [*keys, "s_child_sha256"], "left_anti"), F.col("s_evidence_id"), F.col("s_child_sha256")).filter("_ok")
    firsts = loose.filter("s_child_sha256 IS NOT NULL").groupBy(*keys, "s_child_sha256").agg(F.min("s_position").alias("s_position"))
    single = loose.filter("s_child_sha256 IS NULL").unionByName(loose.join(firsts, [*keys, "s_child_sha256", "s_position"], "left_semi"))
    appended = single.select(
        *keys, F.col("saved_id").alias("candidate_id"), F.col("s_evidence_id").alias("evidence_id"),
        F.coalesce("s_confirmed", F.lit(False)).alias("confirmed"), *[F.col(f"s_{f}").alias(f) for f in fields], F.lit("appended").alias("outcome"),
    )
    return merged.unionByName(kept).unionByName(appended)


def valid_resolutions(resolutions: DataFrame, source_hashes: DataFrame, valid_candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Resolutions whose source hash is current and whose candidate decision was verified."""
    hashes = source_hashes.select(*keys, "source_id", F.col("sha256").alias("_actual"))
    rows = resolutions.join(hashes, [*keys, "source_id"], "left").join(
        valid_candidates.select(*keys, "candidate_id").distinct().withColumn("_valid", F.lit(True)), [*keys, "candidate_id"], "left"
    )
    bound = F.col("source_id").isNotNull() & F.col("source_sha256").isNotNull()
    stale = bound & ~F.col("_actual").eqNullSafe(F.col("source_sha256"))
    orphan = F.col("candidate_id").isNotNull() & F.col("_valid").isNull()
    return rows.filter(~stale & ~orphan).select(*resolutions.columns)


def restore_reviews(templates: DataFrame, reviews: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """A review survives only when source, rendered and reviewed hashes all agree.

    ``templates``: keys, slot, source_id, sha256, format. ``reviews``: keys, slot, source_id,
    source_sha256, format, rendered_id, pdf_sha256, reviewed_sha256. ``rendered``: keys, source_id, sha256.
    """
    meta = reviews.select(
        *keys, "slot", "source_id", F.col("source_sha256").alias("sha256"), F.col("format").alias("_format"), "rendered_id", "pdf_sha256", "reviewed_sha256"
    )
    rows = templates.join(meta, [*keys, "slot", "source_id", "sha256"], "left")
    made = rendered.select(*keys, F.col("source_id").alias("rendered_id"), F.col("sha256").alias("_rendered"))
    rows = rows.join(made, [*keys, "rendered_id"], "left").withColumn("format", F.coalesce("_format", "format"))
    shown = F.when(F.col("format") == "pdf", F.col("sha256")).otherwise(F.col("_rendered"))
    valid = F.coalesce((shown == F.col("pdf_sha256")) & (F.col("reviewed_sha256") == F.col("pdf_sha256")), F.lit(False))
    return rows.select(*keys, "slot", "source_id", shown.alias("rendered_sha256"), valid.alias("review_restored"))
