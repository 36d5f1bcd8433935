"""Audit rows of a finished build: manifest, exclusions, omissions and the readable report.

Everything is rows (one exhibit, one file, one line), written partitioned and sorted; a
matter is never gathered into one nested value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _exclusions(resolutions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """First exclusion by candidate and by (source id, source hash)."""
    columns = F.struct("position", "action", "note", "approved_at")
    by_candidate = resolutions.filter("action = 'exclude-candidate' AND candidate_id IS NOT NULL").groupBy(*keys, "candidate_id").agg(F.min_by(columns, "position").alias("_c"))
    by_source = resolutions.filter("action = 'exclude-source' AND source_sha256 IS NOT NULL").groupBy(*keys, "source_id", "source_sha256").agg(F.min_by(columns, "position").alias("_s"))
    return by_candidate, by_source


def exclusion_reasons(sources: DataFrame, candidates: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """Why each source outside the bundle is outside.

    ``sources``: keys, source_id, name, sha256; its further columns stay. ``candidates``: keys, candidate_id, seq,
    evidence_id, included. Order of reasons: the source's own resolution, the resolution of
    its first excluded candidate, duplicate copy, no match.
    """
    chosen = candidates.filter("included AND evidence_id IS NOT NULL").select(*keys, F.col("evidence_id").alias("source_id")).distinct()
    outside = sources.join(chosen, [*keys, "source_id"], "left_anti")
    hashes = sources.join(chosen, [*keys, "source_id"], "left_semi").select(*keys, "sha256").distinct().withColumn("_copy", F.lit(True))
    by_candidate, by_source = _exclusions(resolutions, keys)
    own = by_source.select(*keys, "source_id", F.col("source_sha256").alias("sha256"), F.col("_s.note").alias("_own"))
    of_candidate = candidates.filter("evidence_id IS NOT NULL").join(by_candidate, [*keys, "candidate_id"]).groupBy(
        *keys, F.col("evidence_id").alias("source_id")
    ).agg(F.min_by(F.struct(F.col("_c.note").alias("note")), "seq").alias("_first"))
    rows = outside.join(own, [*keys, "source_id", "sha256"], "left").join(of_candidate, [*keys, "source_id"], "left").join(hashes, [*keys, "sha256"], "left")
    fallback = F.when(F.col("_copy"), "Unselected duplicate physical copy of a selected source").otherwise("No confirmed citation match")
    return rows.select(*keys, *[c for c in sources.columns if c not in keys], F.coalesce("_own", "_first.note", fallback).alias("reason"))


def omitted_citations(candidates: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """Cited candidates a resolution keeps out, with reason, action and time."""
    by_candidate, by_source = _exclusions(resolutions, keys)
    sources = by_source.withColumnRenamed("source_id", "evidence_id")
    rows = candidates.filter("NOT manual_addition").join(by_candidate, [*keys, "candidate_id"], "left").join(sources, [*keys, "evidence_id", "source_sha256"], "left")
    earlier = F.when(F.col("_s").isNull() | (F.col("_c.position") < F.col("_s.position")), F.col("_c")).otherwise(F.col("_s"))
    rows = rows.withColumn("_d", F.coalesce(earlier, F.col("_c"))).filter("_d IS NOT NULL")
    default = F.when(F.col("_d.action") == "exclude-source", "Reviewer excluded this source from the exhibit bundle.").otherwise(
        "Reviewer excluded this cited item from the exhibit bundle."
    )
    return rows.select(
        *keys, "candidate_id", "paragraph", "description", F.coalesce("_d.note", default).alias("reason"),
        F.col("_d.action").alias("decision_action"), F.col("_d.approved_at").alias("decided_at"),
    )


def _section(rows: DataFrame, keys: list[str], section: int, order: Column, lines: list[Column]) -> DataFrame:
    """Several lines per row, in order."""
    numbered = F.array(*[F.struct(F.lit(i).alias("n"), line.alias("line")) for i, line in enumerate(lines)])
    spread = rows.select(*keys, order.cast("long").alias("row_order"), F.explode(F.filter(numbered, lambda x: x["line"].isNotNull())).alias("x"))
    return spread.select(*keys, F.lit(section).alias("section"), "row_order", F.col("x.n").alias("line_no"), F.col("x.line").alias("line"))


def _field(label: str, value: Column) -> Column:
    text = value.cast("string")
    return F.concat(F.lit(f"{label}: "), F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(text))


def build_report(
    outputs: DataFrame, exhibits: DataFrame, omitted: DataFrame, excluded: DataFrame, checks: DataFrame, keys: list[str]
) -> DataFrame:
    """Readable report lines: keys, section, row_order, line_no, line (sort by these).

    ``outputs``: keys, project, file_name, sha256, page_count. ``exhibits``: keys, number,
    description, source_file, source_sha256, date_text, volume, physical_pages,
    reference_pages, manual_addition, references.
    """
    blank = F.lit("")
    head = _section(outputs, keys, 1, F.lit(0), [
        F.lit("Readable build report"), _field("Project", F.col("project")), _field("Output file", F.col("file_name")),
        _field("Output SHA-256", F.col("sha256")), _field("Output pages", F.col("page_count")), blank, F.lit("Exhibits"),
    ])
    manual = F.col("manual_addition")
    number = F.col("number").cast("string")
    body = _section(exhibits, keys, 2, F.col("number"), [
        F.concat(F.lit("- Exhibit "), number, F.lit(": "), "description"), F.concat(F.lit("  "), _field("Source", F.col("source_file"))),
        F.concat(F.lit("  "), _field("Source SHA-256", F.col("source_sha256"))), F.concat(F.lit("  "), _field("Document date", F.col("date_text"))),
        F.concat(F.lit("  "), _field("Volume", F.col("volume"))), F.concat(F.lit("  "), _field("Printed PDF pages", F.col("physical_pages"))),
        F.concat(F.lit("  "), _field("Statement reference pages", F.col("reference_pages"))),
        F.concat(F.lit("  "), _field("Citation status", F.when(manual, "not-cited-manual-addition").otherwise("cited"))),
        F.when(manual, "  Provenance: Added by reviewer; not cited in the statement"),
        F.when(F.coalesce("references", blank) != "", F.concat(F.lit("  Statement references: "), "references")),
    ])

    def titled(rows: DataFrame, section: int, title: str, order: Column, line: Column) -> DataFrame:
        header = rows.select(*keys).distinct()
        return _section(header, keys, section, F.lit(-1), [blank, F.lit(title)]).unionByName(_section(rows, keys, section, order, [line]))

    sha = F.coalesce("source_sha256", F.lit("—"))
    added = titled(
        exhibits.filter("manual_addition"), 3, "Added exhibits (not cited in the statement)", F.col("number"),
        F.concat(F.lit("- "), "description", F.lit(" ("), F.coalesce("source_file", F.lit("—")), F.lit("); SHA-256 "), sha),
    )
    left_out = titled(
        omitted, 4, "Omitted citations", F.col("paragraph"), F.concat(F.lit("- "), "description", F.lit(" (paragraph "), F.col("paragraph").cast("string"), F.lit(")"))
    )
    files = titled(
        excluded, 5, "Excluded files", F.col("source_seq"), F.concat(F.lit("- "), "name", F.lit("; SHA-256 "), "sha256", F.lit("; "), "reason")
    )
    found = F.concat(F.lit("- ["), "severity", F.lit("] "), "label", F.lit(": "), "detail")
    final = titled(checks, 6, "Final preflight", F.xxhash64("check_id"), found)
    return reduce(DataFrame.unionByName, [head, body, added, left_out, files, final])


def manifest_rows(exhibits: DataFrame, excluded: DataFrame, omitted: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object per audit entry: keys, kind, entry."""
    def entries(rows: DataFrame, kind: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in keys]
        return rows.select(*keys, F.lit(kind).alias("kind"), F.to_json(F.struct(*fields)).alias("entry"))

    return reduce(DataFrame.unionByName, [
        entries(exhibits, "exhibit"), entries(excluded, "excluded-file"), entries(omitted, "omitted-citation"), entries(volumes, "volume"),
    ])


def manifest_rollup(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of each kind per matter."""
    kinds = ["exhibit", "excluded-file", "omitted-citation", "volume"]
    counts = [F.count_if(F.col("kind") == k).alias(k.replace("-", "_") + "_n") for k in kinds]
    return manifest.groupBy(*keys).agg(*counts)


def write_manifest(manifest: DataFrame, path: str, keys: list[str], files_per_write: int | None = None) -> None:
    """Sorted JSON lines; ranges of matters share files, and a very large matter spans several."""
    ordered = manifest.repartitionByRange(*keys, "kind", "entry") if files_per_write is None else manifest.repartitionByRange(files_per_write, *keys, "kind", "entry")
    ordered.sortWithinPartitions(*keys, "kind", "entry").write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str, keys: list[str]) -> None:
    order = [*keys, "section", "row_order", "line_no"]
    report.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
