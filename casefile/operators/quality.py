"""Data-quality checks before a build: one DataFrame per rule, one union, one row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.functions import text as T
from casefile.operators.matching import match_resolutions
from casefile.operators.similarity import packed, unpacked
from casefile.session import cut_lineage

# Code of each label.
CODES = {
    "Email attachment needs a decision": "email.attachment_unresolved",
    "Unsupported email attachment": "email.attachment_unsupported",
    "Unmatched exhibit": "exhibit.unmatched",
    "Unconfirmed exhibit": "exhibit.unconfirmed",
    "Duplicate index number": "numbering.duplicate",
    "Repeat source decision required": "repeat.decision_pending",
    "Conflicting repeat selection": "repeat.selection_conflict",
    "Mixed exhibit segments need review": "segment.unsupported",
    "Unreadable workbook": "workbook.unreadable",
    "No worksheet selected": "workbook.no_sheet",
    "Unreadable worksheet": "workbook.sheet_unreadable",
    "Encrypted PDF": "source.encrypted",
    "OCR failed": "ocr.failed",
    "OCR unavailable": "ocr.unavailable",
    "Rotated pages": "source.rotated",
    "Large source file": "source.large",
    "Very little extracted text": "source.sparse",
    "Blank or unreadable document": "source.blank",
    "Hidden worksheet not selected": "workbook.hidden_sheet",
    "Worksheet render warning": "workbook.render_warning",
    "Duplicate source files": "source.duplicate",
    "Possible near-duplicate sources": "source.near_duplicate",
    "Unselected duplicate physical copies": "source.duplicate_copy",
    "Unreferenced evidence": "source.unreferenced",
}
HARD_LEGAL = [
    "Unmatched exhibit", "Unconfirmed exhibit", "Duplicate index number", "Repeat source decision required",
    "Conflicting repeat selection", "Email attachment needs a decision",
]
EXCEPTION_ELIGIBLE = ["OCR failed", "OCR unavailable"]


def _text(value: str | Column | None) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def finding(
    rows: DataFrame, keys: list[str], check_id: Column, severity: str | Column, label: str | Column, detail: str | Column,
    source_sha256: Column | None = None, candidate_id: Column | None = None,
) -> DataFrame:
    return rows.select(
        *keys, check_id.alias("check_id"), _text(severity).alias("severity"), _text(label).alias("label"), _text(detail).alias("detail"),
        _text(source_sha256).alias("source_sha256"), _text(candidate_id).alias("candidate_id"),
    )


def decorate(checks: DataFrame) -> DataFrame:
    """Adds code and policy."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    other = F.when(F.col("check_id") == "ready", "build.ready").otherwise(F.concat(F.lit("build."), "check_id"))
    policy = (
        F.when(F.col("label").isin(EXCEPTION_ELIGIBLE), "exception-eligible")
        .when(F.col("label").isin(HARD_LEGAL), "hard-legal")
        .when(F.col("severity") == "blocking", "hard-technical")
        .otherwise("warning")
    )
    return checks.withColumn("code", F.coalesce(F.try_element_at(codes, F.col("label")), other)).withColumn("policy", policy)


def _id(prefix: str, *parts: str | Column) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(prefix), F.concat_ws("-", *[c.cast("string") for c in columns]))


def unmatched(candidates: DataFrame, keys: list[str]) -> DataFrame:
    added = F.col("manual_addition") | F.col("paragraph").isNull() | (F.col("paragraph") <= 0)
    described = T.trim_space("description")
    count, ordinal = F.coalesce("citation_count", F.lit(1)), F.col("citation_ordinal")
    paragraph = F.concat(F.lit("Paragraph "), F.col("paragraph").cast("string"))
    subject = (
        F.when(added, F.when(F.coalesce(described, F.lit("")) == "", "This added exhibit").otherwise(described))
        .when((count > 1) & (F.coalesce(ordinal, F.lit(0)) > 0),
              F.concat(paragraph, F.lit(", reference "), ordinal.cast("string"), F.lit(" of "), count.cast("string"), F.lit(",")))
        .otherwise(paragraph)
    )
    rows = candidates.filter("included AND evidence_id IS NULL")
    detail = F.concat(subject, F.lit(" has no selected source file."))
    return finding(rows, keys, _id("unmatched-", "candidate_id"), "blocking", "Unmatched exhibit", detail, None, F.col("candidate_id"))


def unconfirmed(candidates: DataFrame, keys: list[str], required: bool = True) -> DataFrame:
    rows = candidates.filter("included AND NOT confirmed").filter(F.lit(required))
    detail = F.concat("mark", F.lit(" has not been confirmed by a reviewer."))
    return finding(rows, keys, _id("unconfirmed-", "candidate_id"), "blocking", "Unconfirmed exhibit", detail)


def attachment_checks(attached: DataFrame, keys: list[str]) -> DataFrame:
    """``attached``: keys, candidate_id, source_name, source_sha256, identity, name, supported, disposition."""
    decision, supported = F.col("disposition"), F.col("supported")
    left_out = F.coalesce(decision == "leave-out", F.lit(False))
    open_ = attached.filter(~left_out & (~supported | decision.isNull()))
    ask = F.concat(
        "source_name", F.lit(" includes "), "name", F.lit(". Choose Print with this email, Add as its own exhibit, or Leave out.")
    )
    undecided = finding(
        open_, keys, _id("email-attachment-", "candidate_id", "identity"), "blocking", "Email attachment needs a decision", ask,
        F.col("source_sha256"), F.col("candidate_id"),
    )
    used = attached.filter(~supported & decision.isNotNull() & ~left_out)
    refuse = F.concat("name", F.lit(" cannot be converted. Leave it out."))
    return undecided.unionByName(
        finding(
            used, keys, _id("email-attachment-unsupported-", "candidate_id", "identity"), "blocking", "Unsupported email attachment",
            refuse, F.col("source_sha256"), F.col("candidate_id"),
        )
    )


def attached_workbook_checks(attached: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """Workbooks printed with their e-mail. ``sheets``: child_sha256, sheet_name, included, cell_count."""
    printed = attached.filter("disposition = 'print-with-email' AND extension = 'xlsx'")
    per_child = sheets.groupBy("child_sha256").agg(F.max("included").alias("any_included"))
    rows = printed.join(per_child, "child_sha256", "left")
    unreadable = finding(
        rows.filter("any_included IS NULL"), keys, _id("email-xlsx-unreadable-", "candidate_id", "identity"), "blocking",
        "Unreadable workbook", F.concat("name", F.lit(" could not be analysed for printing with "), "source_name", F.lit(".")),
        F.col("child_sha256"), F.col("candidate_id"),
    )
    none = finding(
        rows.filter("NOT any_included"), keys, _id("email-xlsx-none-", "candidate_id", "identity"), "blocking", "No worksheet selected",
        F.concat(F.lit("Select at least one worksheet for "), "name", F.lit(" before printing it with "), "source_name", F.lit(".")),
        F.col("child_sha256"), F.col("candidate_id"),
    )
    empty = printed.join(sheets.filter("included AND cell_count = 0"), "child_sha256")
    empty = finding(
        empty, keys, _id("email-xlsx-empty-", "candidate_id", "identity", "sheet_name"), "blocking", "Unreadable worksheet",
        F.concat("name", F.lit(" / "), "sheet_name", F.lit(" has no readable cells in its selected range.")),
        F.col("child_sha256"), F.col("candidate_id"),
    )
    return unreadable.unionByName(none).unionByName(empty)


def duplicate_numbers(groups: DataFrame, keys: list[str]) -> DataFrame:
    mark = F.concat(F.upper(F.regexp_replace("bundle_mark", r"\s+", "")), F.lit(":"), F.col("exhibit_number").cast("string"))
    rows = groups.groupBy(*keys, mark.alias("mark")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return finding(
        rows, keys, _id("duplicate-", "mark"), "blocking", "Duplicate index number", F.concat("mark", F.lit(" is assigned more than once."))
    )


def repeat_checks(groups: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``members``: keys, group_id, kind; ``groups`` carries ``mark`` of its first citation.

    Details give numbers of members, at every size; ``finding_members`` lists the members as rows.
    """
    counts = members.filter("kind IN ('canonical', 'joined')").groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("n"))
    rows = groups.filter("decision_pending").join(counts, [*keys, "group_id"])
    detail = F.concat(
        F.col("n").cast("string"), F.lit(" citation(s) select identical file content. Confirm whether they are the same exhibit or separate exhibits.")
    )
    first = finding(rows, keys, _id("repeat-pending-", "source_sha256"), "blocking", "Repeat source decision required", detail)
    detail = F.concat(
        "mark",
        F.lit(" has conflicting page ranges or worksheet selections across citations. Align them before confirming one exhibit."),
    )
    second = groups.filter("selection_conflict")
    return first.unionByName(
        finding(second, keys, _id("repeat-selection-", "source_sha256"), "blocking", "Conflicting repeat selection", detail)
    )


def source_checks(sources: DataFrame, keys: list[str], require_ocr: bool = True) -> DataFrame:
    """Rules on the distinct selected contents (keys, sha256): size, encryption, recognised text, sparse text.

    All rules share one pass: each row yields an array of the findings it has.
    """
    one = sources.dropDuplicates([*keys, "sha256"])
    pdf = F.col("extension") == "pdf"
    megabytes = F.ceil(F.col("bytes") / (1024 * 1024)).cast("string")
    bad_ocr = pdf & F.col("ocr_status").isin("failed", "unavailable")
    failed = F.col("ocr_status") == "failed"
    words = F.size(F.filter(F.split(T.normalize_ws("text"), " "), lambda w: w != ""))
    reason = F.coalesce(F.concat(F.lit(" "), "ocr_failure_reason"), F.lit(""))
    rules = [
        (F.col("bytes") >= 100 * 1024 * 1024, "large-source-", "warning", "Large source file",
         F.concat(megabytes, F.lit(" MB. Local processing may take longer; keep the application open until final validation completes."))),
        (F.col("encrypted"), "encrypted-", "blocking", "Encrypted PDF", F.lit("Remove password protection before building.")),
        (pdf & (F.col("ocr_status") == "completed"), "ocr-complete-", "pass", "OCR completed locally",
         F.lit("A searchable text layer was generated at 300dpi.")),
        (bad_ocr, "ocr-", "blocking" if require_ocr else "warning", F.when(failed, "OCR failed").otherwise("OCR unavailable"),
         F.when(failed, F.concat(F.lit("Local OCR could not create usable searchable text for this PDF."), reason))
         .otherwise("This PDF needs local OCR, which is unavailable in this environment.")),
        (pdf & (F.col("page_count") > 0) & (words < 3), "sparse-", "warning", "Very little extracted text",
         F.lit("Check scan quality and legibility.")),
        (T.trim_space("text") == "", "blank-", "warning", "Blank or unreadable document",
         F.lit("No usable text was found; visually confirm this file is not blank.")),
    ]
    found = F.array(*[
        F.when(test, F.struct(
            F.concat(F.lit(prefix), "source_id").alias("check_id"), F.lit(severity).alias("severity"),
            _text(label).alias("label"), detail.alias("detail"),
        )) for test, prefix, severity, label, detail in rules
    ])
    rows = one.select(*keys, "sha256", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return finding(rows, keys, F.col("f.check_id"), F.col("f.severity"), F.col("f.label"), F.col("f.detail"), F.col("sha256"))


def rotation_checks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``pages``: keys, source_id, sha256, page, rotation, has_annotations, of the selected PDFs."""
    rotated = pages.filter(F.pmod("rotation", F.lit(360)) != 0)
    counts = rotated.groupBy(*keys, "source_id", "sha256").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_annotations").alias("both"))
    detail = F.concat(F.col("n").cast("string"), F.lit(" page(s) have a non-zero rotation and should be visually reviewed."))
    warning = F.struct(_id("rotation-", "source_id").alias("check_id"), F.lit("warning").alias("severity"), F.lit("Rotated pages").alias("label"), detail.alias("detail"))
    detail = F.concat(
        F.col("both").cast("string"),
        F.lit(" page(s) combine page rotation with PDF annotations. Flatten the rotation and annotations in a trusted PDF application, then replace this source file."),
    )
    refused = F.struct(
        _id("rotated-annotations-", "source_id").alias("check_id"), F.lit("blocking").alias("severity"),
        F.lit("Rotated PDF annotations cannot be preserved safely").alias("label"), detail.alias("detail"),
    )
    found = F.when(F.col("both") > 0, F.array(warning, refused)).otherwise(F.array(warning))
    rows = counts.select(*keys, "sha256", F.explode(found).alias("f"))
    return finding(rows, keys, F.col("f.check_id"), F.col("f.severity"), F.col("f.label"), F.col("f.detail"), F.col("sha256"))


def action_checks(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Active document actions, their number per source."""
    counts = actions.groupBy(*keys, "source_id", "sha256").agg(F.count(F.lit(1)).alias("n"))
    detail = F.concat(
        F.col("n").cast("string"),
        F.lit(" active action(s). Flatten or remove the actions in a trusted PDF application, then replace this source file. "
              "Ordinary visual annotations and internal page links remain supported."),
    )
    return finding(counts, keys, _id("active-pdf-actions-", "source_id"), "blocking", "Active PDF actions are not permitted", detail, F.col("sha256"))


def finding_members(rows: DataFrame, keys: list[str], check_id: Column, order: Column, member: Column) -> DataFrame:
    """What a finding counts, one row each: keys, check_id, position (a sortable text or number), member."""
    return rows.select(*keys, check_id.alias("check_id"), order.cast("string").alias("position"), member.cast("string").alias("member"))


def page_members(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The pages behind ``rotation_checks``."""
    rotated = pages.filter(F.pmod("rotation", F.lit(360)) != 0)
    page = F.concat(F.lit("page "), F.col("page").cast("string"))
    checks = F.when(F.col("has_annotations"), F.array(F.lit("rotation-"), F.lit("rotated-annotations-"))).otherwise(F.array(F.lit("rotation-")))
    rows = rotated.withColumn("_check", F.explode(checks))
    return finding_members(rows, keys, F.concat("_check", F.coalesce(F.col("source_id").cast("string"), F.lit(""))), F.col("page"), page)


def action_members(actions: DataFrame, keys: list[str]) -> DataFrame:
    """The actions behind ``action_checks``."""
    phrase = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" "), "location", F.lit(" /"), "action")
    return finding_members(actions, keys, _id("active-pdf-actions-", "source_id"), F.col("page"), phrase)


def copy_members(sources: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """The files behind ``copy_checks``: copies of a content, and those outside the selection."""
    rows = cut_lineage(_with_chosen(packed(sources.select(*keys, "source_id", "source_seq", "name", "sha256")), selected, keys).drop("source_id"))
    # a copy of a selected content has that content beside it, so both lists come from contents of two files or more
    content = [*keys, "_hex", "_bytes"]
    same = rows.groupBy(*content).agg(F.count(F.lit(1)).alias("_n"), F.max("_chosen").alias("_any")).filter("_n > 1").drop("_n")
    copies = rows.join(same, content)
    own = _id("duplicate-", unpacked())
    checks = F.when(F.col("_any") & ~F.col("_chosen"), F.array(own, F.lit("duplicate-physical-copies"))).otherwise(F.array(own))
    return finding_members(copies.withColumn("_check", F.explode(checks)), keys, F.col("_check"), F.col("source_seq"), F.col("name"))


def repeat_members(groups: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """The citations behind ``repeat_checks``. ``members``: keys, group_id, seq, paragraph, kind."""
    pending = groups.filter("decision_pending").select(*keys, "group_id", "source_sha256")
    rows = members.drop("source_sha256").filter("kind IN ('canonical', 'joined')").join(pending, [*keys, "group_id"])
    paragraph = F.concat(F.lit("paragraph "), F.col("paragraph").cast("string"))
    return finding_members(rows, keys, _id("repeat-pending-", "source_sha256"), F.col("seq"), paragraph)


def workbook_checks(workbooks: DataFrame, sheets: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Selected workbooks. ``workbooks``: keys, source_id, sha256. ``sheets``: source_id, sheet_name, state,
    included, cell_count. ``notes``: source_id, sheet_name, warning."""
    per_book = sheets.groupBy("source_id").agg(F.max("included").alias("any_included"))
    rows = workbooks.join(per_book, "source_id", "left")
    sha = F.col("sha256")
    parts = [
        finding(rows.filter("any_included IS NULL"), keys, _id("xlsx-unreadable-", "source_id"), "blocking", "Unreadable workbook",
                "Workbook analysis was not available.", sha),
        finding(rows.filter("NOT any_included"), keys, _id("xlsx-none-", "source_id"), "blocking", "No worksheet selected",
                "Select at least one visible worksheet to include.", sha),
    ]
    each = workbooks.join(sheets, "source_id")
    parts.append(finding(
        each.filter("included AND cell_count = 0"), keys, _id("xlsx-empty-", "source_id", "sheet_name"), "blocking", "Unreadable worksheet",
        F.concat("sheet_name", F.lit(" has no readable cells in its selected range.")), sha))
    parts.append(finding(
        each.filter("state <> 'visible' AND NOT included"), keys, _id("xlsx-hidden-", "source_id", "sheet_name"), "warning",
        "Hidden worksheet not selected", F.concat("sheet_name", F.lit(" is "), "state", F.lit(" and is not selected.")), sha))
    noted = each.filter("included").join(notes, ["source_id", "sheet_name"])
    failure = F.col("warning").startswith("Fidelity check failed:")
    parts.append(finding(
        noted, keys, _id("xlsx-plan-", "source_id", "sheet_name", "warning"), F.when(failure, "blocking").otherwise("warning"),
        F.when(failure, "Workbook print area would omit content").otherwise("Worksheet print note"),
        F.concat("sheet_name", F.lit(": "), "warning"), sha))
    return reduce(DataFrame.unionByName, parts)


def _with_chosen(sources: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_chosen``: whether a source is selected."""
    chosen = selected.select(*keys, "source_id").distinct().withColumn("_chosen", F.lit(True))
    return sources.join(chosen, [*keys, "source_id"], "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))


def copy_checks(sources: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate contents, unselected copies of selected contents, and the number of unreferenced files.

    ``sources``: keys, source_id, name, sha256. ``selected``: keys, source_id.
    """
    rows = _with_chosen(packed(sources.select(*keys, "source_id", "sha256")), selected, keys)
    contents = rows.groupBy(*keys, "_hex", "_bytes").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_chosen")).alias("outside"))
    # nulls equal nothing: such a source is a copy of no selected one
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*keys, "_bytes"]])
    unselected = F.when(known & (F.col("outside") < F.col("n")), F.col("outside")).otherwise(0)

    def part(check_id: Column, label: str, n: Column) -> Column:
        return F.struct(check_id.alias("check_id"), F.lit(label).alias("label"), n.alias("n"))

    parts = F.array(
        part(_id("duplicate-", unpacked()), "Duplicate source files", F.when(F.col("n") > 1, F.col("n")).otherwise(0)),
        part(F.lit("duplicate-physical-copies"), "Unselected duplicate physical copies", unselected),
        part(F.lit("unreferenced"), "Unreferenced evidence", F.col("outside")),
    )
    counts = contents.select(*keys, F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p"))
    counts = counts.groupBy(*keys, F.col("p.check_id").alias("check_id"), F.col("p.label").alias("label")).agg(F.sum("p.n").cast("string").alias("n"))
    detail = (
        F.when(F.col("label") == "Duplicate source files", F.concat(F.lit("Identical source hashes: "), "n", F.lit(" files.")))
        .when(F.col("label") == "Unreferenced evidence", F.concat("n", F.lit(" supplied file(s) are outside the confirmed bundle.")))
        .otherwise(F.concat("n", F.lit(" file(s) contain identical content to a selected source and will remain outside the bundle.")))
    )
    return finding(counts, keys, F.col("check_id"), "warning", F.col("label"), detail)


def near_duplicate_checks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs``: keys, left_id, left_name, right_id, right_name, percent."""
    detail = F.concat(
        "left_name", F.lit(" and "), "right_name", F.lit(" have unusually similar extracted text ("), F.col("percent").cast("string"),
        F.lit("%). Review them before selecting both."),
    )
    return finding(pairs, keys, _id("near-duplicate-", "left_id", "right_id"), "warning", "Possible near-duplicate sources", detail)


def with_ready(checks: DataFrame, matters: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a pass row for matters without a blocking check."""
    blocked = checks.filter("severity = 'blocking'").select(*keys).distinct()
    clear = matters.select(*keys).distinct().join(blocked, keys, "left_anti")
    ready = finding(clear, keys, F.lit("ready"), "pass", "Ready to build", "No blocking preflight issue was found.")
    return checks.unionByName(ready)


def run_preflight(rules: list[DataFrame], matters: DataFrame, keys: list[str]) -> DataFrame:
    """Union of rule results, the pass rows, codes and policies."""
    return decorate(with_ready(reduce(DataFrame.unionByName, rules), matters, keys))


def apply_resolutions(checks: DataFrame, resolutions: DataFrame, matters: DataFrame, keys: list[str]) -> DataFrame:
    """Turns approved text-recognition exceptions into warnings; adds the pass row where nothing blocks."""
    matched = match_resolutions(checks, resolutions, keys)
    approved = (
        (F.col("action") == "proceed-without-ocr") & F.col("label").isin(EXCEPTION_ELIGIBLE)
        & (F.col("policy") == "exception-eligible") & F.col("visual_review_confirmed")
    )
    approved = F.coalesce(approved, F.lit(False))
    note = F.lit(" Approved exception: the original PDF will be included without a tool-generated OCR text layer.")
    rows = matched.withColumn("severity", F.when(approved, "warning").otherwise(F.col("severity")))
    rows = rows.withColumn("detail", F.when(approved, F.concat("detail", note)).otherwise(F.col("detail")))
    columns = [*keys, "check_id", "severity", "label", "detail", "code", "policy"]
    rows = rows.select(*columns)
    blocked = rows.filter("severity = 'blocking' OR check_id IN ('ready', 'ready-after-exceptions')").select(*keys).distinct()
    clear = matters.select(*keys).distinct().join(blocked, keys, "left_anti")
    decided = resolutions.select(*keys).distinct().withColumn("_some", F.lit(True))
    clear = clear.join(decided, keys, "left").withColumn("_some", F.coalesce("_some", F.lit(False)))
    some = F.col("_some")
    ready = clear.select(
        *keys, F.when(some, "ready-after-exceptions").otherwise("ready").alias("check_id"), F.lit("pass").alias("severity"),
        F.when(some, "Ready with approved exceptions").otherwise("Ready to build").alias("label"),
        F.when(some, "No unresolved blocking issue remains; one or more technical exceptions are recorded below.")
        .otherwise("No blocking preflight issue was found.").alias("detail"),
        F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("policy"),
    )
    return rows.unionByName(ready)


def exclude_by_resolution(candidates: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """Excluded candidates, or candidates of excluded sources, become not included and not confirmed."""
    by_candidate = resolutions.filter("action = 'exclude-candidate'").select(*keys, "candidate_id").distinct()
    by_source = resolutions.filter("action = 'exclude-source'").select(
        *keys, F.col("source_id").alias("evidence_id"), "source_sha256"
    ).distinct()
    rows = candidates.join(by_candidate.withColumn("_c", F.lit(True)), [*keys, "candidate_id"], "left")
    rows = rows.join(by_source.withColumn("_s", F.lit(True)), [*keys, "evidence_id", "source_sha256"], "left")
    out = F.coalesce("_c", "_s", F.lit(False))
    rows = rows.withColumn("included", F.col("included") & ~out).withColumn("confirmed", F.col("confirmed") & ~out)
    return rows.drop("_c", "_s")


def skip_ocr(sources: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """Sources a reviewer lets through without recognised text."""
    exempt = resolutions.filter("action = 'proceed-without-ocr' AND source_sha256 IS NOT NULL")
    wide = exempt.filter("check_code LIKE 'ocr.%'").select(*keys, F.col("source_sha256").alias("sha256")).distinct()
    single = exempt.select(
        *keys, F.col("source_sha256").alias("sha256"), F.regexp_extract("blocker_id", "^ocr-(.*)$", 1).alias("source_id")
    ).distinct()
    a = sources.join(wide, [*keys, "sha256"], "left_semi")
    b = sources.join(single, [*keys, "sha256", "source_id"], "left_semi")
    return a.unionByName(b).dropDuplicates([*keys, "source_id"])


def template_fallback(resolutions: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Slots whose custom template may be replaced: only the exact template the reviewer saw.

    ``resolutions`` carries ``template_hashes`` (slot -> hash); ``templates``: keys, slot, sha256.
    """
    wanted = resolutions.filter("action = 'use-built-in-template'").select(*keys, F.explode("template_hashes").alias("slot", "sha256"))
    return wanted.join(templates, [*keys, "slot", "sha256"], "left_semi").select(*keys, "slot").distinct()


def template_gate(templates: DataFrame, keys: list[str]) -> DataFrame:
    """First reason why a custom template may not be used, null if none.

    ``templates``: keys, slot, format, declared_sha256, actual_sha256, rendered_declared,
    rendered_actual, reviewed_sha256, matter_confirmed_sha256, appearance_confirmed_sha256,
    placeholder_confirmed_sha256, has_placeholders.
    """
    def same(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) == F.col(b), F.lit(False))

    is_pdf = F.col("format") == "pdf"
    declared = F.coalesce("rendered_declared", F.when(is_pdf, F.col("declared_sha256")))
    reason = (
        F.when(~same("declared_sha256", "actual_sha256"), "template changed after it was selected")
        .when(~is_pdf & F.col("rendered_actual").isNull(), "no converted PDF")
        .when(~F.coalesce(declared == F.col("rendered_actual"), F.lit(False)), "rendered PDF differs from the reviewed one")
        .when(~same("reviewed_sha256", "rendered_actual"), "matter details not reviewed")
        .when(~same("matter_confirmed_sha256", "rendered_actual"), "matter details not confirmed")
        .when(~is_pdf & ~same("appearance_confirmed_sha256", "rendered_actual"), "appearance not confirmed")
        .when(F.col("has_placeholders") & ~same("placeholder_confirmed_sha256", "rendered_actual"), "placeholders not confirmed")
    )
    return templates.select(*keys, "slot", reason.alias("reason"))


def plan_issues(plan: DataFrame, nodes: DataFrame, keys: list[str], overhead: int, index_pages: int = 1) -> DataFrame:
    """Broken invariants of a plan, as rows: keys, issue, subject.

    ``plan``: keys, item_id, position, volume, physical_start, physical_end, total_pages;
    ``nodes``: flattened arrangement with keys, exhibit_id, position, section_id, heading.
    """
    repeated = plan.groupBy(*keys, "item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    a = plan.select(*keys, F.col("item_id").alias("id"), F.col("position").alias("plan_at"))
    b = nodes.select(*keys, F.col("exhibit_id").alias("id"), F.col("position").alias("index_at"))
    moved = a.join(b, [*keys, "id"], "full").filter("NOT (plan_at <=> index_at)")
    blank = nodes.filter("section_id IS NOT NULL AND (trim(section_id) = '' OR trim(coalesce(heading, '')) = '')")
    pages = plan.groupBy(*keys, "volume").agg(
        F.sum(F.col("physical_end") - F.col("physical_start") + 1).alias("pages"), F.max("total_pages").alias("total")
    )
    wrong = pages.filter(F.col("pages") + overhead != F.col("total"))

    def issue(rows: DataFrame, text: str, subject: str) -> DataFrame:
        return rows.select(*keys, F.lit(text).alias("issue"), F.col(subject).cast("string").alias("subject"))

    found = [
        issue(repeated, "exhibit id is not unique", "item_id"), issue(moved, "index and plan order differ", "id"),
        issue(blank, "section id or title is blank", "section_id"), issue(wrong, "volume total is wrong", "volume"),
    ]
    if index_pages < 1:
        found.append(issue(plan.select(*keys).distinct().withColumn("n", F.lit(index_pages)), "index has no page", "n"))
    return reduce(DataFrame.unionByName, found)


def readiness_blockers(
    counts: DataFrame, checks: DataFrame, keys: list[str], templates: DataFrame | None = None
) -> DataFrame:
    """Why a build cannot start: keys, blocker_id, label, detail, kind, target, action.

    ``counts``: keys, included_n, confirmed_n, pending_n. ``templates``: keys, name of each
    template whose review is open (a matter has at most one per slot). ``checks`` may carry file_name.
    """
    def row(rows: DataFrame, bid: Column, label: Column, detail: Column, kind: str, target: Column, action: Column) -> DataFrame:
        return rows.select(
            *keys, bid.alias("blocker_id"), label.alias("label"), detail.alias("detail"), F.lit(kind).alias("kind"),
            target.alias("target"), action.alias("action"),
        )

    lit = F.lit
    none = row(
        counts.filter("included_n = 0"), lit("no-included-exhibits"), lit("No exhibits included"),
        lit("Include at least one exhibit before building the exhibit bundle."), "state", lit("review"), lit("Return to exhibit review"),
    )
    n = F.greatest(F.col("included_n") - F.col("confirmed_n"), F.col("pending_n"))
    rows = counts.withColumn("n", n).filter("n > 0")
    one, number = F.col("n") == 1, F.col("n").cast("string")
    approvals = row(
        rows, lit("exhibit-approvals"), lit("Exhibit approvals required"),
        F.concat(number, lit(" included exhibit"), F.when(one, " is").otherwise("s are"),
                 lit(" still awaiting confirmation. Use the outstanding-approvals filter to locate "), F.when(one, "it").otherwise("them"), lit(".")),
        "approval", lit("review"), F.concat(lit("Review "), number, lit(" exhibit match"), F.when(one, "").otherwise("es")),
    )
    blocking = checks.filter("severity = 'blocking' AND label <> 'Unconfirmed exhibit'")
    file_name = F.col("file_name") if "file_name" in checks.columns else lit(None).cast("string")
    code = F.coalesce("code", lit(""))
    workbook = code.isin("workbook.no_sheet", "workbook.sheet_unreadable")
    template = code.startswith("template.")
    for_file = F.coalesce(F.concat(lit(" for "), file_name), lit(""))
    action = (
        F.when(workbook, F.concat(lit("Choose sheets"), for_file)).when(template, "Review template")
        .when(code.startswith("ocr."), F.concat(lit("Review OCR issue"), for_file))
        .when(F.col("candidate_id").isNotNull(), "Open the exhibit card")
        .when(file_name.isNotNull(), F.concat(lit("Review "), file_name)).otherwise("Review this issue")
    )
    specific = row(
        blocking, F.concat(lit("preflight-"), "check_id"), F.col("label"), F.col("detail"), "preflight",
        F.when(workbook, "sheets").when(template, "templates").otherwise("review"), action,
    )
    result = none.unionByName(approvals).unionByName(specific)
    if templates is None:
        return result
    per = templates.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.coalesce("name", lit("")) != "", F.col("name")))).alias("names")
    )
    size = F.size("names")
    named = F.concat(
        lit("Complete the outstanding template review"), F.when(size == 1, "").otherwise("s"), lit(": "), F.array_join("names", "; "), lit(".")
    )
    detail = F.when(size > 0, named).otherwise("Preview and confirm every selected custom template before building.")
    return result.unionByName(row(
        per, lit("template-approval"), lit("Template review required"), detail, "template", lit("templates"),
        F.when(size == 1, "Review template").otherwise("Review templates"),
    ))
