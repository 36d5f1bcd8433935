"""Details of a matter found on its cover and index pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import text as T
from casefile.functions.patterns import END, START

# The shapes of labelled details.
ROLE_LINE = (
    rf"(?i)^(.{{2,180}}?)\s*\(?{START}(?:claimant|respondent|applicant|defendant|plaintiff|petitioner|appellant){END}\)?\s*$"
)
LABELLED_NUMBER = (
    rf"(?i){START}(?:case|matter|claim|arbitration|reference|ref\.?|proceedings?)\s*(?:number|no\.?|#)\s*[:.-]?\s*"
    r"([A-Z0-9][A-Z0-9 ./_-]{2,80})"
)
FORUM = (
    rf"(?i){START}(?:IN THE\s+.{{0,100}}?(?:COURT|TRIBUNAL)|(?:HIGH|SUPREME|CIRCUIT|DISTRICT|COMMERCIAL|CROWN|COUNTY)\s+COURT"
    r"|COURT OF APPEAL|ARBITRAL TRIBUNAL|INTERNATIONAL (?:COURT|CHAMBER|CENTRE)|LONDON COURT OF INTERNATIONAL ARBITRATION"
    r"|LCIA\s+ARBITRATION|ICC\s+(?:COURT|ARBITRATION)|SINGAPORE INTERNATIONAL ARBITRATION CENTRE"
    rf"|SINGAPORE INTERNATION ARBITRATION CENTRE){END}"
)
TITLE = r"(?i)^(.{2,110}?\s+(?:v\.?|vs\.?|versus)\s+.{2,110})$"
VERSUS = r"(?i)\s+(?:v\.?|vs\.?|versus)\s+"
MATTER_OF = r"(?i)^(IN THE MATTER OF\s+.{3,200})$"
PLACEHOLDERS = [
    r"\[[^\]\r\n]{2,100}\]", r"\{\{[^}\r\n]{2,100}\}\}", r"<<[^>\r\n]{2,100}>>",
    rf"(?i){START}(?:INSERT|ENTER|ADD)\s+(?:CASE|MATTER|CLAIM|PARTY|PARTIES|TRIBUNAL|COURT|TITLE|NUMBER|NO\.)[^\r\n]{{0,80}}",
    rf"(?i){START}(?:CASE|MATTER|CLAIM)\s*(?:NUMBER|NO\.?)\s*[:.-]?\s*_{{3,}}",
]
BETWEEN = rf"(?i)({START}BETWEEN\s*:?\s*$|{START}ARBITRATION BETWEEN{END})"
CONJUNCTION = r"(?i)^(?:and|v\.?|vs\.?|versus)$"
FIELD_LABEL = (
    rf"(?i)(^(?:icc\s+)?(?:case|matter|claim|arbitration|reference|document|bundle|place of arbitration|hearing){END}"
    rf"|{START}(?:case|matter|claim)\s*(?:number|no\.?|#)|editable|synthetic test|replace case details)"
)
WINDOW_LINES = 8
FIELDS = {
    "matter-number": "matter or case numbers", "party-name": "party names",
    "forum": "forum or tribunal details", "matter-title": "matter titles",
}


def _finish(rows: DataFrame, keys: list[str], characters: int | None = None) -> DataFrame:
    """Cleans the raw values; empty ones are no findings, nor, if asked for, those longer than ``characters``."""
    rows = rows.withColumn("value", T.clean_value("value")).filter("value <> ''")
    if characters is not None:
        rows = rows.filter(F.length("value") <= characters)
    return rows.withColumn("normalized", T.normalize_matter("value"))


def line_findings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Findings a single line shows. ``lines``: keys, role, line_no, text."""
    text = F.col("text")

    def one(kind: str, value: Column, test: Column) -> Column:
        return F.when(test, F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value"))))

    def group(pattern: str, index: int = 1) -> Column:
        return F.regexp_extract(text, pattern, index)

    title = group(TITLE)
    parties = F.transform(F.split(title, VERSUS, -1), lambda p: F.struct(F.lit("party-name").alias("kind"), p.alias("value")))
    forum = F.when(text.rlike(r"(?i)^\s*IN THE(?![A-Za-z0-9_])"), text).otherwise(group(FORUM, 0))
    found = [
        one("matter-number", group(LABELLED_NUMBER), text.rlike(LABELLED_NUMBER)),
        one("party-name", group(ROLE_LINE), text.rlike(ROLE_LINE)),
        one("matter-title", title, text.rlike(TITLE)),
        F.when(text.rlike(TITLE), parties),
        one("matter-title", group(MATTER_OF), text.rlike(MATTER_OF)),
        one("forum", forum, text.rlike(FORUM)),
    ]
    for pattern in PLACEHOLDERS:
        found.append(F.transform(T.extract_all(text, pattern), lambda p: F.struct(F.lit("placeholder").alias("kind"), p.alias("value"))))
    every = F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))
    # outer: a plain explode brings along a filter on the array, which would look for everything twice
    rows = lines.select(*keys, "role", "line_no", "text", F.explode_outer(every).alias("f")).filter("f.value IS NOT NULL")
    return _finish(rows.select(*keys, "role", "line_no", "text", "f.kind", "f.value"), keys)


def parties_between(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Party names in the lines after "BETWEEN", up to the first field label.

    The look-ahead is an equi-join: every line is offered to the eight lines before it.
    """
    place = [*keys, "role"]
    starts = lines.filter(F.col("text").rlike(BETWEEN)).select(*place, F.col("line_no").alias("start"))
    label = F.col("text").rlike(FIELD_LABEL) & ~F.col("text").rlike(CONJUNCTION)
    offered = lines.select(*place, "line_no", "text", label.alias("is_label")).withColumn(
        "start", F.explode(F.transform(F.sequence(F.lit(1), F.lit(WINDOW_LINES)), lambda k: F.col("line_no") - k))
    )
    near = offered.join(starts, [*place, "start"])
    stops = near.filter("is_label").groupBy(*place, "start").agg(F.min("line_no").alias("stop"))
    rows = near.join(stops, [*place, "start"], "left").filter("stop IS NULL OR line_no < stop")
    rows = rows.filter(~F.col("text").rlike(CONJUNCTION))
    role = F.regexp_extract("text", ROLE_LINE, 1)
    long_enough = F.length("text").between(3, 180)
    value = F.when(F.col("text").rlike(ROLE_LINE), role).when(long_enough, F.col("text"))
    found = rows.select(*place, "line_no", "text", F.lit("party-name").alias("kind"), value.alias("value"))
    return _finish(found.filter("value IS NOT NULL"), keys)


def matter_findings(lines: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "role", "line_no", "kind", "value", "normalized", "text"]
    return line_findings(lines, keys).select(*columns).unionByName(parties_between(lines, keys).select(*columns))


def dedupe_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per kind, place and normalised value; evidence lines of the place are merged and sorted."""
    return findings.groupBy(*keys, "role", "kind", "line_no", "normalized").agg(
        F.min("value").alias("value"), F.array_join(F.array_sort(F.collect_set("text")), "|").alias("evidence")
    )


def text_reliability(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Letters and digits of a template decide whether its extracted details can be relied on."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    agg = lines.groupBy(*keys).agg(F.sum(letters).cast("long").alias("characters"))
    band = F.when(F.col("characters") >= 24, "reliable").when(F.col("characters") > 0, "limited").otherwise("none")
    return agg.select(*keys, "characters", band.alias("reliability"))


def apply_patches(findings: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewer corrections of single findings; a blank one removes the finding.

    ``patches``: keys, role, finding_id, pdf_sha256, value; only those bound to the reviewed
    hash (``reviewed_sha256`` of the finding) count.
    """
    on = [*keys, "role", "finding_id"]
    rows = findings.join(patches.select(*on, F.col("pdf_sha256").alias("_hash"), F.col("value").alias("_new"), F.lit(True).alias("_p")), on, "left")
    bound = F.coalesce(F.col("_p") & (F.col("_hash") == F.col("reviewed_sha256")), F.lit(False))
    rows = rows.withColumn("value", F.when(bound, T.clean_value(F.coalesce("_new", F.lit("")))).otherwise(F.col("value")))
    return rows.filter("value <> ''").drop("_hash", "_new", "_p")


def effective_values(findings: DataFrame, confirmations: DataFrame, keys: list[str]) -> DataFrame:
    """A confirmed list replaces what was extracted, as long as it is bound to the reviewed hash.

    ``findings``: keys, role, kind, value, reviewed_sha256. ``confirmations``: keys, role,
    pdf_sha256, kind, value (one row per value; a null value confirms an empty list).
    """
    place = [*keys, "role"]
    bound = confirmations.select(*place, F.col("pdf_sha256").alias("reviewed_sha256"), "kind", "value")
    templates = findings.select(*place, "reviewed_sha256").distinct()
    current = bound.join(templates, [*place, "reviewed_sha256"], "left_semi")
    replaced = current.select(*place).distinct()
    extracted = findings.join(replaced, place, "left_anti").select(*place, "kind", "value")
    return extracted.unionByName(current.filter("value IS NOT NULL").select(*place, "kind", "value"))


def discrepancies(values: DataFrame, keys: list[str]) -> DataFrame:
    """Fields for which at least two templates have values and their normalised sets differ.

    Sets are bounded per template (a template is at most 25 pages); matters are compared by
    the smallest and largest set, so no matter is collected.
    """
    rows = values.filter(F.col("kind").isin(list(FIELDS))).withColumn("normalized", T.normalize_matter("value"))
    rows = rows.filter("normalized <> ''")
    per = rows.groupBy(*keys, "role", "kind").agg(
        F.array_join(F.array_sort(F.collect_set("normalized")), "\u001f").alias("set")
    )
    agg = per.groupBy(*keys, "kind").agg(
        F.count(F.lit(1)).alias("templates"), F.min("set").alias("low"), F.max("set").alias("high")
    ).filter("templates >= 2 AND low <> high")
    labels = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    message = F.concat(
        F.lit("The selected templates show different possible "), labels[F.col("kind")], F.lit(". Review the exact previews.")
    )
    return agg.select(*keys, F.col("kind").alias("field"), "templates", message.alias("message"))


def bundle_title(values: DataFrame, sources: DataFrame, keys: list[str], fallback: str) -> DataFrame:
    """Title of the first source that has one, else its two first parties, else its party.

    ``values``: keys, role, kind, ordinal, value. ``sources``: keys, role, priority.
    """
    filled = values.filter((F.trim("value") != "") & F.col("kind").isin("matter-title", "party-name"))
    title = F.min_by(F.when(F.col("kind") == "matter-title", F.trim("value")), F.when(F.col("kind") == "matter-title", F.col("ordinal")))
    is_party = F.col("kind") == "party-name"
    first = F.min(F.when(is_party, F.struct("ordinal", F.trim("value").alias("value"))))
    per = filled.groupBy(*keys, "role").agg(title.alias("title"), first.alias("p1"))
    rest = filled.filter(is_party).join(per.select(*keys, "role", F.col("p1.ordinal").alias("_o")), [*keys, "role"]).filter("ordinal > _o")
    second = rest.groupBy(*keys, "role").agg(F.min(F.struct("ordinal", F.trim("value").alias("value"))).alias("p2"))
    rows = sources.join(per, [*keys, "role"], "left").join(second, [*keys, "role"], "left")
    both = F.concat(F.col("p1.value"), F.lit(" v "), F.col("p2.value"))
    rows = rows.withColumn("found", F.coalesce("title", both, F.col("p1.value")))
    best = rows.groupBy(*keys).agg(F.min(F.when(F.col("found").isNotNull(), F.struct("priority", "found"))).alias("best"))
    return best.select(*keys, F.coalesce("best.found", F.lit(fallback)).alias("title"))
