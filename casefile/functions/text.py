"""Text rules as Column expressions; only Unicode NFKC needs a Pandas UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from casefile.functions import patterns as P


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names an intermediate value, so that it is written (and evaluated) once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extract_all(column: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def split_at(column: Column | str, pattern: str) -> Column:
    """``split`` with the pattern compiled once, not for every row; texts that hold the mark itself are split the plain way."""
    text, mark = _col(column), "\u0000"
    marked = F.split(F.regexp_replace(text, pattern, mark), mark, -1)
    return F.when(text.contains(mark), F.split(text, pattern, -1)).otherwise(marked)


def trim_space(column: Column | str) -> Column:
    return F.btrim(_col(column), F.lit(P.SPACE_CHARACTERS))


def normalize_ws(column: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(column), f"{P.SPACE}+", " "))


def _code_point(number: Column) -> Column:
    """The character of a code point; null for surrogates and out-of-range numbers."""
    valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _replace_numeric(column: Column, pattern: str, to_number: Callable[[Column], Column]) -> Column:
    """Replaces every match of ``pattern`` by the character its first group names."""
    pieces = F.split(column, pattern, -1)
    characters = F.transform(
        F.arrays_zip(extract_all(column, pattern, 0).alias("whole"), extract_all(column, pattern, 1).alias("digits")),
        lambda m: F.coalesce(_code_point(to_number(m["digits"])), m["whole"]),
    )
    woven = F.zip_with(pieces, characters, lambda piece, char: F.concat(piece, F.coalesce(char, F.lit(""))))
    return F.when(column.rlike(pattern), F.array_join(woven, "")).otherwise(column)


def decode_entities(column: Column | str) -> Column:
    """Numeric references first, then the named ones, the ampersand last."""
    text = _replace_numeric(_col(column), r"&#0*(\d{1,9});", lambda d: d.cast("long"))
    text = _replace_numeric(text, r"(?i)&#x0*([0-9a-f]{1,8});", lambda d: F.conv(d, 16, 10).cast("long"))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def ascii_fold(column: Column | str) -> Column:
    folded = F.translate(_col(column), "–—‘’“”", "--''\"\"")
    return F.regexp_replace(folded, r"[^\x09\x0A\x0D\x20-\x7E]", "")


def html_to_text(column: Column | str) -> Column:
    """Tag removal in the order the rule lists its steps."""
    text = _col(column)
    # Fixed values: (pattern, replacement), applied in this order.
    steps = [
        (r"(?i)<\s*(script|style|iframe|object)[^>]*>[\s\S]*?<\s*/\s*\1\s*>", ""),
        (r"(?i)<\s*br\s*/?>", "\n"),
        (r"(?i)<\s*/\s*(p|div|li|tr|h[1-6])\s*>", "\n"),
        (r"<[^>]+>", " "),
        (r"(?i)&nbsp;", " "),
        (r"(?i)&amp;", "&"),
        (r"(?i)&lt;", "<"),
        (r"(?i)&gt;", ">"),
        (r"\n{3,}", "\n\n"),
        (r"[ \t]+", " "),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return trim_space(text)


def markup_paragraphs(column: Column | str, block: str = "w:p", run: str = "w:t") -> Column:
    """Array of non-empty block texts; runs inside a block are joined without a separator."""
    blocks = extract_all(_col(column), rf"<{block}(?:\s[^>]*)?>[\s\S]*?</{block}>")

    def text_of(piece: Column) -> Column:
        runs = extract_all(piece, rf"<{run}(?:\s[^>]*)?>([\s\S]*?)</{run}>", 1)
        return normalize_ws(F.array_join(F.transform(runs, decode_entities), ""))

    return F.filter(F.transform(blocks, text_of), lambda text: text != "")


def tokens(column: Column | str) -> Column:
    """Distinct content words for matching."""
    words = F.split(F.regexp_replace(F.lower(_col(column)), "[^a-z0-9]+", " "), " ")
    stop = F.array(*[F.lit(w) for w in P.STOP_WORDS])
    kept = F.filter(words, lambda w: F.length(w) > 3)
    return F.array_except(kept, stop)


def fingerprint(column: Column | str, words: int | None = None) -> Column:
    """Distinct long words of the whole text, or of its first ``words`` long words: that cut comes first."""
    cleaned = F.regexp_replace(F.lower(_col(column)), "[^a-z0-9 ]", " ")
    kept = F.filter(F.split(cleaned, " +"), lambda w: F.length(w) > 3)
    return F.array_distinct(kept if words is None else F.slice(kept, 1, words))


def _with_year(date: Column, default_year: int) -> Column:
    return F.when(date.rlike(r"\d{4}$"), date).otherwise(F.concat(date, F.lit(f" {default_year}")))


def extract_dates(column: Column | str, default_year: int = 2026) -> Column:
    found = extract_all(_col(column), f"(?i){P.START}{P.DATE}{P.END}")
    return F.transform(found, lambda d: _with_year(d, default_year))


def extract_date(column: Column | str, default_year: int = 2026) -> Column:
    first = F.regexp_extract(_col(column), f"(?i){P.START}{P.DATE}{P.END}", 0)
    return F.when(first == "", F.lit(P.NO_DATE)).otherwise(_with_year(first, default_year))


def describe(
    column: Column | str,
    date: Column | str,
    rules: Sequence[tuple[list[list[str]], str]] = P.DESCRIPTION_RULES,
    default: str = P.DESCRIPTION_DEFAULT,
) -> Column:
    """First rule, in list order, one of whose keyword alternatives is wholly present."""
    lower, date = F.lower(_col(column)), _col(date)

    def label(template: str) -> Column:
        return F.replace(F.lit(template), F.lit("{date}"), date)

    result = None
    for alternatives, template in rules:
        hit = F.lit(False)
        for keywords in alternatives:
            every = F.lit(True)
            for keyword in keywords:
                every = every & lower.contains(keyword)
            hit = hit | every
        result = F.when(hit, label(template)) if result is None else result.when(hit, label(template))
    return label(default) if result is None else result.otherwise(label(default))


def split_clauses(column: Column | str) -> Column:
    parts = F.transform(split_at(column, P.CLAUSE_BREAK), trim_space)
    return F.filter(parts, lambda part: part != "")


def has_document_noun(column: Column | str) -> Column:
    return _col(column).rlike(P.DOCUMENT_NOUN)


def document_noun_phrase(column: Column | str, noun: str = P.LEDGER_NOUN) -> Column:
    """Optional article, at most one modifier that is not a function word, and the noun; null if none."""
    blocked = "|".join(rf"{word}{P.END}" for word in P.NOT_MODIFIER)
    modifier = rf"(?:(?!{blocked})[A-Za-z][A-Za-z'-]*\s+)?"
    phrase = F.regexp_extract(
        _col(column), rf"(?i){P.START}(?:(?:the|a|an)\s+)?({modifier}{noun}){P.END}", 1
    )
    cleaned = normalize_ws(phrase)
    return F.when(cleaned != "", cleaned)


def clause_attaches(clause: Column) -> Column:
    """One clause that attaches a document: passive form, or "I attach ... <noun>"."""
    target = F.regexp_extract(clause, P.ACTIVE_ATTACH, 1)
    before = F.regexp_extract(target, rf"(?is)^(.*?){P.START}{P.NOUN}{P.END}", 1)
    blocked = before.rlike(rf"(?i){P.START}{P.NOT_OBJECT}{P.END}") | before.rlike(rf"(?i){P.START}(?:to|for)\s+$")
    return clause.rlike(P.PASSIVE_ATTACH) | (target.rlike(P.DOCUMENT_NOUN) & ~blocked)


def is_governed_attach(column: Column | str) -> Column:
    return F.exists(split_clauses(column), clause_attaches)


def is_narrative(column: Column | str) -> Column:
    text = _col(column)
    wording = text.rlike(P.REFER) | text.rlike(P.IS_EXHIBITED) | text.rlike(P.MARKED_AS) | text.rlike(P.COPY_EXHIBIT)
    return has_document_noun(text) & wording


def normalize_mark(column: Column | str, prefix: str = "AH") -> Column:
    text = _col(column)
    digits = F.regexp_extract(text, P.mark(prefix), 1)
    plain = F.upper(F.regexp_replace(text, f"{P.SPACE}+", ""))
    return F.when(digits != "", F.concat(F.lit(prefix), digits.cast("int").cast("string"))).otherwise(plain)


def source_marker(column: Column | str, prefix: str = "AH") -> Column:
    """``N/A``, the normalised mark, or null."""
    pattern = rf"(?i){P.START}EXHIBIT\s+({prefix}\s*\d{{1,9}}|N/A){P.END}"
    raw = F.upper(F.regexp_extract(_col(column), pattern, 1))
    return F.when(raw == "N/A", raw).when(raw != "", normalize_mark(raw, prefix))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [unicodedata.normalize("NFKC", x) for x in v])


def _fold_matter(text: Column) -> Column:
    dashes = F.regexp_replace(text, r"[\u2010-\u2015]", "-")
    return F.upper(F.regexp_replace(dashes, rf"{P.SPACE}*([/,:&()\-]){P.SPACE}*", "$1"))


NON_ASCII = r"[^\x00-\x7f]"


def normalize_matter(column: Column | str) -> Column:
    """Comparison form of a party, number, forum or title. ASCII text never leaves the JVM form."""
    text = normalize_ws(column)
    unicode_form = _nfkc(F.when(text.rlike(NON_ASCII), text))
    return _fold_matter(F.coalesce(unicode_form, text))


def clean_value(column: Column | str) -> Column:
    text = F.regexp_replace(normalize_ws(column), r"^[\s:;,.\-]+", "")
    return F.regexp_replace(text, r"[\s;,.\-]+$", "")


def parse_value_list(column: Column | str, items: int | None = None, characters: int | None = None) -> Column:
    """Cleaned values, first spelling of each; if asked for, at most ``items`` and none longer than ``characters``."""
    parts = F.transform(F.split(_col(column), r"[\n;]+"), clean_value)
    usable = F.filter(parts, lambda v: (v != "") & (F.lit(True) if characters is None else F.length(v) <= characters))
    exotic = F.exists(usable, lambda v: v.rlike(NON_ASCII))
    keys = F.transform(F.coalesce(_nfkc_each(F.when(exotic, usable)), usable), _fold_matter)
    pairs = F.arrays_zip(usable.alias("value"), keys.alias("key"))
    nothing = F.array().cast("array<struct<value:string,key:string>>")

    def keep(kept: Column, pair: Column) -> Column:
        seen = F.exists(kept, lambda k: k["key"] == pair["key"])
        full = F.lit(False) if items is None else F.size(kept) >= items
        return F.when(full | (pair["key"] == "") | seen, kept).otherwise(
            F.concat(kept, F.array(pair))
        )

    return F.transform(F.aggregate(pairs, nothing, keep), lambda p: p["value"])


def confidence_band(score: Column | str) -> Column:
    score = _col(score)
    return F.when(score >= 90, "High").when(score >= 65, "Medium").otherwise("Review")


def match_strength(score: Column | str, chosen_by_reviewer: Column) -> Column:
    score = _col(score)
    return (
        F.when(chosen_by_reviewer, "Selected by you")
        .when(score >= 90, "Strong suggested match")
        .when(score >= 65, "Possible suggested match")
        .otherwise("Needs review")
    )


def safe_name(column: Column | str, ordinal: Column | str) -> Column:
    base = trim_space(F.substring_index(F.regexp_replace(_col(column), r"\\", "/"), "/", -1))
    base = F.when(base == "", "Unnamed attachment").otherwise(base)
    cleaned = F.regexp_replace(base, r'[<>:"|?*\x00-\x1f]', "_")
    cleaned = trim_space(F.substring(F.regexp_replace(cleaned, r"^\.+", "_"), 1, 180))
    return F.when(cleaned == "", F.concat(F.lit("attachment-"), _col(ordinal))).otherwise(cleaned)


def infer_extension(name: Column | str, mime: Column | str) -> Column:
    suffix = F.lower(F.substring_index(_col(name), ".", -1))
    mime = F.lower(_col(mime))
    tail = F.regexp_replace(F.substring_index(mime, "/", -1), "[^a-z0-9]", "")
    return (
        F.when(suffix.rlike("^[a-z0-9]{1,8}$"), suffix)
        .when(mime.contains("pdf"), "pdf")
        .when(mime.contains("wordprocessingml") | (mime == "application/msword"), "docx")
        .when(mime.contains("rfc822"), "eml")
        .when(mime.contains("spreadsheetml") | mime.contains("excel"), "xlsx")
        .when(mime.startswith("text/plain"), "txt")
        .when(tail != "", tail)
        .otherwise("bin")
    )


def roman(number: Column | str) -> Column:
    """Lower-case roman numeral."""
    # Symbols and their amounts, largest first.
    symbols = [
        (1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"),
        (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"),
    ]
    remainder, parts = _col(number).cast("long"), []
    for amount, symbol in symbols:
        parts.append(F.repeat(F.lit(symbol), F.floor(remainder / amount).cast("int")))
        remainder = remainder % amount
    return F.concat(*parts)


def email_account(header: Column | str, default: str = "Email correspondence") -> Column:
    header = _col(header)
    angled = F.regexp_extract(header, r"<([^<>@\s]+@[^<>@\s]+)>", 1)
    bare = F.regexp_extract(header, rf"{P.START}[^\s<>@]+@[^\s<>@]+{P.END}", 0)
    return F.when(angled != "", angled).when(bare != "", bare).otherwise(F.lit(default))
