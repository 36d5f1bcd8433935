"""Quality rules whose limits follow the corpus: per language and source, from mergeable quantile sketches.

The sketch is a histogram with log-linear buckets (a value keeps its six leading bits, so a bucket is at most 1/32 of
its value wide). Histograms merge by adding counts: partial aggregates in the map tasks, then per (language, source), per
language from those, and over the corpus from those. A group's quartiles are drawn towards its language's, and a
language's towards the corpus's, as if each group had ``prior`` documents more of that kind: one formula at every size,
in which small groups follow their language and large ones themselves. Everything is integer arithmetic, so the outcome
does not depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.llm.common import cut, count_of, split_words

SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    """Parameters of the adaptive rules.

    ``spread``: how many times the distance from the median to the quartile a value may lie beyond the median.
    ``slack``: what it may lie beyond in any case, in thousandths (symbols, shouts, repeated words and duplicate lines
    per word; characters per word). ``prior``: how many documents of its language count in a group, and of the corpus in
    a language, beside its own.
    """

    spread: int = 6
    slack: tuple[tuple[str, int], ...] = (("symbols", 100), ("shouts", 100), ("repeats", 350), ("dup_lines", 100), ("length", 2000))
    prior: int = 50


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, ``n_shouts`` and ``base_failed``. A null text has no words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    df = docs.withColumn("_w", split_words(F.col(text)))
    n = F.size("_w")
    shingle = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_h", F.when(n < 3, none).otherwise(F.transform(F.sequence(F.lit(0), n - 3), shingle)))
    df = df.withColumns({"n_words": n.cast("long"), "_repeats": F.size(F.array_distinct("_h")) < F.size("_h")}).drop("_w")
    # only texts with a repeated window sort their windows; the others have no repeated words
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.col("_repeats"), F.sort_array(pairs))).drop("_h", "_repeats")
    same = lambda x, j: F.coalesce(F.get("_s", j)["h"] == x["h"], F.lit(False))
    found = F.filter("_s", lambda x, i: same(x, F.when(i > 0, i - 1)) | same(x, i + 1))
    df = df.withColumn("_p", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("_s")
    # each window covers three words, or up to the next one
    covered = F.transform("_p", lambda p, i: F.coalesce(F.least(F.get("_p", i + 1) - p, F.lit(3)), F.lit(3)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_p")
    df = df.withColumns(
        {
            "word_chars": F.char_length(body).cast("long") - count_of(body, " \t\n\x0b\x0c\r"),
            "n_symbols": count_of(body, SYMBOLS),
            "n_shouts": count_of(body, SHOUTS),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _rates() -> dict[str, Column]:
    """Whole thousandths per word."""
    per = lambda c: F.expr(f"{c} * 1000 div n_words")
    return {"symbols": per("n_symbols"), "shouts": per("n_shouts"), "repeats": per("n_repeat_words"), "dup_lines": per("n_dup_lines"), "length": per("word_chars")}


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number >= 0: its six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(df: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows (groups, metric, bucket, n): the histogram of every metric in every group."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in values.items()]))
    return df.select(*groups, each.alias("_m")).select(*groups, "_m.metric", "_m.bucket").groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n"))


def merge(histogram: DataFrame, groups: list[str]) -> DataFrame:
    """The sketch of coarser groups: counts add up."""
    return histogram.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(histogram: DataFrame, groups: list[str], at: dict[str, int]) -> DataFrame:
    """Per group and metric the bucket that holds each percentile, and the group's ``size``.

    A histogram has a bounded number of buckets (32 for each doubling), so the window is small for any group.
    """
    by = Window.partitionBy(*groups, "metric")
    df = histogram.withColumn("size", F.sum("n").over(by)).withColumn("_upto", F.sum("n").over(by.orderBy("bucket")))
    picks = [F.min(F.when(F.col("_upto") * 100 >= F.col("size") * p, F.col("bucket"))).alias(k) for k, p in at.items()]
    return df.groupBy(*groups, "metric").agg(F.max("size").alias("size"), *picks)


def drawn(own: DataFrame, wider: DataFrame, groups: list[str], prior: int) -> DataFrame:
    """The quartiles of ``own`` (groups, metric, size, q25, q50, q75) drawn towards those of ``wider``, which has fewer of
    the group columns: the mean of both, weighted by the group's size and ``prior``, rounded down."""
    shared = [c for c in groups if c in wider.columns]
    same = F.col("metric") == F.col("_metric")
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    wider = wider.select(*[F.col(c).alias(f"_{c}") for c in [*shared, "metric", "q25", "q50", "q75"]])
    mean = [F.expr(f"(size * {q} + {prior} * _{q}) div (size + {prior})").alias(q) for q in ("q25", "q50", "q75")]
    return own.join(wider, same).select(*groups, "metric", "size", *mean)


def limits(q: DataFrame, groups: list[str], rule: Limits) -> DataFrame:
    """One row per group from its quartiles: ``hi_<metric>`` for each metric, and ``lo_length``."""
    slack = F.create_map(*[F.lit(x) for pair in rule.slack for x in pair])[F.col("metric")]
    hi = F.col("q50") + rule.spread * (F.col("q75") - F.col("q50")) + slack
    lo = F.col("q50") - rule.spread * (F.col("q50") - F.col("q25")) - slack
    one = lambda name, value: F.max(F.when(F.col("metric") == name, value))
    columns = [one(k, hi).alias(f"hi_{k}") for k, _ in rule.slack] + [one("length", lo).alias("lo_length")]
    return q.groupBy(*groups).agg(*columns)


def judge(measures: DataFrame, rule: Limits = Limits()) -> DataFrame:
    """Adds ``kept`` to the rows of ``measured`` (which it reads twice: pass a checkpoint or a table).

    Limits come from the documents that pass the base rules. A null language or source is a group like any other.
    """
    names = [f"hi_{k}" for k, _ in rule.slack] + ["lo_length"]
    fine = measures.filter(~F.col("base_failed"))
    by_source = cut(sketch(fine, ["lang", "source"], _rates()))
    by_language = cut(merge(by_source, ["lang"]))
    at = {"q25": 25, "q50": 50, "q75": 75}
    language = drawn(quantiles(by_language, ["lang"], at), quantiles(merge(by_language, []), [], at), ["lang"], rule.prior)
    own = drawn(quantiles(by_source, ["lang", "source"], at), language, ["lang", "source"], rule.prior)
    table = limits(own, ["lang", "source"], rule).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *names)
    df = measures.join(table, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    rates = _rates()
    bad = F.lit(False)
    for k, _ in rule.slack:
        bad = bad | F.coalesce(bucket(rates[k]) > F.col(f"hi_{k}"), F.lit(False))
    bad = bad | F.coalesce(bucket(rates["length"]) < F.col("lo_length"), F.lit(False))
    return df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~bad)).drop("_lang", "_source", *names)


def assess(docs: DataFrame, rule: Limits = Limits()) -> DataFrame:
    """Per document (doc_id, lang, source, base counts, n_shouts, base_failed, kept); other columns go.

    Empty and null texts fail the base rules. Rows repeated in full come out alike. No documents, no rows.
    """
    slim = measured(docs.select("doc_id", "text", "lang", "source")).withColumn("_key", F.xxhash64("text")).drop("text")
    return judge(cut(slim), rule)


def filter_documents(docs: DataFrame, rule: Limits = Limits()) -> DataFrame:
    """The documents that ``assess`` keeps, with all their columns."""
    good = assess(docs, rule).filter("kept").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "lang", "source")], F.col("_key").alias("__key")).distinct()
    same = F.xxhash64(docs["text"]) == good["__key"]
    for c in ("doc_id", "lang", "source"):
        same = same & docs[c].eqNullSafe(good[f"_{c}"])
    return docs.join(good, same, "left_semi")
