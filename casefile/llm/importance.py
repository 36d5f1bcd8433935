"""Resampling of documents towards the word distribution of a target set, with an Aho-Corasick dictionary.

Features are runs of one or two consecutive words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.
The dictionary holds the most frequent distinct words, each between two delimiters, with its CRC and its length as
payload. One scan of the automaton over a text emits the payloads in order. The CRC of a word pair is composed from the
payloads of its two words, as the CRC of a concatenation is linear in the first part's CRC: no pair is ever spelt out.

The dictionary only saves time. It is bounded (``DICTIONARY`` words of up to ``LONGEST`` bytes, so 4 MB at most, sent to
every worker); words beyond it get the same payload from their own bytes, so results do not depend on it. Texts are
scanned in pieces of about ``PIECE`` bytes, whatever their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions.ordered import number_rows
from casefile.llm.common import stored

BUCKETS = 10_000
DICTIONARY = 65_536
LONGEST = 63
PIECE = 1 << 20
TALLY = 1 << 18
"""Distinct words a task counts before it hands them on."""
FULL = np.uint32(0xFFFFFFFF)
SPACE = 32
WORDS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else SPACE for c in range(256))
"""Lower-cases A-Z and turns every ASCII character but letters and digits into a space, byte by byte in UTF-8."""


def byte_steps() -> np.ndarray:
    """The CRC-32 table: what a register that holds one byte becomes after eight shifts."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


def shifts() -> np.ndarray:
    """[length, k, byte]: the register with ``byte`` in its k-th place after ``length`` zero bytes."""
    out = np.empty((LONGEST + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONGEST + 1):
        out[n] = STEP[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


STEP = byte_steps()
SHIFT = shifts()


def with_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of the words followed by one space."""
    register = crc ^ FULL
    return STEP[(register ^ SPACE) & 255] ^ (register >> 8) ^ FULL


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of concatenations, from the parts' CRCs and the second parts' lengths (up to ``LONGEST``)."""
    parts = [SHIFT[length, k, (first >> (8 * k)) & 255] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3] ^ second


def automaton_of(words: list[bytes]) -> ahocorasick.Automaton | None:
    """Words between delimiters; the payload is the CRC above six bits of length."""
    if not words:
        return None
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << 6 | len(w))
    out.make_automaton()
    return out


_KNOWN: dict[int, ahocorasick.Automaton | None] = {}


def worker_automaton(packed: bytes) -> ahocorasick.Automaton | None:
    """The automaton of space-separated words; a worker process keeps the last one."""
    key = hash(packed)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = automaton_of(packed.split())
    return _KNOWN[key]


def payloads(text: bytes, automaton: ahocorasick.Automaton | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, crc, length) of every word of ``text``, which begins and ends with a space."""
    blank = np.frombuffer(text, dtype=np.uint8) == SPACE
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    crc, known = np.zeros(len(starts), dtype=np.uint32), np.zeros(len(starts), dtype=bool)
    if automaton is not None and len(starts):
        emitted = np.fromiter(chain.from_iterable(automaton.iter(text.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        begins = np.zeros(len(text), dtype=bool)
        begins[emitted[:, 0] - (emitted[:, 1] & LONGEST)] = True
        known = begins[starts]
        crc[known] = (emitted[:, 1] >> 6).astype(np.uint32)
    other = np.flatnonzero(~known)
    crc[other] = [zlib.crc32(text[a:b]) for a, b in zip(starts[other].tolist(), ends[other].tolist())]
    return starts, crc, ends - starts


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """Texts to scan together, as (indexes, texts, whether the first goes on from the last piece). Long ones are cut at spaces."""
    indexes: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        text = text.translate(WORDS_ONLY)
        if indexes and size + len(text) > PIECE:
            yield indexes, held, False
            indexes, held, size = [], [], 0
        if len(text) <= PIECE:
            indexes.append(i)
            held.append(text)
            size += len(text)
            continue
        at = 0
        while at < len(text):
            stop = text.find(b" ", at + PIECE)
            stop = len(text) if stop < 0 else stop
            yield [i], [text[at:stop]], at > 0
            at = stop
    if indexes:
        yield indexes, held, False


def scan(texts: list[bytes], automaton: ahocorasick.Automaton | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of every feature, in pieces, and the index of every word."""
    last: np.uint32 | None = None
    for indexes, held, goes_on in pieces(texts):
        joined = b" " + b" ".join(held) + b" "
        begins = 1 + np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
        starts, crc, length = payloads(joined, automaton)
        if not len(starts):
            last = last if goes_on else None
            continue
        owner = np.array(indexes)[np.searchsorted(begins, starts, side="right") - 1]
        first, second, size, place = with_space(crc[:-1]), crc[1:], length[1:], starts[1:]
        same = owner[1:] == owner[:-1]
        first, second, size, place, whose = first[same], second[same], size[same], place[same], owner[1:][same]
        if goes_on and last is not None:
            first, second = np.concatenate((with_space(np.array([last], dtype=np.uint32)), first)), np.concatenate((crc[:1], second))
            size, place, whose = np.concatenate((length[:1], size)), np.concatenate((starts[:1], place)), np.concatenate((owner[:1], whose))
        pairs = composed(first, second, np.minimum(size, LONGEST))
        for i in np.flatnonzero(size > LONGEST).tolist():
            pairs[i] = zlib.crc32(joined[place[i] : place[i] + size[i]], int(first[i]))
        last = crc[-1]
        yield np.concatenate((owner, whose)), np.concatenate((crc, pairs)) % BUCKETS, owner


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, n) of all words up to ``LONGEST`` bytes of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            found = [(w, n) for w, n in tally.items() if len(w) <= LONGEST]
            tally.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in _bytes(batch.column(0)):
                text = text.translate(WORDS_ONLY)
                for at in range(0, len(text), PIECE):  # a word on a cut counts as two: the counts choose words, no more
                    tally.update(text[at : at + PIECE].split())
                    if len(tally) >= TALLY:
                        yield handed()
        yield handed()

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, most: int = DICTIONARY) -> bytes:
    """The most frequent words, space-separated: all those of so many occurrences that at most ``most`` words have as many."""
    counts = stored(word_counts(texts), "words")
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r.level: r.words for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}  # a few hundred levels
    least, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    if least is None:
        return b""
    return b" ".join(sorted(bytes(r.word) for r in counts.filter(level >= least).collect()))


def bucket_counts(texts: DataFrame, words: bytes) -> DataFrame:
    """Rows (bucket, n) over all features of ``texts`` (text)."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, total = worker_automaton(shared.value), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, buckets, _ in scan(_bytes(batch.column(0)), automaton):
                total += np.bincount(buckets, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame) -> list[int]:
    """Per bucket: floor(1000 * ln of its smoothed share in the target by that in the corpus). ``BUCKETS`` numbers."""
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    df = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    df = df.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    total = df.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return [r.gain for r in df.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).orderBy("bucket").collect()]  # beside one row


def weights(docs: DataFrame, words: bytes, gain: list[int]) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): the floored mean gain of a document's features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast((words, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, each = worker_automaton(shared.value[0]), np.array(shared.value[1], dtype=np.int64)
        for batch in batches:
            n, words_, total = batch.num_rows, np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            features = np.zeros(n, dtype=np.int64)
            for owner, buckets, of_words in scan(_bytes(batch.column(1)), automaton):
                features += np.bincount(owner, minlength=n)
                words_ += np.bincount(of_words, minlength=n)
                total += np.bincount(owner, weights=each[buckets], minlength=n).astype(np.int64)  # whole numbers far below 2 ** 53
            mean = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (words_, features, mean))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7", most: int = DICTIONARY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): (doc_id, n_words, n_features, weight, score, rank), all long but the id.

    ``weight`` is the floored mean of the gains of a document's features towards ``target`` (text); ``score`` adds Gumbel
    noise drawn from the id and ``seed``. Of the N documents with ``least_words`` words or more the floor(percent * N /
    100) highest scores are drawn, without replacement, and get ranks 1, 2, 3 ... in falling score, ties to the smaller
    doc_id; other ranks are null.

    Null and blank texts have no words: weight 0, never drawn. A null doc_id draws its noise from an empty id and comes
    first among ties; repeated rows stay rows, each with its own rank. Further columns of either table, whatever their
    names, are not looked at. Without documents there are no rows; with an empty target every feature has the target
    count zero. Texts of any length are scanned in pieces.
    """
    spark = docs.sparkSession
    words = dictionary(docs.select("text").union(target.select("text")), most)
    gain = gains(spark, bucket_counts(docs, words), bucket_counts(target, words))
    drawn = F.conv(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).substr(1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((drawn + 0.5) / 4294967296.0)) * -1000)
    scored = stored(weights(docs, words, gain).withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= least_words
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted runs of about even size, kept with their numbers: no task holds more than a run
    ordered = scored.filter(able).withColumn("_order", -F.col("score"))
    runs = stored(ordered.repartitionByRange(parts, "_order", "doc_id").withColumn("_run", F.spark_partition_id()), "runs")
    drawn_rows = runs.count() * percent // 100
    placed = number_rows(runs, [], ["_order", "doc_id", "n_features"], "rank", levels=["_run"])
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    first = placed.select(*columns, F.when(F.col("rank") <= drawn_rows, F.col("rank")).cast("long").alias("rank"))
    return first.union(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
