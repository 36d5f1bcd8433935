"""Two-pass external shuffle into shards whose row counts differ by one at most.

Pass one scatters the rows by a seeded hash into buckets a task can hold in memory. Pass two orders each bucket, shuffles
it (Fisher-Yates, seeded per bucket) and writes it. A bucket's rows take the ranks after those of all earlier buckets;
shard s holds the ranks from s * rows / shards on. Nothing but bucket sizes is gathered anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.ordered import running_sum
from casefile.llm.common import cut

BUCKET_BYTES = 32 << 20
CHUNK = 65_536
"""Buckets whose sizes are added up in one task."""


def row_hash(docs: DataFrame, seed: int) -> Column:
    """Hash of a row by all its columns but maps: equal texts, and equal or null ids, spread; only rows equal in all of
    it stay together."""
    atoms = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    return F.xxhash64(F.lit(seed), *atoms)


def shuffle_into(docs: DataFrame, folder: str, shards: int = 40, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all rows of ``docs`` below ``folder``, one folder per shard, and returns the table read back.

    Adds ``shard`` and ``slot`` (place in the shard, from 0 without gaps); columns of these names in ``docs`` are
    replaced. The outcome depends on the rows, the seed and the parameters only. Null texts are empty. An empty input
    leaves an empty table. There are as many buckets as the bytes need, at any size.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot", "_order", "_bucket")]
    docs = docs.select(*kept)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    total, width = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-width // bucket_bytes))
    rows = docs.withColumn("_order", row_hash(docs, seed)).withColumn("_bucket", F.pmod(F.xxhash64("_order"), F.lit(buckets)))
    starts = rows.groupBy("_bucket").agg(F.count("*").alias("n")).withColumn("_chunk", F.floor(F.col("_bucket") / CHUNK))
    starts = running_sum(cut(starts), [], ["_bucket"], "n", "start", ["_chunk"], exclusive=True).select("_bucket", "start")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["_bucket"])
        order = pc.sort_indices(left, sort_keys=[("doc_id", "ascending"), ("_order", "ascending")])
        order = np.asarray(order).copy()
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)  # Fisher-Yates
        out = left.take(pa.array(order)).drop_columns(["_order"])
        rank = np.arange(left.num_rows, dtype=np.int64) + (right.column("start")[0].as_py() if right.num_rows else 0)
        shard = ((rank + 1) * shards - 1) // max(total, 1)
        slot = rank - shard * total // shards
        return out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes), "shard int", "slot bigint"])
    placed = rows.groupBy("_bucket").cogroup(starts.groupBy("_bucket")).applyInArrow(run, schema)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
