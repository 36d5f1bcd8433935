"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.operators.components import components  # noqa: F401  (used by several operators)
from casefile.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
"""White space of the contracts: U+0020 and U+0009 to U+000D."""
SPACE_RUN = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (``spark.checkpoint.dir``)."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors share; nothing is created."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        cut_lineage(spark.range(1))  # sets the folder of a local session, or raises on a cluster without one
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: cuts the lineage like ``cut``, in less space."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. For pure ASCII text that is ``lower``, which is many times faster than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def split_words(text: Column) -> Column:
    """Maximal runs of non-white-space characters; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def count_of(text: Column, characters: str) -> Column:
    """Number of occurrences of the given ASCII characters."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")
