"""Numbering in order: groups that fit a chunk stay whole, larger ones go by their levels, with the same result."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casefile.functions import ordered
from casefile.operators import arrangement


def rows(spark):
    return spark.range(60).select(
        F.when(F.col("id") % 10 != 0, F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.when(F.col("id") > 9, F.floor(F.col("id") / 7)).alias("level")
    )


def test_small_groups_keep_no_totals(spark, monkeypatch):
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: pytest.fail("totals were written"))
    assert ordered.number_rows(rows(spark), ["k"], ["at"], "n", ["level"]).count() == 60
    assert ordered.running_max(rows(spark), ["k"], ["at"], "at", "m", ["level"]).count() == 60


@pytest.mark.parametrize("size", [5, 15, 18, 100])
def test_same_numbers_at_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "CHUNK", size)
    plain = Window.partitionBy("k").orderBy("at")
    got = ordered.number_rows(rows(spark), ["k"], ["at"], "n", ["level"])
    got = ordered.running_max(got, ["k"], ["at"], F.col("at") % 5, "m", ["level"])
    before = F.max(F.col("at") % 5).over(plain.rowsBetween(Window.unboundedPreceding, -1))
    want = rows(spark).withColumn("n", F.row_number().over(plain).cast("long")).withColumn("m", before)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("size", [5, 100])
def test_a_table_without_keys_is_one_group(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "CHUNK", size)
    got = ordered.number_rows(rows(spark), [], ["at"], "n", ["level"])
    assert sorted((r["at"], r["n"]) for r in got.collect()) == [(i, i + 1) for i in range(60)]
    got = ordered.running_max(rows(spark), [], ["at"], "at", "m", ["level"])
    assert sorted((r["at"], r["m"]) for r in got.collect() if r["at"]) == [(i, i - 1) for i in range(1, 60)]


def test_reconciled_rows_are_joined_once(spark):
    nodes = spark.createDataFrame([(1, p, None, None, None, f"c{p}") for p in range(1, 6)], "m int, pos long, section_id string, heading string, inner_pos long, exhibit_id string")
    ids = spark.createDataFrame([(1, 1, "c1"), (1, 2, "c4"), (1, 3, "new")], "m int, ord long, exhibit_id string")
    after = spark.createDataFrame([(1, "new", "c1")], "m int, exhibit_id string, after_id string")
    out = arrangement.reconcile_arrangement(nodes, ids, ["m"], after)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # places of tops and of inner rows
    assert [r.exhibit_id for r in out.orderBy("pos").collect()] == ["c1", "new", "c4"]
