"""Steps that several findings share read their input once, whatever the number of results."""

from pyspark.sql import functions as F

from casefile.operators import quality


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 40")


def pages(spark):
    return spark.range(40).select(
        F.lit(1).alias("m"), (F.col("id") % 7).alias("source_id"), F.lit("h").alias("sha256"), F.col("id").alias("page"),
        F.when(F.col("id") % 3 == 0, 90).otherwise(0).alias("rotation"), F.when(F.col("id") % 9 != 0, F.col("id") % 2 == 0).alias("has_annotations"),
    )


def test_rotation_reads_pages_once(spark):
    checks, members = quality.rotation_checks(pages(spark), ["m"]), quality.page_members(pages(spark), ["m"])
    assert reads(checks) == reads(members) == 1
    assert checks.filter("severity = 'blocking'").count() == 4 and checks.count() == 11
    assert members.count() == 14 + 4


def test_copies_read_sources_once(spark):
    n = F.col("id")
    sources = spark.range(40).select(
        F.when(n < 30, F.lit(1)).alias("m"), F.concat(F.lit("e"), n).alias("source_id"), n.alias("source_seq"), F.concat(F.lit("f"), n).alias("name"),
        F.when(n % 10 != 7, F.concat(F.lit("h"), n % 10)).alias("sha256"),
    )
    selected = spark.createDataFrame([(1, "e1"), (1, "e1"), (1, "e7"), (1, "e22"), (1, "gone")], "m int, source_id string")
    found = quality.copy_checks(sources, selected, ["m"])
    assert reads(found) == 1
    rows = {(r.m, r.check_id): r.detail.split(" file")[0] for r in found.collect()}
    assert rows[1, "duplicate-h1"] == "Identical source hashes: 3" and rows[1, "duplicate-"] == "Identical source hashes: 3"
    assert rows[1, "duplicate-physical-copies"] == "4"  # not the file without a hash, whose twin is selected
    assert rows[1, "unreferenced"] == "27 supplied" and rows[None, "unreferenced"] == "10 supplied" and len(rows) == 13
    members = {(r.check_id, r.member) for r in quality.copy_members(sources, selected, ["m"]).collect()}
    assert {m for c, m in members if c == "duplicate-physical-copies"} == {"f11", "f21", "f2", "f12"}
    assert {m for c, m in members if c == "duplicate-h3"} == {"f3", "f13", "f23"} and len(members) == 4 + 27


def test_digests_are_packed_and_come_back(spark):
    digests = ["0a" * 32, "0A" * 32, "\n" * 32, "abc", "0abc", "x"]
    rows = [(1, f"e{i}", i, f"f{i}", digests[i % 6]) for i in range(12)]
    sources = spark.createDataFrame(rows, "m int, source_id string, source_seq int, name string, sha256 string")
    assert "_bytes" in quality.copy_checks(sources, sources.limit(0), ["m"])._jdf.queryExecution().optimizedPlan().toString()
    found = {r.check_id: r.detail for r in quality.copy_checks(sources, sources.limit(0), ["m"]).filter("label = 'Duplicate source files'").collect()}
    assert found == {f"duplicate-{d}": "Identical source hashes: 2 files." for d in digests}
    assert {r.check_id for r in quality.copy_members(sources, sources.limit(0), ["m"]).collect()} == set(found)
