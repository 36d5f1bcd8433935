"""Matter-shaped tables derived from the given star-schema tables.

The given tables hold no statements, exhibits or arrangements, so the operators run over
these views. ``casefile.plans.sql`` states the same views for the reference engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions.ordered import number_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have: a file of few bytes is read in one task, whatever its rows cost later."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def long_date(column: str) -> Column:
    return F.date_format(column, "d MMMM yyyy")


def _numbered_orders(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Orders with ``matter_id`` and the dense position ``seq`` inside the matter."""
    needed = list(dict.fromkeys(["o_orderkey", "o_custkey", "o_orderdate", *columns]))
    orders = (
        table(spark, folder, "orders")
        .select(*needed)
        .withColumn("matter_id", F.col("o_custkey"))
        .withColumn("_month", F.trunc("o_orderdate", "month"))
        .withColumn("_day", F.to_date("o_orderdate"))
    )
    numbered = number_rows(orders, ["matter_id"], ["o_orderdate", "o_orderkey"], "seq", ["_month", "_day"])
    return numbered.drop("_month", "_day")


def statement(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs: matter_id, seq, number, text."""
    rows = _numbered_orders(spark, folder).select(
        "matter_id",
        "seq",
        (F.col("o_orderkey") % 8).alias("k"),
        (F.col("o_custkey") % 3 + 1).cast("string").alias("m"),
        (F.col("o_orderkey") % 90 + 1).cast("string").alias("a"),
        (F.col("o_orderkey") % 90 + 3).cast("string").alias("b"),
        long_date("o_orderdate").alias("d"),
    )
    k, m, a, b, d = (F.col(c) for c in ("k", "m", "a", "b", "d"))

    def join(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    text = (
        F.when(k == 0, join("I refer to the invoice dated ", d, " [AH", m, "/", a, "-", b, "]."))
        .when(k == 1, join("I refer to the email [AH-xx; AH-xx] and to the report dated ", d, "."))
        .when(k == 2, join("I attach the contract. It was signed on ", d, "."))
        .when(k == 3, F.lit("The meeting (March 3) was short. See (para 12)."))
        .when(k == 4, join("A copy of the letter dated ", d, " is exhibited (BB-12)."))
        .when(k == 5, F.lit("I refer to the report of Dr. Smith [RC 1 / xx]; I also refer to the notice [RC1/3]."))
        .when(k == 6, F.lit("The invoice was attached to that email."))
        .otherwise(join("I enclose the purchase orders dated ", d, " (CC-xx, CCxx, CC-x)."))
    )
    return rows.select("matter_id", "seq", F.col("seq").cast("int").alias("number"), text.alias("text"))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Source files: matter_id, source_seq, source_id, name, extension, text, sha256, pages, marker."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("matter_id", F.col("o_custkey"))
        .withColumn("_wide", F.shiftright("l_orderkey", 16))
        .withColumn("_narrow", F.shiftright("l_orderkey", 6))
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    numbered = number_rows(joined, ["matter_id"], order, "source_seq", ["_wide", "_narrow"])
    kind = F.col("l_linenumber") % 5
    extension = (
        F.when(kind == 0, "pdf").when(kind == 1, "docx").when(kind == 2, "eml").when(kind == 3, "xlsx").otherwise("txt")
    )
    text = F.concat(
        F.lit("invoice report for "), "p_name", F.lit(" "), F.lower("p_type"), F.lit(" dated "), long_date("o_orderdate")
    )
    stem = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_type"))
    rows = numbered.select(
        "matter_id",
        "source_seq",
        F.concat(F.lit("e"), F.col("source_seq").cast("string")).alias("source_id"),
        F.concat(stem, F.lit("."), extension).alias("name"),
        extension.alias("extension"),
        text.alias("text"),
        F.col("l_quantity").cast("int").alias("pages"),
    )
    marker = (
        F.when(F.col("source_seq") % 7 == 3, F.concat(F.lit("AH"), F.col("source_seq").cast("string")))
        .when(F.col("source_seq") % 11 == 5, F.lit("N/A"))
    )
    return rows.withColumn("sha256", F.sha2("text", 256)).withColumn("marker", marker)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed candidates, one per order."""
    rows = _numbered_orders(spark, folder, "o_orderpriority")
    key = F.col("o_orderkey")
    no_source = key % 13 == 0
    return rows.select(
        "matter_id",
        F.concat(F.lit("c"), key.cast("string")).alias("candidate_id"),
        "seq",
        F.col("seq").cast("int").alias("paragraph"),
        F.when(~no_source, F.concat(F.lit("e"), (key % 9).cast("string"))).alias("evidence_id"),
        F.when(~no_source, F.concat(F.lit("h"), (key % 7).cast("string"))).alias("source_sha256"),
        (key % 11 != 0).alias("included"),
        (key % 5 != 0).alias("confirmed"),
        (key % 17 == 0).alias("manual_addition"),
        F.when(key % 4 == 0, "same").when(key % 4 == 1, "separate").when(key % 4 == 2, "pending").alias("repeat_decision"),
        F.lit("AH1").alias("bundle_mark"),
        F.concat("o_orderpriority", F.lit(" document")).alias("description"),
        long_date("o_orderdate").alias("date_text"),
        F.when(key % 3 == 0, 1).otherwise(2).alias("page_start"),
        (key % 20 + 1).cast("int").alias("content_pages"),
        (key % 2).cast("int").alias("optional_pages"),
        F.when(key % 3 == 0, "pdf").when(key % 3 == 1, "docx").otherwise("eml").alias("extension"),
        F.when((key % 23 == 0) & ~no_source, F.concat(F.lit("h"), (key % 5).cast("string"))).alias("parent_sha256"),
    )


def arrangement(spark: SparkSession, folder: str) -> DataFrame:
    """Two-level order: blocks of three, every second block under a heading."""
    rows = _numbered_orders(spark, folder)
    block = F.floor((F.col("seq") - 1) / 3).cast("int")
    headed = block % 2 == 1
    label = block.cast("string")
    return rows.select(
        "matter_id",
        block.alias("block"),
        F.col("seq").cast("int").alias("seq"),
        F.when(headed, F.concat(F.lit("s"), label)).alias("section_id"),
        F.when(headed, F.concat(F.lit("Heading "), label)).alias("heading"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("exhibit_id"),
    )


def arrangement_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The same arrangement as node rows: matter_id, pos, section_id, heading, inner_pos, exhibit_id."""
    rows = arrangement(spark, folder)
    headed = F.col("section_id").isNotNull()
    # top-level position: every headed block before this one takes one place, not three
    earlier_headed = F.floor(F.col("block") / 2)
    inside = F.col("seq") - F.col("block") * 3
    pos = F.col("block") * 3 - earlier_headed * 2 + F.when(headed, 1).otherwise(inside)
    return rows.select(
        "matter_id",
        pos.cast("long").alias("pos"),
        "section_id",
        "heading",
        F.when(headed, inside).cast("long").alias("inner_pos"),
        "exhibit_id",
    )


def snapshot_prev(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").filter(key % 19 != 0).select(
        F.col("o_custkey").alias("matter_id"),
        F.concat(F.lit("c"), key.cast("string")).alias("exhibit_id"),
        F.concat(F.lit("h"), (key % 7).cast("string")).alias("source_sha256"),
        F.col("o_orderpriority").alias("description"),
        long_date("o_orderdate").alias("date_text"),
        (F.col("o_orderstatus") == "F").alias("confirmed"),
        (key % 4).cast("int").alias("page_start"),
    )


def snapshot_cur(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    changed_source = F.when(key % 29 == 0, key % 5).otherwise(key % 7)
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").filter(key % 37 != 0).select(
        F.col("o_custkey").alias("matter_id"),
        F.concat(F.lit("c"), key.cast("string")).alias("exhibit_id"),
        F.concat(F.lit("h"), changed_source.cast("string")).alias("source_sha256"),
        F.when(key % 23 == 0, F.concat(F.lit("Amended "), priority)).otherwise(priority).alias("description"),
        long_date("o_orderdate").alias("date_text"),
        F.when(key % 31 == 0, True).otherwise(F.col("o_orderstatus") == "F").alias("confirmed"),
        (key % 4).cast("int").alias("page_start"),
    )


def journal(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("journal_id"),
        F.col("event_id").alias("arrival"),
        F.floor(F.col("value") * 10).cast("long").alias("revision"),
        F.col("event_type").alias("action"),
    )


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("turn")
    half = (F.floor(turn / 2) + 1).cast("int").cast("string")
    kind = (F.col("conv_id") + turn) % 6
    suffix = (
        F.when(kind == 0, ".pdf").when(kind == 1, ".docx").when(kind == 2, ".eml")
        .when(kind == 3, ".xlsx").when(kind == 4, ".txt").otherwise(".png")
    )
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("parent_id"),
        turn.cast("int").alias("turn"),
        F.when(turn % 2 == 0, half).otherwise(F.concat(half, F.lit(".1"))).alias("ordinal"),
        F.concat(F.col("role"), F.lit("/"), turn.cast("string"), suffix).alias("raw_name"),
        (F.length("text").cast("long") * 20000).alias("bytes"),
        F.sha2("text", 256).alias("child_sha256"),
    )


def source_pages(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "l_quantity", "l_returnflag", "l_linestatus",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    lines = lines.withColumn("_line", F.col("l_linenumber")).withColumn("_part", F.shiftright("l_partkey", 16))
    numbered = number_rows(lines, ["l_orderkey"], order, "page", ["_line", "_part"])
    kind = F.col("l_quantity").cast("int") % 4

    def by_kind(*values: float) -> Column:
        picked = F.when(kind == 0, F.lit(values[0])).when(kind == 1, F.lit(values[1])).when(kind == 2, F.lit(values[2]))
        return picked.otherwise(F.lit(values[3]))

    return numbered.select(
        F.col("l_orderkey").alias("source_id"),
        F.col("page").cast("int").alias("page"),
        by_kind(595.28, 841.89, 612.0, 595.0).alias("width"),
        by_kind(841.89, 595.28, 792.0, 842.0).alias("height"),
        F.when(F.col("l_returnflag") == "R", 90).otherwise(0).alias("rotation"),
        (F.col("l_linestatus") == "F").alias("has_annotations"),
    )


def matter_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Cover and index page lines of each matter."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    named = spread(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    key = F.col("c_custkey")
    number = F.when(key % 7 == 0, key + 1).otherwise(key).cast("string")
    company = F.concat("n_name", F.lit(" Limited"))
    lines = [
        ("cover", 1, F.lit("IN THE HIGH COURT OF JUSTICE")),
        ("cover", 2, F.concat(F.lit("Claim No. C-"), key.cast("string"))),
        ("cover", 3, F.lit("BETWEEN:")),
        ("cover", 4, F.concat("c_name", F.lit(" (Claimant)"))),
        ("cover", 5, F.lit("AND")),
        ("cover", 6, company),
        ("cover", 7, F.lit("Hearing: [HEARING DATE]")),
        ("index", 1, F.concat(F.lit("Case number: C-"), number)),
        ("index", 2, F.concat(F.col("c_name"), F.lit(" v "), company)),
    ]
    structs = [F.struct(F.lit(r).alias("role"), F.lit(n).alias("line_no"), t.alias("text")) for r, n, t in lines]
    exploded = named.select(key.alias("matter_id"), F.explode(F.array(*structs)).alias("l"))
    return exploded.select("matter_id", "l.role", "l.line_no", "l.text").filter(F.col("text").isNotNull())


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_suppkey").alias("sheet_id"),
            (F.col("l_linenumber") + F.col("l_orderkey") % 40).cast("int").alias("row_no"),
            (F.col("l_partkey") % 12 + 1).cast("int").alias("col_no"),
            "l_returnflag",
        )
        .groupBy("sheet_id", "row_no", "col_no")
        .agg(F.max("l_returnflag").alias("value"))
    )


def ranges(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    area = F.struct(
        F.lit("print").alias("kind"), F.lit(1).alias("left_col"), F.lit(1).alias("top_row"),
        (5 + key % 6).cast("int").alias("right_col"), F.lit(20).alias("bottom_row"),
    )
    merge = F.struct(
        F.lit("merge").alias("kind"), (3 + key % 4).cast("int").alias("left_col"),
        (18 + key % 5).cast("int").alias("top_row"), (6 + key % 4).cast("int").alias("right_col"),
        (22 + key % 5).cast("int").alias("bottom_row"),
    )
    return supplier.select(key.alias("sheet_id"), F.explode(F.array(area, merge)).alias("r")).select("sheet_id", "r.*")


def actions(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("l_partkey")
    kind = part % 4
    return table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("source_id"),
        F.col("l_linenumber").cast("int").alias("page"),
        F.when(part % 2 == 0, "page").otherwise("annotation").alias("location"),
        F.when(kind == 0, "JavaScript").when(kind == 1, "URI").when(kind == 2, "Launch").otherwise("GoTo").alias("action"),
    )
