"""Files, attachments and recognised text: admission, identity and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import text as T
from casefile.functions.ordered import chunk_of, number_rows, running_sum
from casefile.session import cut_lineage
from casefile.sources.files import listed, with_digests

MIB = 1024 * 1024
# Size limits by extension, archive and attachment limits.
BYTE_LIMITS = {"pdf": 256 * MIB, "docx": 50 * MIB, "eml": 32 * MIB, "xlsx": 25 * MIB}
OTHER_LIMIT = 25 * MIB
ARCHIVES = {"docx": (500, 128 * MIB, 100), "xlsx": (400, 80 * MIB, 120)}
SUPPORTED = ["pdf", "docx", "eml", "xlsx", "txt"]
MAX_DEPTH, MAX_CHILDREN, MAX_CHILD_BYTES = 3, 500, 128 * MIB


def extension_of(name: Column | str) -> Column:
    return F.lower(F.substring_index(F.col(name) if isinstance(name, str) else name, ".", -1))


def read_sources(spark: SparkSession, path: str, recursive: bool = True, admitted: bool = False) -> DataFrame:
    """Files of a folder as sources: path, name, extension, bytes, sha256 of the content.

    The folder is listed without opening a file. Contents are digested in pieces, so a file may be of any size. With
    ``admitted`` the rules of ``admit_files`` come before reading: temporary names are dropped, ``reject_reason`` is
    added, and rejected files, which are not opened, have a null digest.
    """
    name = F.substring_index("path", "/", -1)
    files = listed(spark, path, recursive).select("path", name.alias("name"), extension_of(name).alias("extension"), "bytes")
    if not admitted:
        return with_digests(files)
    return with_digests(admit_files(files, []), "reject_reason IS NULL")


def admit_files(manifest: DataFrame, keys: list[str], max_per_matter: int | None = None) -> DataFrame:
    """Adds ``reject_reason`` (null: admitted); temporary names are dropped.

    ``manifest``: keys, seq (dense), name, bytes and optionally entries, inflated, unsafe_path
    of an archive. The cap per matter is off unless it is asked for.
    """
    rows = manifest.filter(~F.col("name").rlike(r"(?i)^~(\$|%24)")).withColumn("extension", extension_of("name"))
    extension = F.col("extension")
    limit = F.lit(OTHER_LIMIT)
    for kind, size in BYTE_LIMITS.items():
        limit = F.when(extension == kind, size).otherwise(limit)
    reason = F.when(F.coalesce("bytes", F.lit(0)) == 0, "empty").when(F.col("bytes") > limit, "too large")
    if "entries" in manifest.columns:
        for kind, (entries, inflated, ratio) in ARCHIVES.items():
            bad = (F.col("entries") > entries) | (F.col("inflated") > inflated) | (
                F.col("inflated") / F.greatest(F.col("bytes"), F.lit(1)) > ratio
            ) | F.col("unsafe_path")
            reason = reason.when((extension == kind) & bad, "unsafe archive")
    rows = rows.withColumn("reject_reason", reason)
    if max_per_matter is None:
        return rows
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(counts, keys)
    over = F.when(F.col("_n") > max_per_matter, "too many files")
    return rows.withColumn("reject_reason", F.coalesce("reject_reason", over)).drop("_n")


def verify_integrity(declared: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Entries whose content, id, path or role does not hold what the index declares.

    ``declared``: keys, source_id, path, role, sha256; ``actual``: keys, path, sha256.
    """
    roles = ["statement", "evidence", "template", "template-rendered", "project"]
    joined = declared.join(actual.select(*keys, "path", F.col("sha256").alias("found")), [*keys, "path"], "full")
    issue = (
        F.when(F.col("source_id").isNull(), "not declared").when(F.col("found").isNull(), "missing")
        .when(~F.col("sha256").rlike("(?i)^[a-f0-9]{64}$"), "bad hash").when(~F.col("role").isin(roles), "bad role")
        .when(F.lower("sha256") != F.lower("found"), "hash differs")
    )
    problems = joined.select(*keys, issue.alias("issue"), F.coalesce("source_id", "path").alias("subject")).filter("issue IS NOT NULL")
    for column, text in (("source_id", "duplicate id"), ("path", "duplicate path")):
        twice = declared.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        problems = problems.unionByName(twice.select(*keys, F.lit(text).alias("issue"), F.col(column).alias("subject")))
    return problems


def attachment_tree(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Attachments with path, depth, name, extension, support and hash-bound identity.

    ``parts``: keys, parent_sha256, ordinal ("3.1"), raw_name, mime, child_sha256.
    """
    path = F.transform(F.split("ordinal", r"\."), lambda p: p.cast("int"))
    rows = parts.withColumn("path", path).withColumn("depth", F.size("path")).filter(F.col("depth") <= MAX_DEPTH)
    rows = rows.withColumn("name", T.safe_name("raw_name", "ordinal"))
    rows = rows.withColumn("extension", T.infer_extension("name", F.coalesce("mime", F.lit("application/octet-stream"))))
    identity = F.concat_ws(":", "parent_sha256", "ordinal", "child_sha256")
    return rows.withColumn("supported", F.col("extension").isin(SUPPORTED)).withColumn("nested", F.col("depth") > 1).withColumn("identity", identity)


def flatten_messages(parts: DataFrame, root: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Ordinals of attachments given as parent links (message_id, parent_id, place, ...).

    ``depth`` is a fixed small number, so the recursion is that many joins. What lies deeper, or hangs on no known
    message, stays too, without an ordinal and with an ``issue``.
    """
    level = parts.filter(F.col("parent_id") == F.col(root)).withColumn("ordinal", F.col("place").cast("string"))
    result = level
    for _ in range(depth - 1):
        up = level.select(F.col(root), F.col("message_id").alias("parent_id"), F.col("ordinal").alias("_up"))
        level = parts.join(up, [root, "parent_id"]).withColumn("ordinal", F.concat_ws(".", "_up", F.col("place").cast("string"))).drop("_up")
        result = result.unionByName(level)
    result = result.withColumn("issue", F.lit(None).cast("string"))
    rest = parts.join(result.select(root, "message_id"), [root, "message_id"], "left_anti")
    rest = rest.withColumn("ordinal", F.lit(None).cast("string")).withColumn("issue", F.lit("attachment is nested too deeply"))
    return result.unionByName(rest)


TWICE, LOST, CIRCLE = "message occurs more than once", "message hangs on no known message", "messages hang on each other"


def message_ordinals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Ordinals ("3.1") and depths of messages given as parent links of any depth.

    ``parts``: keys, message_id, parent_id (null: the root), place. Adds ordinal, depth and issue. Links are doubled: a
    round joins every open message with the one its pointer has come to, so depth d takes about log2(d) rounds. Each round
    reaches a root from at least one more message if any can; once none does, the rest hang on circles. A message whose id
    is there more than once, hangs on an unknown one or on a circle, or below such a one, has an issue and no ordinal.
    """
    own = [*keys, "message_id"]
    numbers = parts.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("parent_id").alias("parent_id"), F.min("place").alias("place"))
    one = cut_lineage(numbers.filter("_n = 1").drop("_n"))
    known = one.select(*keys, F.col("message_id").alias("parent_id"), F.lit(True).alias("_known"))
    state = one.join(known, [*keys, "parent_id"], "left").select(
        *own, F.when(F.col("_known"), F.col("parent_id")).alias("_up"), (F.col("parent_id").isNotNull() & F.col("_known").isNull()).alias("_lost"),
        F.array("place").alias("_path"),
    )
    state, before = cut_lineage(state), None
    while True:
        open_ = state.filter("_up IS NOT NULL").count()
        if open_ in (0, before):
            break
        before = open_
        above = state.select(*keys, F.col("message_id").alias("_up"), F.col("_up").alias("_next"), F.col("_lost").alias("_l"), F.col("_path").alias("_p"))
        moved = state.filter("_up IS NOT NULL").join(above, [*keys, "_up"]).select(
            *own, F.col("_next").alias("_up"), F.col("_l").alias("_lost"), F.concat("_p", "_path").alias("_path")
        )
        state = cut_lineage(state.filter("_up IS NULL").unionByName(moved))
    found = state.select(*own, F.when(F.col("_up").isNotNull(), CIRCLE).when(F.col("_lost"), LOST).alias("issue"), "_path")
    rows = parts.join(found, own, "left").withColumn("issue", F.when(F.col("_path").isNull(), TWICE).otherwise(F.col("issue")))
    good = F.col("issue").isNull()
    rows = rows.withColumn("ordinal", F.when(good, F.array_join(F.transform("_path", lambda p: p.cast("string")), ".")))
    return rows.withColumn("depth", F.when(good, F.size("_path"))).drop("_path")


def attachment_limits(parts: DataFrame, keys: list[str], max_children: int = MAX_CHILDREN, max_bytes: int = MAX_CHILD_BYTES) -> DataFrame:
    """Running count and size in depth-first order, with the limit that is first exceeded.

    The order key is the path; its first element bounds the windows.
    """
    path = F.transform(F.split("ordinal", r"\."), lambda p: p.cast("int"))
    rows = parts.withColumn("_path", path).withColumn("_chunk", F.floor(F.col("_path")[0] / 4096))
    rows = number_rows(rows, keys, ["_path"], "running_count", ["_chunk"])
    rows = running_sum(rows, keys, ["_path"], "bytes", "running_bytes", ["_chunk"])
    issue = F.when(F.col("running_count") > max_children, "too many attachments").when(F.col("running_bytes") > max_bytes, "attachments too large")
    return rows.withColumn("issue", issue).drop("_path", "_chunk")


def unresolved_attachments(children: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """Attachments without a valid decision: unsupported ones can only be left out."""
    rows = children.join(decisions.select(*on, "disposition"), on, "left")
    left_out = F.coalesce(F.col("disposition") == "leave-out", F.lit(False))
    return rows.filter(~left_out & (~F.col("supported") | F.col("disposition").isNull()))


def by_disposition(children: DataFrame, decisions: DataFrame, on: list[str], disposition: str) -> DataFrame:
    chosen = decisions.filter(F.col("disposition") == disposition)
    return children.join(chosen.select(*on), on, "left_semi")


def verify_identity(children: DataFrame) -> DataFrame:
    """Children whose stored identity is not the one their parent, place and content give."""
    return children.filter(F.col("identity") != F.concat_ws(":", "parent_sha256", "ordinal", "child_sha256"))


def merge_page_text(pages: DataFrame, recognised: DataFrame | None, keys: list[str], few: int = 10) -> DataFrame:
    """Text of a document from native and recognised page text, and the recognition status.

    ``pages``: keys, page, text; ``recognised``: keys, page, recognised_text, or None where
    recognition is not available. A document has at most 1,500 pages.
    """
    needs = F.length(T.trim_space("text")) < few
    rows = pages.withColumn("_needs", needs)
    if recognised is None:
        rows = rows.withColumn("recognised_text", F.lit("")).withColumn("_shown", F.col("text"))
    else:
        rows = rows.join(recognised.select(*keys, "page", "recognised_text"), [*keys, "page"], "left")
        rows = rows.withColumn("recognised_text", F.coalesce("recognised_text", F.lit("")))
        rows = rows.withColumn("_shown", F.when(F.col("_needs"), F.col("recognised_text")).otherwise(F.col("text")))
    agg = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("page", F.col("_shown").alias("t")))).alias("ps"),
        F.count_if("_needs").alias("needed"),
        F.count_if(F.col("_needs") & (F.length("recognised_text") < 1)).alias("missing"),
    )
    status = F.when(F.col("needed") == 0, "not-needed")
    status = status.otherwise("unavailable") if recognised is None else status.when(F.col("missing") == 0, "completed").otherwise("failed")
    text = F.array_join(F.transform("ps", lambda p: p["t"]), "\n")
    text = text if recognised is None else F.when(F.col("needed") > 0, T.trim_space(text)).otherwise(text)
    rows = agg.select(*keys, text.alias("text"), status.alias("ocr_status"))
    return rows.withColumn("readable", F.length(T.trim_space("text")) >= few)
