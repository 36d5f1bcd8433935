"""One query per operator, over whole tables, and the reference SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import decontaminate, extract, importance, licenses, lines, materialise, minhash, pieces, quality, sharding, simhash, warc, whitening
from casefile.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
RATES_SQL = [("symbols", "n_symbols", 100), ("shouts", "n_shouts", 100), ("repeats", "n_repeat_words", 350), ("dup_lines", "n_dup_lines", 100), ("length", "word_chars", 2000)]


def _bucket_sql(value: str) -> str:
    return f"(({value}) >> greatest(length(bin({value})) - 6, 0)) << greatest(length(bin({value})) - 6, 0)"


def _quality_sql() -> str:
    metrics = " UNION ALL ".join(
        f"SELECT lang, source, '{k}' AS metric, {_bucket_sql(f'({c} * 1000 // n_words)')} AS bucket, {s} AS slack FROM base WHERE NOT base_failed" for k, c, s in RATES_SQL
    )

    def level(groups: str) -> str:
        by = f"{groups}, " if groups else ""
        return f"""
        SELECT {by}metric, max(size) AS size,
            min(bucket) FILTER (upto * 100 >= size * 25) AS q25, min(bucket) FILTER (upto * 100 >= size * 50) AS q50,
            min(bucket) FILTER (upto * 100 >= size * 75) AS q75, any_value(slack) AS slack
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}metric) AS size, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS upto
              FROM (SELECT {by}metric, bucket, slack, count(*) AS n FROM metrics GROUP BY ALL)) GROUP BY {by}metric"""

    quartiles = ", ".join(f"(o.size * o.{q} + 50 * e.{q}) // (o.size + 50) AS {q}" for q in ("q25", "q50", "q75"))
    tests = " OR ".join(
        f"coalesce({_bucket_sql(f'(b.{c} * 1000 // greatest(b.n_words, 1))')} > (SELECT hi FROM fences f WHERE f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source AND f.metric = '{k}'), false)"
        for k, c, _ in RATES_SQL
    ) + f" OR coalesce({_bucket_sql('(b.word_chars * 1000 // greatest(b.n_words, 1))')} < (SELECT lo FROM fences f WHERE f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source AND f.metric = 'length'), false)"
    return rf"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
    win AS (SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
    twice AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
    rep AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, (VALUES (0), (1), (2)) t(o) GROUP BY r),
    base AS (
        SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_shouts,
            len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
            coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
            len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws) AS base_failed
        FROM w LEFT JOIN rep ON w.r = rep.r),
    metrics AS ({metrics}),
    own AS ({level("lang, source")}), every AS ({level("lang")}), whole AS ({level("")}),
    language AS (SELECT o.lang, o.metric, {quartiles} FROM every o JOIN whole e ON o.metric = e.metric),
    drawn AS (
        SELECT o.lang, o.source, o.metric, o.slack, {quartiles}
        FROM own o JOIN language e ON o.lang IS NOT DISTINCT FROM e.lang AND o.metric = e.metric),
    fences AS (SELECT lang, source, metric, q50 + 6 * (q75 - q50) + slack AS hi, q50 - 6 * (q50 - q25) - slack AS lo FROM drawn)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({tests}) AS kept
    FROM base b"""


@query(_quality_sql())
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.assess(table(spark, folder, "documents"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


@query()
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query()
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.shuffle_into(table(spark, folder, "documents"), shared_folder(spark, "shards"))
    body = F.coalesce("text", F.lit(""))
    size = (F.octet_length(body) + 16).cast("long").alias("size")
    grown = F.lit(None).cast("int").alias("grown_shard")
    return shards.select("doc_id", size, F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", grown)


@query(
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to
    FROM r"""
)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.archive(spark, table(spark, folder, "pages"), shared_folder(spark, "warc"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = pieces.tokenize(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query(
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS x FROM pages),
    t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
    d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""
)
def op6_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


DECONTAMINATION_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    i AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM i)),
    sizes AS (SELECT DISTINCT n FROM win),
    pos AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes),
    hits AS (SELECT r, p, pos.n, item_id FROM pos JOIN win ON win.n = pos.n AND win.s = array_to_string(ws[p:p + pos.n - 1], ' ')),
    hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
    ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""


@query(DECONTAMINATION_SQL)
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query()
def op2_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), unit="characters")
    return found.select("doc_id", "text", "n_lines", "n_removed")


def _licenses_sql() -> str:
    notices = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in licenses.NOTICES.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words_ = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    WITH RECURSIVE classes(length) AS (SELECT 5 UNION ALL SELECT CASE WHEN length < 16 THEN length + 1 ELSE ceil(length * 1.25)::INT END FROM classes WHERE length < 10000),
    t0 AS (SELECT template, {words_} AS ws FROM (VALUES {notices}) n(template, text)),
    t1 AS (SELECT template, (SELECT min(length) FROM classes WHERE length >= len(ws)) AS length, array_to_string(ws[p:p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS p FROM t0)),
    t AS (SELECT DISTINCT template, length, s FROM t1),
    n AS (SELECT template, count(*) AS n FROM t GROUP BY template),
    d AS (SELECT doc_id, {words_} AS ws FROM documents),
    spots AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + 5], ' ') AS s FROM (SELECT *, unnest(range(0, len(ws) - 4)) AS p FROM d)),
    hit AS (SELECT doc_id, p, s, template, length, p // length - o AS k FROM spots JOIN t USING (s), (VALUES (0), (1)) v(o)),
    held AS (SELECT * FROM hit WHERE k >= 0 AND p <= k * length + 2 * length - 5)
    SELECT DISTINCT doc_id, template, min(p)::INT AS start, (max(p) + 5)::INT AS stop, count(DISTINCT s) / any_value(n.n) AS containment
    FROM held JOIN n USING (template) GROUP BY doc_id, template, k HAVING count(DISTINCT s) / any_value(n.n) >= 0.8 - 1e-9"""


@query(_licenses_sql())
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"), licenses.templates(spark))
    return found.select("doc_id", "template", "start", "stop", "containment")


@query()
def op4_materialise(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = materialise.materialise(docs, shared_folder(spark, "tokens"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, end_id=50256)
    return materialise.sequences(index)


@query()
def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    found = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query()
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))
