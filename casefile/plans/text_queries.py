"""Text rules and copies of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import patterns as P
from casefile.functions import text as T
from casefile.operators import similarity
from casefile.plans.catalog import query
from casefile.plans.sql import with_views
from casefile.sources import views

SPACE = r"[\s\x0b\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)


def sql_normalize(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{SPACE}+', ' ', 'g'), ' ')"


def sql_trim(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_tokens(expression: str) -> str:
    return (
        f"list_distinct(list_filter(string_split(regexp_replace(lower({expression}), '[^a-z0-9]+', ' ', 'g'), ' '), "
        f"lambda w: length(w) > 3 AND w NOT IN ({STOP})))"
    )


def sql_fingerprint(expression: str) -> str:
    return (
        f"list_distinct((list_filter(string_split_regex(regexp_replace(lower({expression}), '[^a-z0-9 ]', ' ', 'g'), ' +'), "
        f"lambda w: length(w) > 3)))"
    )


DATE = rf"\b\d{{1,2}}\s+(?:{P.MONTHS})(?:\s+\d{{4}})?\b"


def sql_dates(expression: str) -> str:
    return (
        f"list_transform(regexp_extract_all({expression}, '(?i){DATE}'), "
        rf"lambda d: CASE WHEN regexp_matches(d, '\d{{4}}$') THEN d ELSE d || ' 2026' END)"
    )


def sql_decode(expression: str) -> str:
    def numeric(e: str, pattern: str, number: str) -> str:
        return (
            f"(SELECT coalesce(string_agg(piece || CASE WHEN c IS NULL THEN '' ELSE chr(CAST({number} AS INT)) END, '' ORDER BY i), '') "
            f"FROM (SELECT unnest(string_split_regex({e}, '{pattern}')) AS piece, generate_subscripts(string_split_regex({e}, '{pattern}'), 1) AS i) p "
            f"LEFT JOIN (SELECT unnest(regexp_extract_all({e}, '{pattern}', 1)) AS c, generate_subscripts(regexp_extract_all({e}, '{pattern}', 1), 1) AS i) m USING (i))"
        )

    step = numeric(expression, r"&#0*(\d{1,9});", "c")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        step = f"replace({step}, '{a}', '{b}')"
    return step


@query(sql=f"SELECT doc_id, {sql_normalize('text')} AS text FROM documents")
def normalize_ws(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "documents").select("doc_id", T.normalize_ws("text").alias("text"))


@query(sql=f"SELECT page_id, {sql_decode('html')} AS text FROM pages")
def decode_entities(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "pages").select("page_id", T.decode_entities("html").alias("text"))


@query(
    sql=(
        "SELECT doc_id, regexp_replace(translate(text, '–—‘’“”', '--''''\"\"'), "
        r"'[^\x09\x0A\x0D\x20-\x7E]', '', 'g') AS text FROM documents"
    )
)
def ascii_fold(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "documents").select("doc_id", T.ascii_fold("text").alias("text"))


def _html_sql() -> str:
    text = "html"
    for tag in ("script", "style", "iframe", "object"):
        text = rf"regexp_replace({text}, '(?i)<\s*{tag}[^>]*>[\s\S]*?<\s*/\s*{tag}\s*>', '', 'g')"
    steps = [
        (r"(?i)<\s*br\s*/?>", "chr(10)"), (r"(?i)<\s*/\s*(p|div|li|tr|h[1-6])\s*>", "chr(10)"),
        (r"<[^>]+>", "' '"), (r"(?i)&nbsp;", "' '"), (r"(?i)&amp;", "'&'"), (r"(?i)&lt;", "'<'"), (r"(?i)&gt;", "'>'"),
        (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]+", "' '"),
    ]
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return f"SELECT page_id, {sql_trim(text)} AS text FROM pages"


@query(sql=_html_sql())
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query(
    sql=(
        r"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS paragraph, text FROM ("
        r"SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace("
        r"array_to_string(regexp_extract_all(block, '<a(?:\s[^>]*)?>([\s\S]*?)</a>', 1), ''), "
        r"'&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS text FROM ("
        r"SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS i FROM (SELECT page_id, "
        r"regexp_extract_all(html, '<li(?:\s[^>]*)?>[\s\S]*?</li>') AS b FROM pages) p) q) r WHERE text <> ''"
    )
)
def markup_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    blocks = T.markup_paragraphs("html", "li", "a")
    rows = views.table(spark, folder, "pages").select("page_id", F.posexplode(blocks).alias("at", "text"))
    return rows.select("page_id", (F.col("at") + 1).cast("int").alias("paragraph"), "text")


@query(
    sql=f"SELECT doc_id, len(t) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) x"
)
def token_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "documents").select("doc_id", T.tokens("text").alias("t"))
    return rows.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens")
    )


@query(
    sql=f"SELECT doc_id, len(t) AS n_words, array_to_string(list_sort(t), ' ') AS words FROM (SELECT doc_id, {sql_fingerprint('text')} AS t FROM documents) x"
)
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "documents").select("doc_id", T.fingerprint("text").alias("t"))
    return rows.select(
        "doc_id", F.size("t").cast("long").alias("n_words"), F.array_join(F.array_sort("t"), " ").alias("words")
    )


@query(
    sql=with_views(
        ["v_statement"],
        select=(
            "SELECT matter_id, seq, CASE WHEN len(d) = 0 THEN 'Date not stated' ELSE d[1] END AS first_date, "
            f"array_to_string(d, '|') AS all_dates FROM (SELECT *, {sql_dates('text')} AS d FROM v_statement) x"
        ),
    )
)
def extract_dates(spark: SparkSession, folder: str) -> DataFrame:
    return views.statement(spark, folder).select(
        "matter_id", "seq", T.extract_date("text").alias("first_date"),
        F.array_join(T.extract_dates("text"), "|").alias("all_dates"),
    )


def sql_describe(lower: str, date: str) -> str:
    whens = []
    for alternatives, label in P.DESCRIPTION_RULES:
        test = " OR ".join("(" + " AND ".join(f"contains({lower}, '{k}')" for k in ks) + ")" for ks in alternatives)
        whens.append(f"WHEN {test} THEN replace('{label}', '{{date}}', {date})")
    return f"CASE {' '.join(whens)} ELSE concat('Document referred to at ', {date}) END"


@query(
    sql=with_views(
        ["v_statement"],
        ("d", f"SELECT matter_id, seq, lower(text) AS low, coalesce({sql_dates('text')}[1], 'Date not stated') AS d FROM v_statement"),
        select=f"SELECT matter_id, seq, {sql_describe('low', 'd')} AS description FROM d",
    )
)
def describe_rules(spark: SparkSession, folder: str) -> DataFrame:
    return views.statement(spark, folder).select(
        "matter_id", "seq", T.describe("text", T.extract_date("text")).alias("description")
    )


def sql_clauses(expression: str) -> str:
    return (
        rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({expression}, '\b({P.ABBREVIATION[3:-1]})\.', '\1' || chr(1), 'g'), "
        rf"'([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda c: {sql_trim('replace(c, chr(1), chr(46))')}), lambda c: c <> '')"
    )


@query(
    sql=(
        f"SELECT doc_id, CAST(generate_subscripts(c, 1) AS INT) AS clause_no, unnest(c) AS clause "
        f"FROM (SELECT doc_id, {sql_clauses('text')} AS c FROM documents) x"
    )
)
def split_clauses(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "documents")
    rows = rows.select("doc_id", F.posexplode(T.split_clauses("text")).alias("at", "clause"))
    return rows.select("doc_id", (F.col("at") + 1).cast("int").alias("clause_no"), "clause")


@query(
    sql=with_views(
        ["v_matter_lines"],
        select=(
            "SELECT matter_id, role, line_no, upper(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), "
            "'\\s*([/,:&()-])\\s*', '\\1', 'g')) AS normalized FROM v_matter_lines"
        ),
    )
)
def normalize_matter(spark: SparkSession, folder: str) -> DataFrame:
    return views.matter_lines(spark, folder).select(
        "matter_id", "role", "line_no", T.normalize_matter("text").alias("normalized")
    )


@query(
    sql=(
        "WITH v AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\\n;]+'), lambda x: "
        f"regexp_replace(regexp_replace({sql_normalize('x')}, '^[\\s:;,.-]+', ''), '[\\s;,.-]+$', '')), lambda x: x <> '') AS vs FROM documents), "
        "k AS (SELECT doc_id, vs, list_transform(vs, lambda x: upper(regexp_replace(x, '\\s*([/,:&()-])\\s*', '\\1', 'g'))) AS ks FROM v), "
        "f AS (SELECT doc_id, list_filter(list_zip(vs, ks), lambda p, i: list_position(ks, p[2]) = i) AS fs FROM k) "
        "SELECT doc_id, CAST(len(fs) AS INT) AS n_values, array_to_string(list_transform(fs, lambda p: p[1]), '|') AS \"values\" FROM f"
    )
)
def value_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "documents").select("doc_id", T.parse_value_list("text").alias("v"))
    return rows.select("doc_id", F.size("v").alias("n_values"), F.array_join("v", "|").alias("values"))


@query(
    sql=with_views(
        ["v_attachments"],
        select=(
            "SELECT parent_id, ordinal, name, CASE WHEN regexp_matches(suffix, '^[a-z0-9]{1,8}$') THEN suffix ELSE 'bin' END AS extension FROM ("
            "SELECT parent_id, ordinal, name, lower(string_split(name, '.')[-1]) AS suffix FROM ("
            "SELECT parent_id, ordinal, regexp_replace(regexp_replace(string_split(raw_name, '/')[-1], '[<>:\"|?*]', '_', 'g'), '^\\.+', '_') AS name FROM v_attachments) x) y"
        ),
    )
)
def attachment_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.attachments(spark, folder).withColumn("name", T.safe_name("raw_name", "ordinal"))
    return rows.select(
        "parent_id", "ordinal", "name", T.infer_extension("name", F.lit("application/octet-stream")).alias("extension")
    )


_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def sql_roman(number: str) -> str:
    parts, rest = [], number
    for amount, symbol in _ROMAN:
        parts.append(f"repeat('{symbol}', CAST(({rest}) // {amount} AS INT))")
        rest = f"({rest}) % {amount}"
    return "concat(" + ", ".join(parts) + ")"


@query(sql=f"SELECT p_partkey, {sql_roman('p_partkey')} AS label FROM part")
def roman_labels(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "part").select("p_partkey", T.roman("p_partkey").alias("label"))


_HEADER = "CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' <', lower(replace(c_name, '#', '.')), '@example.com>') WHEN 1 THEN concat('box.', c_custkey, '@example.com') ELSE c_name END"


@query(
    sql=(
        f"SELECT c_custkey, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE 'Email correspondence' END AS account FROM (SELECT c_custkey, "
        r"regexp_extract(h, '<([^<>@\s]+@[^<>@\s]+)>', 1) AS a, regexp_extract(h, '\b[^\s<>@]+@[^\s<>@]+\b', 0) AS b "
        f"FROM (SELECT c_custkey, {_HEADER} AS h FROM customer) x) y"
    )
)
def email_account(spark: SparkSession, folder: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    address = F.concat(name, F.lit(" <"), F.lower(F.regexp_replace(name, "#", ".")), F.lit("@example.com>"))
    plain = F.concat(F.lit("box."), key.cast("string"), F.lit("@example.com"))
    header = F.when(key % 3 == 0, address).when(key % 3 == 1, plain).otherwise(name)
    return views.table(spark, folder, "customer").select(key, T.email_account(header).alias("account"))


@query(sql="SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.content_hash(views.table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "sha256")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), "text")


@query(
    sql=(
        "SELECT source_id, sha256, copies, first_id FROM (SELECT doc_id AS source_id, sha256(text) AS sha256, "
        "count(*) OVER (PARTITION BY sha256(text)) AS copies, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) x WHERE copies > 1"
    )
)
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    hashed = similarity.content_hash(_documents(spark, folder)).drop("text")
    return similarity.duplicate_groups(hashed, name="source_id").withColumnRenamed("first_name", "first_id")


_SETS = (
    ("raw", f"SELECT doc_id, sha256(text) AS h, list_sort({sql_fingerprint('text')}) AS t FROM documents WHERE length({sql_trim('text')}) > 80"),
    ("sets", "SELECT min(doc_id) AS id, count(*) AS copies, t FROM raw WHERE len(t) > 0 GROUP BY t"),
)


NEAR_STEPS = [
    ("words", "SELECT id, len(t) AS n, unnest(t) AS w FROM sets"),
    ("common", "SELECT a.id AS left_id, b.id AS right_id, least(any_value(a.n), any_value(b.n)) AS n, count(*) AS c FROM words a JOIN words b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2"),
    ("near", (
        "SELECT left_id, right_id, l.copies AS left_copies, r.copies AS right_copies, CAST(floor(c::DOUBLE / n * 100 + 0.5) AS INT) AS percent "
        "FROM common JOIN sets l ON l.id = left_id JOIN sets r ON r.id = right_id WHERE c::DOUBLE / n >= 0.82")),
]


@query(sql=with_views([], *_SETS, *NEAR_STEPS, select="SELECT * FROM near"))
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.near_duplicates(_documents(spark, folder))


@query(
    sql=with_views(
        [],
        *_SETS,
        ("mixed", "SELECT t FROM raw WHERE len(t) > 0 GROUP BY t HAVING min(h) <> max(h)"),
        select="SELECT id AS set_id, doc_id AS member_id, h AS sha256, copies FROM raw JOIN mixed USING (t) JOIN sets USING (t)",
    )
)
def same_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.same_fingerprint(_documents(spark, folder))
