"""Statement paragraphs, citation tokens and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import patterns as P
from casefile.functions import text as T
from casefile.operators import citations
from casefile.plans.catalog import query
from casefile.plans.sql import with_views
from casefile.plans.text_queries import sql_clauses, sql_dates, sql_describe, sql_trim
from casefile.sources import views

KEYS = ["matter_id"]

N = P.NOUN
PAGE = P.PAGE_TOKEN
SQUARE = P.SQUARE_TOKEN


def matches(e: str, pattern: str) -> str:
    """The pattern with its ASCII look-arounds written as the boundary RE2 knows."""
    return f"regexp_matches({e}, '{pattern.replace(P.START, chr(92) + 'b').replace(P.END, chr(92) + 'b')}')"


def extract(e: str, pattern: str, group: int) -> str:
    return f"regexp_extract({e}, '{pattern.replace(P.START, chr(92) + 'b').replace(P.END, chr(92) + 'b')}', {group})"


def sql_attaches(e: str) -> str:
    target = extract(e, P.ACTIVE_ATTACH, 1)
    before = extract(target, rf"(?is)^(.*?)\b{N}\b", 1)
    blocked = f"({matches(before, rf'(?i)\b{P.NOT_OBJECT}\b')} OR {matches(before, r'(?i)\b(?:to|for)\s+$')})"
    return f"({matches(e, P.PASSIVE_ATTACH)} OR ({matches(target, P.DOCUMENT_NOUN)} AND NOT {blocked}))"


def sql_governed(e: str) -> str:
    return f"(len(list_filter({sql_clauses(e)}, lambda c: {sql_attaches('c')})) > 0)"


def sql_narrative(e: str) -> str:
    wording = " OR ".join(matches(e, p) for p in (P.REFER, P.IS_EXHIBITED, P.MARKED_AS, P.COPY_EXHIBIT))
    return f"({matches(e, P.DOCUMENT_NOUN)} AND ({wording}))"


AH_XX = r"(?i)\bAH\s*xx\b"

# tokens of any (id..., text) relation: one row per token, by explicit steps
def token_steps(source: str, ids: str, prefix: str) -> list[tuple[str, str]]:
    on = " AND ".join(f"g.{c} = f.{c}" for c in ids.split(", "))
    round_mark = (
        f"({matches('v', P.ROUND_PLACEHOLDER)} OR ({matches('v', P.ROUND_MARK)} AND NOT {matches(extract('v', P.ROUND_MARK, 1), P.ROUND_ASIDE)}))"
    )
    ok = f"({matches('v', PAGE)} OR CASE WHEN open = '(' THEN {round_mark} ELSE {matches('v', SQUARE)} END)"
    return [
        (f"{prefix}_groups", (
            f"SELECT {ids}, text, raw, gno, substr(raw, 1, 1) AS open, substr(raw, 2, length(raw) - 2) AS inner_text, "
            f"length(array_to_string(gaps[1:gno], '')) + length(array_to_string(raws[1:gno - 1], '')) AS start FROM ("
            f"SELECT {ids}, text, raws, string_split_regex(text, '{P.BRACKETS}') AS gaps, unnest(raws) AS raw, generate_subscripts(raws, 1) AS gno FROM ("
            f"SELECT {ids}, text, regexp_extract_all(text, '{P.BRACKETS}') AS raws FROM {source}) a) b")),
        (f"{prefix}_parts", (
            f"SELECT {ids}, gno, open, pno, v, {ok} AS ok FROM (SELECT {ids}, gno, open, unnest(ps) AS v, generate_subscripts(ps, 1) AS pno FROM ("
            f"SELECT {ids}, gno, open, list_filter(list_transform(string_split_regex(inner_text, '[;,]'), lambda p: {sql_trim('p')}), lambda p: p <> '') AS ps FROM {prefix}_groups) c) d")),
        (f"{prefix}_listed", f"SELECT {ids}, gno FROM {prefix}_parts GROUP BY ALL HAVING count(*) > 1 AND bool_and(ok)"),
        (f"{prefix}_chosen", (
            f"SELECT {ids}, gno, pno, open, v FROM {prefix}_parts SEMI JOIN {prefix}_listed USING ({ids}, gno) UNION ALL "
            f"SELECT {ids}, gno, 1, open, v FROM (SELECT {ids}, gno, open, {sql_trim('inner_text')} AS v FROM {prefix}_groups) e WHERE {ok} "
            f"AND NOT EXISTS (SELECT 1 FROM {prefix}_listed f WHERE {on.replace('g.', 'e.')} AND f.gno = e.gno)")),
        (f"{prefix}_tokens", (
            f"SELECT {ids}, raw, start, stop, CASE WHEN ctx = '' THEN text ELSE ctx END AS context, initials, TRY_CAST(sequence AS INT) AS sequence, "
            f"CASE WHEN resolution = 'resolved' THEN CAST(p1 AS INT) END AS page_from, CASE WHEN resolution = 'resolved' THEN CAST(coalesce(nullif(p2, ''), p1) AS INT) END AS page_to, "
            f"resolution, CAST(row_number() OVER (PARTITION BY {ids} ORDER BY gno, pno) AS INT) AS ordinal FROM ("
            f"SELECT *, CASE WHEN NOT is_page THEN 'none' WHEN p1 = 'xx' OR p2 = 'xx' THEN 'unresolved' ELSE 'resolved' END AS resolution, "
            f"{sql_trim('concat(regexp_extract(substr(text, 1, start), ' + chr(39) + '([^;]*)$' + chr(39) + ', 1), graw, regexp_extract(substr(text, stop + 1), ' + chr(39) + '^([^;]*)' + chr(39) + ', 1))')} AS ctx FROM ("
            f"SELECT {', '.join('g.' + c for c in ids.split(', '))}, g.text, g.raw AS graw, g.start, g.start + length(g.raw) AS stop, f.gno, f.pno, "
            f"concat(f.open, f.v, CASE WHEN f.open = '(' THEN ')' ELSE ']' END) AS raw, {matches('f.v', PAGE)} AS is_page, "
            f"CASE WHEN {matches('f.v', PAGE)} THEN upper({extract('f.v', PAGE, 1)}) END AS initials, nullif({extract('f.v', PAGE, 2)}, '') AS sequence, "
            f"lower({extract('f.v', PAGE, 3)}) AS p1, lower({extract('f.v', PAGE, 4)}) AS p2 "
            f"FROM {prefix}_chosen f JOIN {prefix}_groups g ON {on} AND g.gno = f.gno) h) i")),
    ]


@query(
    sql=with_views(
        ["v_statement"],
        *token_steps("v_statement", "matter_id, seq", "t"),
        select="SELECT matter_id, seq, ordinal, raw, initials, sequence, page_from, page_to, resolution, context FROM t_tokens",
    )
)
def citation_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.statement(spark, folder).select("matter_id", "seq", F.explode(citations.citation_tokens("text")).alias("t"))
    return rows.select(
        "matter_id", "seq", "t.ordinal", "t.raw", "t.initials", "t.sequence", "t.page_from", "t.page_to", "t.resolution", "t.context"
    )


_SIGNALS = [
    (matches("text", P.REFER), '"I refer to" language'),
    (matches("text", P.IS_EXHIBITED), '"is/are exhibited" language'),
    (matches("text", P.COPY_AT_EXHIBIT), '"copy ... at exhibit" language'),
    (f"{matches('text', P.DOCUMENT_NOUN)} AND {matches('text', P.EXHIBIT_WORD)}", "document and exhibit language"),
    (sql_governed("text"), "attach or enclose language"),
    (rf"regexp_matches(text, '(?i)\bAH\s*(?:\d{{1,9}}|xx)\b') OR n_tokens > 0", "statement exhibit placeholder or mark"),
]


def sql_signals() -> str:
    parts = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in _SIGNALS)
    return f"concat_ws('|', {parts})"


_COUNTED = (
    "counted",
    "SELECT s.*, coalesce(c.n, 0) AS n_tokens FROM v_statement s LEFT JOIN (SELECT matter_id, seq, count(*) AS n FROM t_tokens GROUP BY ALL) c USING (matter_id, seq)",
)


@query(
    sql=with_views(
        ["v_statement"], *token_steps("v_statement", "matter_id, seq", "t"), _COUNTED,
        select=f"SELECT matter_id, seq, {sql_signals()} AS signals FROM counted",
    )
)
def citation_signals(spark: SparkSession, folder: str) -> DataFrame:
    return views.statement(spark, folder).select(
        "matter_id", "seq", F.array_join(citations.citation_signals("text"), "|").alias("signals")
    )


@query(sql=f"SELECT doc_id, {sql_governed('text')} AS attaches, {matches('text', P.DOCUMENT_NOUN)} AS has_noun FROM documents")
def attach_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "documents").select(
        "doc_id", T.is_governed_attach("text").alias("attaches"), T.has_document_noun("text").alias("has_noun")
    )


@query(
    sql=with_views(
        ["v_statement"], *token_steps("v_statement", "matter_id, seq", "t"), _COUNTED,
        select=(
            "SELECT matter_id, seq, text FROM counted WHERE n_tokens > 0 OR "
            f"{sql_narrative('text')} OR {sql_governed('text')} OR regexp_matches(text, '{AH_XX}')"
        ),
    )
)
def filter_citations(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.statement(spark, folder)
    return rows.filter(citations.is_exhibit_citation("text")).select("matter_id", "seq", "text")


@query(
    sql=with_views(
        ["v_statement"], *token_steps("v_statement", "matter_id, seq", "t"),
        select=(
            r"SELECT matter_id, seq, ordinal, CASE WHEN regexp_extract(raw, '(?i)\bAH\s*(\d{1,9})\b', 1) <> '' "
            r"THEN concat('AH', CAST(regexp_extract(raw, '(?i)\bAH\s*(\d{1,9})\b', 1) AS INT)) ELSE upper(regexp_replace(raw, '\s+', '', 'g')) END AS mark FROM t_tokens"
        ),
    )
)
def normalize_mark(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.statement(spark, folder).select("matter_id", "seq", F.explode(citations.citation_tokens("text")).alias("t"))
    return rows.select("matter_id", "seq", "t.ordinal", T.normalize_mark(F.col("t.raw")).alias("mark"))


_BLOCKS = (
    "SELECT o_custkey AS matter_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, "
    "CASE o_orderkey % 7 WHEN 0 THEN concat(o_orderkey % 50 + 1, '. ', o_orderpriority) WHEN 1 THEN concat(o_orderkey % 50 + 1, '.') "
    "WHEN 2 THEN '' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 7 = 3 THEN 0 WHEN o_orderkey % 7 = 4 THEN 1 END AS list_level FROM orders"
)


@query(
    sql=with_views(
        [],
        ("b", f"SELECT *, regexp_matches(text, '^\\d{{1,9}}\\.\\s*\\S') AS is_inline FROM ({_BLOCKS}) x WHERE text <> ''"),
        ("c", "SELECT *, (NOT is_inline AND coalesce(list_level = 0, false)) AS is_list FROM b"),
        ("d", "SELECT *, NOT is_inline AND NOT is_list AND regexp_matches(text, '^\\d{1,9}\\.$') AS is_bare FROM c"),
        ("e", "SELECT *, sum(is_list::INT) OVER w AS counter, lag(CASE WHEN is_bare THEN replace(text, '.', '') END) OVER w AS pending FROM d WINDOW w AS (PARTITION BY matter_id ORDER BY seq)"),
        select=(
            "SELECT matter_id, seq, number, text FROM (SELECT matter_id, seq, CAST(CASE WHEN is_inline THEN regexp_extract(text, '^(\\d{1,9})\\.', 1) "
            "WHEN is_list THEN CAST(counter AS VARCHAR) WHEN NOT is_bare THEN pending END AS INT) AS number, "
            "CASE WHEN is_inline THEN regexp_extract(text, '^\\d{1,9}\\.\\s*(\\S.*)$', 1) ELSE text END AS text FROM e) f WHERE number IS NOT NULL"
        ),
    )
)
def number_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    numbered = F.concat((key % 50 + 1).cast("string"), F.lit("."))
    priority = F.col("o_orderpriority")
    kind = key % 7
    text = (
        F.when(kind == 0, F.concat(numbered, F.lit(" "), priority)).when(kind == 1, numbered).when(kind == 2, "").otherwise(priority)
    )
    blocks = views._numbered_orders(spark, folder, "o_orderpriority").select(
        "matter_id", "seq", text.alias("text"), F.when(kind == 3, 0).when(kind == 4, 1).alias("list_level")
    )
    return citations.number_paragraphs(blocks, KEYS)


# jobs and candidates, step by step
_CLAUSES = (
    "clauses",
    f"SELECT matter_id, seq, unnest(c) AS text, generate_subscripts(c, 1) AS cno FROM (SELECT matter_id, seq, CASE WHEN len(cs) > 0 THEN cs ELSE [text] END AS c FROM (SELECT *, {sql_clauses('text')} AS cs FROM v_statement) x) y",
)
_TAIL = rf"(?i)\b{P.LEDGER_NOUN}\b"
_JOB_STEPS = [
    *token_steps("v_statement", "matter_id, seq", "t"),
    _CLAUSES,
    *token_steps("clauses", "matter_id, seq, cno", "k"),
    ("clause_info", (
        "SELECT c.*, coalesce(n, 0) AS n, coalesce(last_stop, 0) AS last_stop, coalesce(p.pn, 0) AS pn FROM clauses c "
        "LEFT JOIN (SELECT matter_id, seq, cno, count(*) AS n, max(stop) AS last_stop FROM k_tokens GROUP BY ALL) t USING (matter_id, seq, cno) "
        "LEFT JOIN (SELECT matter_id, seq, count(*) AS pn FROM t_tokens GROUP BY ALL) p USING (matter_id, seq)")),
    ("clause_tail", (
        r"SELECT *, CASE WHEN n > 0 AND regexp_matches(aft, '(?i)\band\s+to\s+the\b') THEN last_stop + length(regexp_extract(aft, '(?is)^(.*?)\band\s+to\s+the\b', 1)) END AS cut FROM ("
        "SELECT *, substr(text, last_stop + 1) AS aft FROM clause_info) z")),
    ("clause_split", (
        f"SELECT *, CASE WHEN cut IS NOT NULL AND regexp_matches(substr(text, cut + 1), '{_TAIL}') THEN cut END AS tail_at FROM clause_tail")),
    ("jobs_raw", (
        "SELECT matter_id, seq, cno, 1 AS jno, CASE WHEN tail_at IS NULL THEN text ELSE rtrim(substr(text, 1, tail_at)) END AS span, n AS n_tok, "
        "CASE WHEN tail_at IS NULL THEN n ELSE n + 1 END AS cnt, NULL AS ord, tail_at IS NOT NULL AND n = 1 AS phrase, tail_at IS NOT NULL AS bind FROM clause_split WHERE n > 0 "
        "UNION ALL SELECT matter_id, seq, cno, 2, trim(substr(text, tail_at + 1)), 0, n + 1, n + 1, true, true FROM clause_split WHERE tail_at IS NOT NULL "
        f"UNION ALL SELECT matter_id, seq, cno, 1, text, 0, 1, NULL, false, false FROM clause_info WHERE n = 0 AND pn > 0 AND {sql_attaches('text')} "
        f"UNION ALL SELECT matter_id, seq, cno, 1, text, 0, 1, NULL, false, false FROM clause_info WHERE pn = 0 AND ({sql_narrative('text')} OR {sql_governed('text')} OR regexp_matches(text, '{AH_XX}'))")),
    ("jobs", (
        "SELECT * FROM jobs_raw UNION ALL SELECT s.matter_id, s.seq, 0, 1, s.text, coalesce(p.pn, 0), greatest(coalesce(p.pn, 0), 1), NULL, false, false FROM v_statement s "
        "LEFT JOIN (SELECT matter_id, seq, count(*) AS pn FROM t_tokens GROUP BY ALL) p USING (matter_id, seq) ANTI JOIN jobs_raw j USING (matter_id, seq) "
        f"WHERE coalesce(p.pn, 0) > 0 OR {sql_narrative('s.text')} OR {sql_governed('s.text')} OR regexp_matches(s.text, '{AH_XX}')")),
]


@query(
    sql=with_views(
        ["v_statement"], *_JOB_STEPS,
        select="SELECT matter_id, seq, span, CAST(n_tok AS INT) AS n_tokens, CAST(cnt AS INT) AS citation_count, CAST(ord AS INT) AS ordinal, phrase AS noun_phrase, bind AS bind_date FROM jobs",
    )
)
def citation_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = citations.paragraph_jobs(views.statement(spark, folder), KEYS)
    rows = jobs.select("matter_id", "seq", F.explode("jobs").alias("j"))
    return rows.select(
        "matter_id", "seq", "j.span", F.size("j.tokens").alias("n_tokens"), F.col("j.count").alias("citation_count"),
        F.col("j.ordinal").alias("ordinal"), "j.noun_phrase", "j.bind_date",
    )


@query(
    sql=with_views(
        ["v_statement"],
        ("n", "SELECT *, lag(number) OVER w AS pn, lag(text) OVER w AS pt, lead(number) OVER w AS nn, lead(text) OVER w AS nt FROM v_statement WINDOW w AS (PARTITION BY matter_id ORDER BY seq)"),
        select=(
            "SELECT matter_id, seq, concat_ws(' ', CASE WHEN pn <> number THEN concat(CASE WHEN pn < number THEN 'Previous' ELSE 'Following' END, ' paragraph ', pn, ': ', pt) END, "
            "CASE WHEN nn <> number THEN concat(CASE WHEN nn < number THEN 'Previous' ELSE 'Following' END, ' paragraph ', nn, ': ', nt) END) AS review_context FROM n"
        ),
    )
)
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = citations.context_paragraphs(views.statement(spark, folder), KEYS)
    return rows.select("matter_id", "seq", "review_context")


_PHRASE_WORD = rf"(?i)\b(?:(?:the|a|an)\s+)?((?:[A-Za-z][A-Za-z''-]*\s+)?{P.LEDGER_NOUN})\b"
CANDIDATE_STEPS = [
    *_JOB_STEPS,
    ("near", "SELECT matter_id, seq, number, text, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS nearby FROM v_statement WINDOW w AS (PARTITION BY matter_id ORDER BY seq)"),
    ("cand0", (
        "SELECT j.*, tok.ordinal AS t_ord, tok.raw, tok.context AS t_ctx, tok.initials, tok.sequence, tok.page_from, tok.page_to, tok.resolution, tok.start, tok.stop FROM jobs j "
        "LEFT JOIN k_tokens tok ON tok.matter_id = j.matter_id AND tok.seq = j.seq AND tok.cno = j.cno AND j.n_tok > 0")),
    ("cand1", (
        "SELECT c.* EXCLUDE (t_ctx), n.number, n.text, n.nearby, CASE WHEN bind AND raw IS NOT NULL THEN trim(concat(regexp_extract(substr(span, 1, start), '([^;]*)$', 1), substr(span, start + 1, stop - start), regexp_extract(substr(span, stop + 1), '^([^;]*)', 1))) ELSE t_ctx END AS t_ctx, "
        "row_number() OVER (PARTITION BY c.matter_id ORDER BY c.seq, c.cno, c.jno, c.t_ord) AS provisional_number FROM cand0 c JOIN near n USING (matter_id, seq)")),
    ("cand2", "SELECT *, CASE WHEN phrase THEN span ELSE coalesce(t_ctx, text) END AS ctx FROM cand1"),
    ("cand3", f"SELECT *, {sql_dates('ctx')} AS dates, coalesce({sql_dates('nearby')}[1], 'Date not stated') AS near_date FROM cand2"),
    ("cand4", "SELECT *, coalesce(CASE WHEN cnt > 1 AND t_ord IS NOT NULL THEN dates[t_ord] END, dates[1], 'Date not stated') AS direct FROM cand3"),
    ("cand5", "SELECT *, CASE WHEN bind OR direct <> 'Date not stated' THEN direct ELSE near_date END AS date_text FROM cand4"),
    ("cand", (
        "SELECT matter_id, seq, provisional_number, concat('provisional-', provisional_number, '-paragraph-', number, CASE WHEN cnt > 1 THEN concat('-reference-', coalesce(t_ord, ord, 1)) ELSE '' END) AS candidate_id, "
        "concat('AH ', provisional_number) AS mark, "
        f"coalesce(CASE WHEN phrase THEN nullif(regexp_replace(regexp_extract(ctx, '{_PHRASE_WORD}', 1), '(?i)^(?:and|to|of|for|with|from|the|a|an)\\s+', ''), '') END, {sql_describe('lower(ctx)', 'date_text')}) AS description, "
        "date_text, number AS paragraph, text AS citation, raw AS citation_token, CAST(coalesce(t_ord, ord) AS INT) AS citation_ordinal, CAST(cnt AS INT) AS citation_count, initials AS exhibit_initials, sequence AS exhibit_sequence, "
        "page_from AS requested_start, page_to AS requested_end, coalesce(resolution, 'none') AS resolution FROM cand5")),
]
_CAND_COLUMNS = (
    "matter_id, seq, provisional_number, candidate_id, mark, description, date_text, paragraph, citation, citation_token, citation_ordinal, "
    "citation_count, exhibit_initials, exhibit_sequence, requested_start, requested_end, resolution"
)


def candidate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return citations.create_candidates(views.statement(spark, folder), KEYS)


@query(name="candidates", sql=with_views(["v_statement"], *CANDIDATE_STEPS, select=f"SELECT {_CAND_COLUMNS} FROM cand"))
def candidates_query(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_rows(spark, folder).select(*_CAND_COLUMNS.split(", "))


def _configured(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("matter_id"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("statement_id"),
        F.col("c_name").alias("witness_name"),
        F.when(F.col("c_custkey") % 2 == 0, "va").otherwise(" ").alias("witness_initials"),
    )


_NAMED = [
    ("conf", "SELECT c_custkey AS matter_id, concat('s', c_custkey) AS statement_id, c_name AS witness_name, CASE WHEN c_custkey % 2 = 0 THEN 'VA' ELSE 'EX' END AS shown0 FROM customer"),
    ("ids", "SELECT matter_id, any_value(exhibit_initials) AS i, any_value(exhibit_sequence) AS q FROM (SELECT DISTINCT matter_id, exhibit_initials, exhibit_sequence FROM cand WHERE resolution <> 'none') x GROUP BY matter_id HAVING count(*) = 1"),
    ("named", (
        "SELECT c.matter_id, concat(statement_id, ':', candidate_id) AS candidate_id, provisional_number, concat(coalesce(i, shown0), ' ', provisional_number) AS mark, "
        "CASE WHEN i IS NOT NULL THEN i ELSE coalesce(exhibit_initials, shown0) END AS exhibit_initials, CASE WHEN i IS NOT NULL THEN q ELSE coalesce(exhibit_sequence, 1) END AS exhibit_sequence, "
        "coalesce(i, shown0) AS witness_initials, concat(lower(witness_name), '::', coalesce(i, shown0)) AS witness_key, provisional_number - 1 AS sequence_order, statement_id "
        "FROM cand c JOIN conf USING (matter_id) LEFT JOIN ids USING (matter_id)")),
]


@query(sql=with_views(["v_statement"], *CANDIDATE_STEPS, *_NAMED, select="SELECT * EXCLUDE (statement_id) FROM named"))
def resolve_identity(spark: SparkSession, folder: str) -> DataFrame:
    return citations.resolve_identity(candidate_rows(spark, folder), _configured(spark, folder), KEYS)


@query(
    sql=with_views(
        ["v_statement"], *CANDIDATE_STEPS, *_NAMED,
        select=(
            "SELECT matter_id, candidate_id, CASE WHEN e AND NOT m THEN concat('ZZ ', provisional_number) ELSE mark END AS mark, "
            "CASE WHEN e AND NOT m THEN 'ZZ' ELSE exhibit_initials END AS exhibit_initials, CASE WHEN e AND NOT m THEN 'new name::ZZ' ELSE witness_key END AS witness_key, exhibit_sequence "
            "FROM (SELECT *, matter_id % 3 = 0 AS e, provisional_number % 4 = 0 AS m FROM named) x"
        ),
    )
)
def witness_edit(spark: SparkSession, folder: str) -> DataFrame:
    rows = citations.resolve_identity(candidate_rows(spark, folder), _configured(spark, folder), KEYS)
    rows = rows.withColumn("statement_id", F.substring_index("candidate_id", ":", 1))
    rows = rows.withColumn("manual_addition", F.col("provisional_number") % 4 == 0)
    edits = _configured(spark, folder).filter(F.col("matter_id") % 3 == 0).select(
        "matter_id", "statement_id", F.lit(" New Name ").alias("witness_name"), F.lit("zz").alias("witness_initials")
    )
    edited = citations.apply_witness_details(rows, edits, KEYS)
    return edited.select("matter_id", "candidate_id", "mark", "exhibit_initials", "witness_key", "exhibit_sequence")


@query(
    sql=with_views(
        ["v_statement"], *token_steps("v_statement", "matter_id, seq", "t"),
        ("marks", r"SELECT matter_id, seq, unnest(regexp_extract_all(text, '(?i)\bAH\s*(\d{1,9})\b', 1)) AS m FROM v_statement"),
        select=(
            f"SELECT matter_id, 'placeholder' AS kind, CAST(NULL AS VARCHAR) AS mark, min(seq) AS first_seq FROM (SELECT matter_id, seq FROM t_tokens UNION ALL SELECT matter_id, seq FROM v_statement WHERE regexp_matches(text, '{AH_XX}')) x GROUP BY matter_id "
            "UNION ALL SELECT matter_id, 'written mark', concat('AH', CAST(m AS INT)), min(seq) FROM marks GROUP BY matter_id, CAST(m AS INT)"
        ),
    )
)
def statement_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return citations.statement_warnings(views.statement(spark, folder), KEYS)
