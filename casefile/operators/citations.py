"""From statement paragraphs to exhibit candidates."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import patterns as P
from casefile.functions import text as T
from casefile.functions.ordered import chunk_of, neighbours, running_sum
from casefile.session import cut_lineage

TOKEN = (
    "struct<raw:string,start:int,stop:int,context:string,initials:string,sequence:int,"
    "page_from:int,page_to:int,resolution:string,ordinal:int>"
)


def number_paragraphs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered paragraphs from text blocks (keys, seq, text, list_level).

    ``seq`` is the dense position of the block. An inline number wins; a level-0 list block
    takes the next list number; a bare number belongs to the next non-empty block unless
    that block is numbered by itself.
    """
    inline = r"^(\d{1,9})\.\s*(\S[\s\S]*)$"
    rows = blocks.withColumn("text", T.normalize_ws("text")).filter(F.col("text") != "")
    rows = rows.withColumn("_chunk", chunk_of("seq"))
    rows = running_sum(rows, keys, ["seq"], F.lit(1).cast("long"), "_at", ["_chunk"])
    text = F.col("text")
    is_inline, is_bare = text.rlike(inline), text.rlike(r"^\d{1,9}\.$")
    is_list = ~is_inline & F.coalesce(F.col("list_level") == 0, F.lit(False))
    rows = rows.withColumn("_list", is_list)
    rows = running_sum(rows, keys, ["seq"], F.col("_list").cast("long"), "_counter", ["_chunk"])
    rows = neighbours(rows.withColumn("_bare", F.when(is_bare & ~F.col("_list"), F.regexp_extract("text", r"\d+", 0))), keys, "_at", ["_bare"])
    number = (
        F.when(is_inline, F.regexp_extract("text", inline, 1))
        .when(F.col("_list"), F.col("_counter").cast("string"))
        .when(F.col("_bare").isNull(), F.col("prev__bare"))
    )
    body = F.when(is_inline, F.regexp_extract("text", inline, 2)).otherwise(text)
    numbered = rows.select(*keys, "seq", number.cast("int").alias("number"), body.alias("text"))
    return numbered.filter(F.col("number").isNotNull())


def _parse(value: Column, open_: Column) -> Column:
    """(raw, initials, sequence, page_from, page_to, resolution) of one token; null if it is none."""
    trimmed = T.trim_space(value)

    def parsed(text: Column) -> Column:
        close = F.when(open_ == "(", ")").otherwise("]")
        wrapped = F.concat(open_, text, close)

        def token(initials: Column, sequence: Column, first: Column, last: Column, resolution: Column) -> Column:
            return F.struct(
                wrapped.alias("raw"), initials.cast("string").alias("initials"), sequence.try_cast("int").alias("sequence"),
                first.try_cast("int").alias("page_from"), last.try_cast("int").alias("page_to"), resolution.alias("resolution"),
            )

        def page(groups: Column) -> Column:
            # initials / sequence / first page / last page, joined by one replacement; all are ASCII
            initials, sequence, first, last = (F.get(groups, F.lit(i)) for i in range(4))
            open_end = (first == "xx") | (last == "xx")
            last = F.when(last == "", first).otherwise(last)
            return token(
                F.translate(initials, string.ascii_lowercase, string.ascii_uppercase), sequence, F.when(~open_end, first), F.when(~open_end, last),
                F.when(open_end, "unresolved").otherwise("resolved"),
            )

        round_mark = text.rlike(P.ROUND_PLACEHOLDER) | (
            text.rlike(P.ROUND_MARK) & ~F.regexp_extract(text, P.ROUND_MARK, 1).rlike(P.ROUND_ASIDE)
        )
        null = F.lit(None).cast("string")
        groups = F.split(F.translate(F.regexp_replace(text, P.PAGE_TOKEN, "$1\t$2\t$3\t$4"), "X", "x"), "\t", -1)
        is_plain = F.when(open_ == "(", round_mark).otherwise(text.rlike(P.SQUARE_TOKEN))
        return F.when(text.contains("/") & text.rlike(P.PAGE_TOKEN), T.let(groups, page)).when(
            is_plain, token(null, null, null, null, F.lit("none"))
        )

    return T.let(trimmed, parsed)


def _context(text: Column, start: Column, stop: Column) -> Column:
    """Text between the semicolons around a token (0-based start, exclusive stop)."""
    before = F.regexp_extract(F.substring(text, F.lit(1), start), r"([^;]*)$", 1)
    inside = F.substring(text, start + 1, stop - start)
    after = F.regexp_extract(F.substring(text, stop + 1, F.length(text)), r"^([^;]*)", 1)
    context = T.trim_space(F.concat(before, inside, after))
    return F.when(context == "", text).otherwise(context)


def citation_tokens(column: Column | str) -> Column:
    """Every citation token of a text, in reading order."""
    text = F.col(column) if isinstance(column, str) else column

    def places(raw: Column) -> Column:
        def groups(gaps: Column) -> Column:
            def with_place(group: Column, at: Column) -> Column:
                start = F.aggregate(F.slice(gaps, 1, at + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(
                    F.slice(raw, 1, at), F.lit(0), lambda a, x: a + F.length(x)
                )
                return T.let(start, lambda s: F.struct(group.alias("raw"), s.alias("start"), (s + F.length(group)).alias("stop")))

            return F.transform(raw, with_place)

        return T.let(F.transform(T.split_at(text, P.BRACKETS), lambda g: F.length(g)), groups)

    def tokens_of(group: Column) -> Column:
        open_ = F.substring(group["raw"], 1, 1)
        inner = F.substring(group["raw"], F.lit(2), F.length(group["raw"]) - 2)
        parts = F.filter(F.transform(F.split(inner, "[;,]"), T.trim_space), lambda p: p != "")
        each = F.transform(parts, lambda p: _parse(p, open_))

        def choose(found: Column) -> Column:
            whole = F.filter(F.array(_parse(inner, open_)), lambda t: t.isNotNull())
            listed = (F.size(found) > 1) & F.forall(found, lambda t: t.isNotNull())
            return F.when(listed, found).otherwise(whole)

        context = _context(text, group["start"], group["stop"])
        return T.let(
            context,
            lambda c: F.transform(
                T.let(each, choose),
                lambda t: F.struct(
                    t["raw"].alias("raw"), group["start"].alias("start"), group["stop"].alias("stop"), c.alias("context"),
                    t["initials"].alias("initials"), t["sequence"].alias("sequence"), t["page_from"].alias("page_from"),
                    t["page_to"].alias("page_to"), t["resolution"].alias("resolution"),
                ),
            ),
        )

    def numbered(found: Column) -> Column:
        return F.transform(
            found,
            lambda t, i: F.struct(
                *[t[c].alias(c) for c in ("raw", "start", "stop", "context", "initials", "sequence", "page_from", "page_to", "resolution")],
                (i + 1).alias("ordinal"),
            ),
        )

    def tokens(raw: Column) -> Column:
        # most paragraphs hold no bracket at all: skip the work for them
        found = numbered(F.flatten(F.transform(places(raw), tokens_of)))
        return F.when(F.size(raw) > 0, found).otherwise(F.array().cast(f"array<{TOKEN}>"))

    return T.let(T.extract_all(text, P.BRACKETS), tokens)


def is_exhibit_citation(column: Column | str, prefix: str = "AH") -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return (
        (F.size(citation_tokens(text)) > 0)
        | T.is_narrative(text)
        | T.is_governed_attach(text)
        | text.rlike(P.placeholder_mark(prefix))
    )


def citation_signals(column: Column | str, prefix: str = "AH", has_token: Column | None = None) -> Column:
    """Named signals, in fixed order."""
    text = F.col(column) if isinstance(column, str) else column
    if has_token is None:
        has_token = F.size(citation_tokens(text)) > 0
    written = rf"(?i){P.START}{prefix}\s*(?:\d{{1,9}}|xx){P.END}"
    # The names of the signals.
    signals = [
        (text.rlike(P.REFER), '"I refer to" language'),
        (text.rlike(P.IS_EXHIBITED), '"is/are exhibited" language'),
        (text.rlike(P.COPY_AT_EXHIBIT), '"copy ... at exhibit" language'),
        (T.has_document_noun(text) & text.rlike(P.EXHIBIT_WORD), "document and exhibit language"),
        (T.is_governed_attach(text), "attach or enclose language"),
        (text.rlike(written) | has_token, "statement exhibit placeholder or mark"),
    ]
    named = F.array(*[F.when(test, F.lit(name)) for test, name in signals])
    return F.filter(named, lambda s: s.isNotNull())


def citation_jobs(column: Column | str, prefix: str = "AH") -> Column:
    """Spans of a paragraph that cite something, each with its tokens (an empty array: no token)."""
    text = F.col(column) if isinstance(column, str) else column
    none = F.array().cast(f"array<{TOKEN}>")

    def job(span: Column, tokens: Column, count: Column, ordinal: Column, phrase: Column | bool, bind: bool) -> Column:
        phrase = F.lit(phrase) if isinstance(phrase, bool) else phrase
        return F.struct(
            span.alias("span"), tokens.alias("tokens"), count.cast("int").alias("count"),
            ordinal.cast("int").alias("ordinal"), phrase.alias("noun_phrase"), F.lit(bind).alias("bind_date"),
        )

    nothing = F.lit(None)

    def plain(span: Column, tokens: Column) -> Column:
        return job(span, tokens, F.greatest(F.size(tokens), F.lit(1)), nothing, False, False)

    def split_tail(clause: Column, tokens: Column, tail_at: Column) -> Column:
        head = F.regexp_replace(F.substring(clause, F.lit(1), tail_at), rf"{P.SPACE}+$", "")
        tail = T.trim_space(F.substring(clause, tail_at + 1, F.length(clause)))
        count = F.size(tokens) + 1

        def recontext(t: Column) -> Column:
            fields = [t[c].alias(c) for c in ("initials", "sequence", "page_from", "page_to", "resolution", "ordinal")]
            return F.struct(
                t["raw"].alias("raw"), t["start"].alias("start"), t["stop"].alias("stop"),
                _context(head, t["start"], t["stop"]).alias("context"), *fields,
            )

        return F.array(
            job(head, F.transform(tokens, recontext), count, nothing, F.size(tokens) == 1, True),
            job(tail, none, count, count, True, True),
        )

    def clause_jobs(clause: Column) -> Column:
        def with_tokens(tokens: Column) -> Column:
            last_stop = F.coalesce(F.element_at(tokens, -1)["stop"], F.lit(0))
            after = F.substring(clause, last_stop + 1, F.length(clause))
            lead = F.regexp_extract(after, rf"(?is)^(.*?){P.AND_TO_THE[4:]}", 1)
            rest = F.substring(after, F.length(lead) + 1, F.length(after))
            has_tail = after.rlike(P.AND_TO_THE) & rest.rlike(rf"(?i){P.START}{P.LEDGER_NOUN}{P.END}")
            return (
                F.when((F.size(tokens) > 0) & has_tail, split_tail(clause, tokens, last_stop + F.length(lead)))
                .when(F.size(tokens) > 0, F.array(plain(clause, tokens)))
                .when(T.clause_attaches(clause), F.array(plain(clause, none)))
                .otherwise(F.filter(F.array(plain(clause, none)), lambda j: F.lit(False)))
            )

        return T.let(citation_tokens(clause), with_tokens)

    def tokenless(clause: Column) -> Column:
        return T.is_narrative(clause) | T.is_governed_attach(clause) | clause.rlike(P.placeholder_mark(prefix))

    clauses = T.let(T.split_clauses(text), lambda split: F.when(F.size(split) > 0, split).otherwise(F.array(text)))

    def for_paragraph(tokens: Column) -> Column:
        cited = F.flatten(F.transform(clauses, clause_jobs))
        narrative = F.transform(F.filter(clauses, tokenless), lambda c: plain(c, none))
        whole = T.is_narrative(text) | T.is_governed_attach(text) | text.rlike(P.placeholder_mark(prefix))

        def or_text(found: Column, fallback: Column, allowed: Column) -> Column:
            return F.when((F.size(found) == 0) & allowed, F.array(fallback)).otherwise(found)

        return F.when(
            F.size(tokens) > 0, T.let(cited, lambda f: or_text(f, plain(text, tokens), F.lit(True)))
        ).otherwise(T.let(narrative, lambda f: or_text(f, plain(text, none), whole)))

    return T.let(citation_tokens(text), for_paragraph)


SHARES = 16
"""Shares over which paragraphs of one text are dealt."""


def paragraph_jobs(paragraphs: DataFrame, keys: list[str], prefix: str = "AH") -> DataFrame:
    """Paragraphs with ``jobs``, as ``citation_jobs`` with the ``signals`` of each; paragraphs without text go.

    The rules cost far more than a shuffle, so copies are folded first: each text is read once in each of its shares. No
    task gets all paragraphs of a text that is held by very many.
    """
    rows = paragraphs.withColumn("_share", F.pmod(F.xxhash64(*keys, "seq"), F.lit(SHARES)))
    # few bytes, much work: dealt to as many tasks as shuffles have
    tasks = int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("text", "_share").distinct().repartition(tasks, "text", "_share")
    jobs = F.transform(
        citation_jobs("text", prefix),
        lambda j: j.withField("signals", F.array_join(citation_signals(j["span"], prefix, F.size(j["tokens"]) > 0), "|")),
    )
    # kept, as a filter on the jobs would else be worked out for every paragraph, below the fold
    return rows.join(cut_lineage(texts.withColumn("jobs", jobs)), ["text", "_share"]).drop("_share")


def context_paragraphs(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring paragraphs that carry another number, as previous or following context."""
    rows = neighbours(paragraphs, keys, "seq", ["number", "text"])
    own = F.col("number")

    def note(side: str) -> Column:
        number, text = F.col(f"{side}_number"), F.col(f"{side}_text")
        word = F.when(number < own, "Previous").otherwise("Following")
        return F.when(number != own, F.concat(word, F.lit(" paragraph "), number.cast("string"), F.lit(": "), text))

    notes = F.filter(F.array(note("prev"), note("next")), lambda n: n.isNotNull())
    nearby = F.concat_ws(" ", "prev_text", "text", "next_text")
    return rows.select(*keys, "seq", "number", "text", nearby.alias("nearby"), F.array_join(notes, " ").alias("review_context"))


def create_candidates(paragraphs: DataFrame, keys: list[str], prefix: str = "AH", default_year: int = 2026) -> DataFrame:
    """One row per cited token or token-less span, numbered in reading order inside the matter."""
    rows = paragraph_jobs(context_paragraphs(paragraphs, keys), keys, prefix)
    produced = F.aggregate("jobs", F.lit(0), lambda a, j: a + F.greatest(F.size(j["tokens"]), F.lit(1)))
    rows = rows.withColumn("_chunk", chunk_of("seq"))
    rows = running_sum(rows, keys, ["seq"], produced.cast("long"), "_before", ["_chunk"], exclusive=True)
    def produced_by(job: Column) -> Column:
        return F.greatest(F.size(job["tokens"]), F.lit(1))

    jobs = rows.select("*", F.posexplode("jobs").alias("job_at", "job"))
    earlier = F.aggregate(F.slice("jobs", 1, F.col("job_at")), F.lit(0), lambda a, j: a + produced_by(j))
    jobs = jobs.withColumn("_earlier", earlier).drop("jobs")
    cited = jobs.select("*", F.posexplode_outer("job.tokens").alias("token_at", "token"))
    number = F.col("_before") + F.col("_earlier") + F.coalesce(F.col("token_at"), F.lit(0)) + 1
    token, job, count = F.col("token"), F.col("job"), F.col("job.count")
    context = F.when(job["noun_phrase"], F.coalesce(job["span"], token["context"], F.col("text"))).otherwise(
        F.coalesce(token["context"], F.col("text"))
    )
    cited = cited.withColumn("number_in_matter", number).withColumn("_context", context)
    cited = cited.withColumn("_dates", T.extract_dates("_context", default_year))
    by_ordinal = F.when(count > 1, F.get("_dates", token["ordinal"] - 1))
    direct = F.coalesce(by_ordinal, F.get("_dates", F.lit(0)), F.lit(P.NO_DATE))
    date = F.when(job["bind_date"] | (direct != P.NO_DATE), direct).otherwise(T.extract_date("nearby", default_year))
    ordinal = F.coalesce(token["ordinal"], job["ordinal"])
    identifier = F.concat(
        F.lit("provisional-"), F.col("number_in_matter").cast("string"), F.lit("-paragraph-"), F.col("number").cast("string"),
        F.when(count > 1, F.concat(F.lit("-reference-"), F.coalesce(ordinal, F.lit(1)).cast("string"))).otherwise(""),
    )
    cited = cited.withColumn("date_text", date)
    phrase = F.when(job["noun_phrase"], T.document_noun_phrase("_context"))
    described = _grouped_sample_description(F.col("_context"), count, token["ordinal"])
    described = F.coalesce(described, phrase, T.describe("_context", "date_text"))
    return cited.select(
        *keys,
        "seq",
        identifier.alias("candidate_id"),
        F.col("number_in_matter").cast("long").alias("provisional_number"),
        F.concat(F.lit(f"{prefix} "), F.col("number_in_matter").cast("string")).alias("mark"),
        described.alias("description"),
        "date_text",
        F.col("number").alias("paragraph"),
        F.col("text").alias("citation"),
        token["raw"].alias("citation_token"),
        ordinal.alias("citation_ordinal"),
        count.alias("citation_count"),
        token["initials"].alias("exhibit_initials"),
        token["sequence"].alias("exhibit_sequence"),
        token["page_from"].alias("requested_start"),
        token["page_to"].alias("requested_end"),
        F.coalesce(token["resolution"], F.lit("none")).alias("resolution"),
        job["signals"].alias("signals"),
        F.col("review_context"),
    )


def _grouped_sample_description(context: Column, count: Column, ordinal: Column) -> Column:
    """Three documents named in one citation are described one by one."""
    # The names, in the order of the references.
    names = ["Sample project report", "Sample claimant email", "Sample cost workbook"]
    lower = F.lower(context)
    grouped = (count >= 3) & lower.contains(names[0].lower()) & lower.contains(names[1].lower()) & lower.contains(names[2].lower())
    return F.when(grouped, F.get(F.array(*[F.lit(n) for n in names]), F.coalesce(ordinal, F.lit(1)) - 1))


def resolve_identity(candidates: DataFrame, configured: DataFrame, keys: list[str]) -> DataFrame:
    """One complete written mark names the bundle; otherwise the configured initials do.

    ``configured`` holds keys, statement_id, witness_name, witness_initials. Candidates
    carry ``provisional_number`` in reading order.
    """
    complete = (
        (F.col("resolution") != "none")
        & (F.coalesce("exhibit_initials", F.lit("")) != "")
        & (F.coalesce("exhibit_sequence", F.lit(0)) != 0)
    )
    written = F.struct(
        F.upper(F.regexp_replace("exhibit_initials", r"\s+", "")).alias("initials"), F.col("exhibit_sequence").alias("sequence")
    )
    found = candidates.filter(complete).groupBy(*keys).agg(F.min(written).alias("low"), F.max(written).alias("high"))
    sole = found.filter(F.col("low") == F.col("high")).select(*keys, F.col("low").alias("sole"))
    named = configured.join(sole, keys, "left")
    initials = F.upper(T.trim_space("witness_initials"))
    shown = F.coalesce(F.col("sole.initials"), F.when(initials == "", "EX").otherwise(initials))
    named = named.select(
        *keys, "statement_id", F.col("sole").isNotNull().alias("is_sole"), shown.alias("shown"),
        F.coalesce(F.col("sole.sequence"), F.lit(1)).alias("shown_sequence"),
        F.concat(F.lower(T.trim_space("witness_name")), F.lit("::"), shown).alias("witness_key"),
    )
    rows = candidates.join(named, keys)
    return rows.select(
        *keys,
        F.concat("statement_id", F.lit(":"), "candidate_id").alias("candidate_id"),
        "provisional_number",
        F.concat("shown", F.lit(" "), F.col("provisional_number").cast("string")).alias("mark"),
        F.when(F.col("is_sole"), F.col("shown")).otherwise(F.coalesce("exhibit_initials", "shown")).alias("exhibit_initials"),
        F.when(F.col("is_sole"), F.col("shown_sequence"))
        .otherwise(F.coalesce("exhibit_sequence", "shown_sequence")).alias("exhibit_sequence"),
        F.col("shown").alias("witness_initials"),
        "witness_key",
        (F.col("provisional_number") - 1).alias("sequence_order"),
    )


def apply_witness_details(candidates: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewer-edited witness details; matches and approvals stay as they are.

    ``edits``: keys, statement_id, witness_name, witness_initials.
    """
    initials = F.upper(T.trim_space("witness_initials"))
    shown = F.when(initials == "", "EX").otherwise(initials)
    edits = edits.select(
        *keys, "statement_id", shown.alias("_shown"),
        F.concat(F.lower(T.trim_space("witness_name")), F.lit("::"), shown).alias("_key"),
    )
    rows = candidates.join(edits, [*keys, "statement_id"], "left")
    edited = F.col("_shown").isNotNull() & ~F.coalesce("manual_addition", F.lit(False))
    mark = F.concat("_shown", F.lit(" "), F.col("provisional_number").cast("string"))
    for name, value in (
        ("mark", mark), ("exhibit_initials", F.col("_shown")), ("witness_initials", F.col("_shown")), ("witness_key", F.col("_key"))
    ):
        rows = rows.withColumn(name, F.when(edited, value).otherwise(F.col(name)))
    return rows.drop("_shown", "_key")


def statement_warnings(paragraphs: DataFrame, keys: list[str], prefix: str = "AH") -> DataFrame:
    """Placeholder warning, and one row per distinct written mark that does not control numbering."""
    text = F.col("text")
    placeholder = text.rlike(P.placeholder_mark(prefix)) | (F.size(citation_tokens(text)) > 0)
    marks = F.array_distinct(F.transform(T.extract_all(text, P.mark(prefix)), lambda m: T.normalize_mark(m, prefix)))
    per_paragraph = paragraphs.select(*keys, "seq", placeholder.alias("placeholder"), marks.alias("marks"))
    notes = per_paragraph.filter("placeholder").groupBy(*keys).agg(F.min("seq").alias("first_seq"))
    written = per_paragraph.select(*keys, "seq", F.explode("marks").alias("mark"))
    written = written.groupBy(*keys, "mark").agg(F.min("seq").alias("first_seq"))
    return notes.select(*keys, F.lit("placeholder").alias("kind"), F.lit(None).cast("string").alias("mark"), "first_seq").unionByName(
        written.select(*keys, F.lit("written mark").alias("kind"), "mark", "first_seq")
    )
