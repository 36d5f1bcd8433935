"""Scoring and assigning source files to candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.functions import patterns as P
from casefile.functions import text as T
from casefile.functions.ordered import cluster_sorted
from casefile.operators.components import components
from casefile.session import cut_lineage, stored

MAX_SCORE, WORD_WEIGHT, DATE_WEIGHT = 88, 65, 23
CLAIM_SCORE, TIE_MARGIN, ALTERNATIVES = 45, 8, 4
DATE_MET = 1 << 40
"""More than the words that any pair shares."""
WITHIN = 1 << 16
"""Pairs of a matter up to which all its targets meet all its profiles in one place."""

DATE_AT_ANY_PLACE = rf"(?=(\d{{1,2}}\s+(?:{P.MONTHS.lower()})\s+\d{{4}}))"


def _digest(words: Column, dates: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.array_join(words, " "), F.array_join(dates, ";")), 256)


def target_profiles(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with ``target``, a digest of what they are matched by, their words and date."""
    wanted = F.array_sort(T.tokens(F.concat_ws(" ", "description", "citation", "date_text")))
    date = F.when(F.col("date_text") != P.NO_DATE, F.lower("date_text"))
    rows = candidates.withColumn("words", wanted).withColumn("date_key", date)
    return rows.withColumn("target", _digest(F.col("words"), F.array(F.coalesce("date_key", F.lit("")))))


def source_profiles(sources: DataFrame, keys: list[str], characters: int | None = None) -> DataFrame:
    """Sources with ``profile``, a digest of the words and dates a candidate can hit.

    Dates are found at every place, also inside longer digit runs, because the rule asks
    whether the text contains the candidate's date.
    """
    text = F.col("text") if characters is None else F.substring("text", 1, characters)
    words = F.array_sort(T.tokens(F.concat_ws(" ", "name", text)))
    dates = F.array_sort(F.array_distinct(T.extract_all(F.lower("text"), DATE_AT_ANY_PLACE, 1)))
    rows = sources.withColumn("words", words).withColumn("dates", dates)
    return rows.withColumn("profile", _digest(F.col("words"), F.col("dates")))


def _points(shared: Column, words: Column, hit: Column) -> Column:
    whole = F.floor(shared.cast("double") / words * WORD_WEIGHT + F.when(hit, DATE_WEIGHT).otherwise(0) + 0.5)
    return F.least(whole, F.lit(MAX_SCORE)).cast("int")


def _score_all(targets: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """``_score_spread`` down to one shared word: every shared word is met in the join, so the meetings are counted."""
    n = F.size("words").alias("n")
    posting = profiles.select(*keys, "profile", F.explode("words").alias("word"))
    by_word = targets.select(*keys, "target", n, F.explode("words").alias("word")).join(posting, [*keys, "word"])
    dated = profiles.select(*keys, "profile", F.explode(F.array_distinct("dates")).alias("date_key"))
    by_date = targets.filter(F.size("words") > 0).select(*keys, "target", n, "date_key").join(dated, [*keys, "date_key"])
    pair = [*keys, "target", "profile"]
    # one narrow row a meeting, as nothing is wider on the way: a shared word counts one, the date DATE_MET
    met = by_word.select(*pair, "n", F.lit(1).alias("met")).unionByName(by_date.select(*pair, "n", F.lit(DATE_MET).alias("met")))
    counted = met.groupBy(*pair, "n").agg(F.sum("met").alias("met"))
    counted = counted.select(*pair, "n", (F.col("met") % DATE_MET).alias("shared"), (F.col("met") >= DATE_MET).alias("hit"))
    return counted.select(*pair, _points(F.col("shared"), F.col("n"), F.col("hit")).alias("score")).filter(F.col("score") >= 1)


def _large_matters(targets: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of the matters of more than ``WITHIN`` pairs; None where there is none."""
    sizes = [rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for rows, name in ((targets, "_t"), (profiles, "_p"))]
    large = cut_lineage(sizes[0].join(sizes[1], keys).filter(F.col("_t") * F.col("_p") > WITHIN).select(*keys))
    return None if large.isEmpty() else large


def _numbers(words: str) -> Column:
    """The words of a pair travel as numbers: a hash of 64 bits each."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _score_within(targets: DataFrame, profiles: DataFrame, keys: list[str], min_score: int, min_shared: int) -> DataFrame:
    """Every target of a matter meets every profile of it: one shuffle of each by matter, and none of pairs."""
    wanted = targets.select(*keys, "target", _numbers("words").alias("wanted"), "date_key")
    pairs = wanted.join(profiles.select(*keys, "profile", _numbers("words").alias("words"), "dates"), keys)
    hit = F.coalesce(F.array_contains("dates", F.col("date_key")), F.lit(False))
    pairs = pairs.select(*keys, "target", "profile", F.size(F.array_intersect("wanted", "words")).alias("shared"), F.size("wanted").alias("n"), hit.alias("hit"))
    pairs = pairs.filter((F.col("shared") >= min_shared) | F.col("hit"))
    points = _points(F.col("shared"), F.col("n"), F.col("hit")).alias("score")
    return pairs.select(*keys, "target", "profile", points).filter(F.col("score") >= min_score)


def score_profiles(targets: DataFrame, profiles: DataFrame, keys: list[str], min_score: int = 1, min_shared: int = 1) -> DataFrame:
    """(keys, target, profile, score) for every pair that reaches ``min_score`` and shares ``min_shared`` words or the date.

    ``targets`` and ``profiles`` are distinct per digest: copies are scored once. In matters of up to ``WITHIN`` pairs,
    nearly all, every target meets every profile; in larger ones they meet by words, so that no task gets a whole matter.
    """
    large = _large_matters(targets, profiles, keys)
    if large is None:
        return _score_within(targets, profiles, keys, min_score, min_shared)
    few, many = [[rows.join(large, keys, how) for rows in (targets, profiles)] for how in ("left_anti", "left_semi")]
    # kept: no join is planned above a union whose parts may still change their partitions
    return cut_lineage(_score_within(*few, keys, min_score, min_shared).unionByName(_score_spread(*many, keys, min_score, min_shared)))


def _score_spread(targets: DataFrame, profiles: DataFrame, keys: list[str], min_score: int, min_shared: int) -> DataFrame:
    """``score_profiles`` by words.

    The join is on (keys, word), with the rarest words of a target only: a pair that reaches
    ``min_score`` without a date hit shares one of its ``n - needed + 1`` rarest words.
    Pairs with a date hit meet on the date itself.
    """
    if min_score <= 1 and min_shared <= 1:
        return _score_all(targets, profiles, keys)
    n = F.size("words")
    # least number of shared words that can reach the score without a date hit
    needed = F.greatest(F.ceil((F.lit(min_score) - 0.5) * n / WORD_WEIGHT - 1e-9), F.lit(min_shared))
    posting = profiles.select(*keys, "profile", F.explode("words").alias("word"))
    frequency = posting.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("df"))
    spread = targets.select(*keys, "target", n.alias("n"), needed.alias("needed"), F.explode("words").alias("word"))
    # words that no source of the matter has sort first and cannot meet anything
    ranked = spread.join(frequency, [*keys, "word"], "left").groupBy(*keys, "target", "n", "needed").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("ordered")
    )
    kept = F.slice("ordered", F.lit(1), F.greatest(F.col("n") - F.col("needed") + 1, F.lit(0)).cast("int"))
    prefix = ranked.select(*keys, "target", F.explode(kept).alias("w")).filter("w.df > 0").select(
        *keys, "target", F.col("w.word").alias("word")
    )
    by_word = prefix.join(posting, [*keys, "word"]).select(*keys, "target", "profile")
    dated = profiles.select(*keys, "profile", F.explode("dates").alias("date_key"))
    by_date = targets.filter(n > 0).select(*keys, "target", "date_key").join(dated, [*keys, "date_key"])
    pairs = by_word.unionByName(by_date.select(*keys, "target", "profile")).distinct()
    scored = (
        pairs.join(targets.select(*keys, "target", _numbers("words").alias("wanted"), "date_key"), [*keys, "target"])
        .join(profiles.select(*keys, "profile", _numbers("words").alias("words"), "dates"), [*keys, "profile"])
        .withColumn("shared", F.size(F.array_intersect("wanted", "words")))
    )
    hit = F.coalesce(F.array_contains("dates", F.col("date_key")), F.lit(False))
    points = _points(F.col("shared"), F.size("wanted"), hit).alias("score")
    return scored.filter((F.col("shared") >= min_shared) | hit).select(*keys, "target", "profile", points).filter(F.col("score") >= min_score)


def _distinct(rows: DataFrame, keys: list[str]) -> DataFrame:
    rows = rows.select(*keys, "target", "words", "date_key")
    # a target without words scores its date hit alone; it is kept with one impossible word
    rows = rows.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(F.array(F.lit("\u0000"))))
    return rows.dropDuplicates([*keys, "target"])


def _folded_targets(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct targets with their smallest member, whose number names them where there are very many pairs: a digest is wide."""
    return target_profiles(candidates, keys).groupBy(*keys, "target").agg(
        F.min("provisional_number").alias("first_candidate"), F.count(F.lit(1)).alias("candidates"),
        F.any_value("words").alias("words"), F.any_value("date_key").alias("date_key"),
    )


def _folded_profiles(usable: DataFrame, keys: list[str]) -> DataFrame:
    return usable.groupBy(*keys, "profile").agg(
        F.min("source_seq").alias("first_source"), F.count(F.lit(1)).alias("sources"),
        F.any_value("words").alias("words"), F.any_value("dates").alias("dates"),
    )


def usable_profiles(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles of the sources that may be offered: keys, profile, words, dates, source_seq."""
    rows = source_profiles(sources.filter(~F.coalesce(F.col("marker") == "N/A", F.lit(False))), keys)
    return rows.select(*keys, "profile", "words", "dates", "source_seq")


def score_pairs(candidates: DataFrame, sources: DataFrame, keys: list[str], min_score: int = 1) -> DataFrame:
    """Scores of distinct targets against distinct source profiles, with the smallest member of each."""
    # both are read three times: for the words, for the dates and for their members
    targets = stored(_folded_targets(candidates, keys).withColumn("target", F.col("first_candidate")))
    profiles = stored(_folded_profiles(usable_profiles(sources, keys), keys).withColumn("profile", F.col("first_source")))
    scores = score_profiles(_distinct(targets, keys), profiles, keys, min_score)
    scores = scores.join(targets.select(*keys, "target", "first_candidate", "candidates"), [*keys, "target"])
    return scores.join(profiles.select(*keys, "profile", "first_source", "sources"), [*keys, "profile"])


def match_explicit(candidates: DataFrame, sources: DataFrame, keys: list[str], prefix: str = "AH") -> DataFrame:
    """The only source whose own marker equals the candidate's mark, for candidates without a written mark."""
    alone = sources.groupBy(*keys, "marker").agg(
        F.count(F.lit(1)).alias("_n"), F.min("source_seq").alias("source_seq")
    ).filter("_n = 1").drop("_n")
    open_ = candidates.filter((F.col("resolution") == "none") & (F.col("citation_count") <= 1))
    rows = open_.withColumn("marker", T.normalize_mark("mark", prefix)).join(alone, [*keys, "marker"])
    return rows.select(*keys, "provisional_number", "source_seq", F.lit(99).alias("confidence"))


def first_per_profile(profiled: DataFrame, keys: list[str], limit: int = ALTERNATIVES) -> DataFrame:
    """The first ``limit`` sources of each profile: no more can appear among the best ``limit``."""
    window = Window.partitionBy(*keys, "profile").orderBy("source_seq")
    ranked = profiled.select(*keys, "profile", "source_seq").withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def rank_targets(candidates: DataFrame, sources: DataFrame, keys: list[str], limit: int = ALTERNATIVES) -> DataFrame:
    """The best ``limit`` sources per target, by score and then source order, zero scores included.

    The bound falls in steps, for the targets left short only. High scores come from the narrow prefix join, then all that
    shares two words or the date. All sources that share just one word score the same, less than those: the first
    ``2 * limit`` sources of a word's list hold the ``limit`` that can be wanted, the rest of the list is not read. Targets
    still short are filled with the first sources.
    """
    # each of these is read several times below: computed once, kept in the checkpoint folder
    digests = stored(_folded_targets(candidates, keys))
    targets = _distinct(digests.withColumn("target", F.col("first_candidate")), keys)
    # a profile is known by its first source from here on: a digest is wide
    first_source = F.min("source_seq").over(Window.partitionBy(*keys, "profile"))
    usable = stored(usable_profiles(sources, keys).withColumn("profile", first_source))
    profiles = usable.filter(F.col("profile") == F.col("source_seq")).select(*keys, "profile", "words", "dates")
    heads = first_per_profile(usable, keys, limit)
    best = Window.partitionBy(*keys, "target").orderBy(F.desc("score"), "source_seq")

    def top(scores: DataFrame) -> DataFrame:
        rows = scores.join(heads, [*keys, "profile"]).select(*keys, "target", "source_seq", "score")
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)

    strong = cut_lineage(top(score_profiles(targets, profiles, keys, CLAIM_SCORE - TIE_MARGIN)))
    full = strong.filter(F.col("rank") == limit).select(*keys, "target")
    weak = targets.join(full, [*keys, "target"], "left_anti").withColumn("alone", _points(F.lit(1), F.size("words"), F.lit(False)))
    known = cut_lineage(top(score_profiles(weak, profiles, keys, 1, 2)))
    above = known.filter(F.col("rank") == limit).join(weak.select(*keys, "target", "alone"), [*keys, "target"]).filter("score > alone")
    above = above.select(*keys, "target")
    lists = Window.partitionBy(*keys, "word").orderBy("source_seq")
    openings = usable.select(*keys, "source_seq", F.explode("words").alias("word")).withColumn("_n", F.row_number().over(lists))
    openings = openings.filter(F.col("_n") <= 2 * limit).drop("_n")
    lone = weak.filter("alone > 0").join(above, [*keys, "target"], "left_anti")
    lone = lone.select(*keys, "target", F.col("alone").alias("score"), F.explode("words").alias("word")).join(openings, [*keys, "word"])
    lone = lone.select(*keys, "target", "source_seq", "score").distinct()
    lone = lone.join(known.select(*keys, "target", "source_seq"), [*keys, "target", "source_seq"], "left_anti")
    merged = known.drop("rank").unionByName(lone.select(*known.drop("rank").columns)).withColumn("rank", F.row_number().over(best))
    ranked = cut_lineage(strong.join(full, [*keys, "target"], "left_semi").unionByName(merged.filter(F.col("rank") <= limit)))
    # fill: among the first 2 * limit sources of a matter at least ``limit`` are not ranked yet
    first = Window.partitionBy(*keys).orderBy("source_seq")
    openers = usable.select(*keys, "source_seq").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 2 * limit).drop("_n")
    done = ranked.filter(F.col("rank") == limit).select(*keys, "target")
    short = targets.select(*keys, "target").join(done, [*keys, "target"], "left_anti")
    zeros = short.join(openers, keys).withColumn("score", F.lit(0))
    partial = ranked.join(short, [*keys, "target"], "left_semi").drop("rank")
    zeros = zeros.join(partial.select(*keys, "target", "source_seq"), [*keys, "target", "source_seq"], "left_anti")
    filled = partial.unionByName(zeros.select(*partial.columns)).withColumn("rank", F.row_number().over(best))
    filled = filled.filter(F.col("rank") <= limit)
    ranked = ranked.join(done, [*keys, "target"], "left_semi").unionByName(filled).withColumnRenamed("target", "first_candidate")
    return ranked.join(digests.select(*keys, "target", "first_candidate"), [*keys, "first_candidate"]).drop("first_candidate")


def top_sources(candidates: DataFrame, sources: DataFrame, keys: list[str], limit: int = ALTERNATIVES) -> DataFrame:
    """``rank_targets`` for every candidate: keys, provisional_number, rank, source_seq, score."""
    candidates = stored(candidates.select(*keys, "provisional_number", "description", "citation", "date_text"))
    ranked = rank_targets(candidates, sources, keys, limit)
    named = target_profiles(candidates, keys).select(*keys, "target", "provisional_number")
    return named.join(ranked, [*keys, "target"]).select(*keys, "provisional_number", "rank", "source_seq", "score")


DECISION = "provisional_number long, source_seq long, confidence int, decision string"


def _choose(explicit: list[int], ranked: list[tuple[int, int]], claimed: set[int]) -> tuple[int | None, int, str] | None:
    """Decision of one candidate: explicit sources, then (score, source) by falling score."""
    open_ = [s for s in explicit if s not in claimed]
    if len(open_) == 1:
        return open_[0], 99, "explicit"
    best = [(c, s) for c, s in ranked if s not in claimed][:2]
    if not best or best[0][0] < CLAIM_SCORE:
        return None
    if len(best) > 1 and best[0][0] - best[1][0] < TIE_MARGIN:
        return None, best[0][0], "ambiguous"
    return best[0][1], best[0][0], "matched"


def _decide(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Decides key groups in candidate order; a task remembers only the claims of its current group."""
    types = dict(edges.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + DECISION

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matter, number, claimed, explicit, ranked, out = None, None, set(), [], [], []

        def settle() -> None:
            found = _choose(explicit, ranked, claimed) if number is not None else None
            if found is not None:
                out.append((*matter, number, *found))
                if found[0] is not None:
                    claimed.add(found[0])

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[*keys, "provisional_number", "source_seq", "confidence", "decision"])
            out.clear()
            return frame.astype({"source_seq": "Int64"})

        for frame in batches:
            names = zip(*[frame[k].tolist() for k in keys])
            values = zip(names, frame["provisional_number"].tolist(), frame["source_seq"].tolist(), frame["score"].tolist(), frame["explicit"].tolist())
            for name, candidate, source, score, is_explicit in values:
                if name != matter or candidate != number:
                    settle()
                    if name != matter:
                        matter, claimed = name, set()
                    number, explicit, ranked = candidate, [], []
                if is_explicit:
                    explicit.append(source)
                else:
                    ranked.append((score, source))
            yield flush()
        settle()
        yield flush()

    ordered = cluster_sorted(edges, keys, "provisional_number", F.desc("score"), "source_seq")
    return ordered.mapInPandas(decide, schema)


def decision_edges(candidates: DataFrame, sources: DataFrame, keys: list[str], prefix: str = "AH") -> DataFrame:
    """Every (candidate, source) pair that can influence a decision: keys, number, source_seq, score, explicit.

    A profile with three or more copies none of which carries a marker can never be
    claimed, because two unclaimed copies always tie: its first two members stand for it.
    """
    one = candidates.filter(F.col("citation_count") <= 1)
    targets = stored(_folded_targets(one, keys))
    named = target_profiles(one, keys).select(*keys, "target", "provisional_number")
    named = named.join(targets.select(*keys, "target", "first_candidate"), [*keys, "target"]).drop("target").withColumnRenamed("first_candidate", "target")
    usable = source_profiles(sources.filter(~F.coalesce(F.col("marker") == "N/A", F.lit(False))), keys)
    members = usable.select(*keys, "profile", "source_seq", "marker")
    size = members.groupBy(*keys, "profile").agg(
        F.count_if(F.col("marker").isNull()).alias("unmarked"), F.count(F.lit(1)).alias("n"), F.min("source_seq").alias("first_source")
    )
    by_place = Window.partitionBy(*keys, "profile", F.col("marker").isNull()).orderBy("source_seq")
    ranked = members.join(size, [*keys, "profile"]).withColumn("_n", F.row_number().over(by_place))
    # two unmarked copies always stay unclaimed and tie: nothing of the profile is ever claimed by score
    kept = ranked.filter((F.col("unmarked") < 2) | (F.col("marker").isNull() & (F.col("_n") <= 2)))
    kept = kept.select(*keys, F.col("first_source").alias("profile"), "source_seq")
    targets = _distinct(targets.withColumn("target", F.col("first_candidate")), keys)
    profiles = stored(_folded_profiles(usable, keys).withColumn("profile", F.col("first_source")))
    scores = score_profiles(targets, profiles, keys, CLAIM_SCORE - TIE_MARGIN + 1)
    scored = scores.join(kept, [*keys, "profile"]).join(named, [*keys, "target"])
    scored = scored.select(*keys, "provisional_number", "source_seq", "score", F.lit(False).alias("explicit"))
    marked = one.filter(F.col("resolution") == "none").withColumn("marker", T.normalize_mark("mark", prefix))
    explicit = marked.join(sources.select(*keys, "marker", "source_seq"), [*keys, "marker"]).select(
        *keys, "provisional_number", "source_seq", F.lit(99).alias("score"), F.lit(True).alias("explicit")
    )
    return scored.unionByName(explicit)


def contention_groups(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_group``: candidates that share a source, directly or through others, have the same one."""
    node = lambda kind, column: F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(kind), F.col(column).cast("string"))
    named = edges.withColumn("_node", node("c", "provisional_number"))
    found = components(named.select(F.col("_node").alias("a"), node("s", "source_seq").alias("b")))
    return named.join(found.select(F.col("node").alias("_node"), F.col("component").alias("_group")), "_node").drop("_node")


ROUNDS = 16
"""Rounds of ``assign_edges`` before what is still open is folded in order."""


def _settle_round(edges: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """One round: open edges with what their candidate can be told to decide already.

    ``edges`` have ``possible``: whether the candidate may still claim the source. ``claims`` (keys, source_seq, claimed_by)
    are those of the last round; they bind candidates after ``claimed_by`` only, as one before it found the source free. A source is safe for a candidate if no earlier open one may claim it: it is surely free at the
    candidate's turn. Adds ``decision`` (null: open) with ``chosen`` and ``confidence``, and narrows ``possible``: a source
    cannot be claimed past a safe one that scores more, or less by under the tie margin.
    """
    place = [*keys, "source_seq"]
    told = edges.select(*place, F.when(F.col("possible"), F.col("provisional_number")).alias("_by"), F.lit(None).cast("long").alias("claimed_by"))
    told = told.unionByName(claims.withColumn("_by", F.lit(None).cast("long")))
    told = told.groupBy(*place).agg(F.min("_by").alias("_first"), F.min("claimed_by").alias("claimed_by"))
    rows = edges.join(told, place).filter(F.coalesce(F.col("claimed_by") >= F.col("provisional_number"), F.lit(True)))
    rows = rows.withColumn("_safe", F.coalesce(F.col("_first") >= F.col("provisional_number"), F.lit(True)))

    own = Window.partitionBy(*keys, "provisional_number")
    score, safe, explicit = F.col("score"), F.col("_safe"), F.col("explicit")
    rows = (
        rows.withColumn("_rank", F.when(~explicit, F.row_number().over(own.orderBy("explicit", F.desc("score"), "source_seq"))))
        .withColumn("_explicit", F.count_if(explicit).over(own))
        .withColumn("_explicit_safe", F.count_if(explicit & safe).over(own))
        .withColumn("_wall", F.max(F.when(~explicit & safe, F.struct("score", "source_seq"))).over(own))
    )
    rank, wall = F.col("_rank"), F.col("_wall")
    rows = (
        rows.withColumn("_only", F.max(F.when(explicit, F.col("source_seq"))).over(own))
        .withColumn("_top", F.max(F.when(rank == 1, F.struct("score", "source_seq", "_safe"))).over(own))
        .withColumn("_second", F.max(F.when(rank == 2, score)).over(own))
        .withColumn("_second_safe", F.max(F.when((rank > 1) & safe, score)).over(own))
        .withColumn("_wall_2", F.max(F.when(~explicit & safe & (F.col("source_seq") != wall["source_seq"]), score)).over(own))
    )
    top, second, second_safe = F.col("_top"), F.col("_second"), F.col("_second_safe")
    best = top["score"]
    decision = F.when(
        F.col("_explicit") == F.col("_explicit_safe"),
        F.when(F.col("_explicit") == 1, "explicit")
        .when(F.coalesce(best < CLAIM_SCORE, F.lit(True)), "none")
        .when(top["_safe"] & F.coalesce(best - second >= TIE_MARGIN, F.lit(True)), "matched")
        .when(top["_safe"] & (best - second_safe < TIE_MARGIN), "ambiguous"),
    )
    in_way = F.when(F.col("source_seq") == wall["source_seq"], F.col("_wall_2")).otherwise(wall["score"])
    open_way = F.when(explicit, F.col("_explicit_safe") == safe.cast("int")).otherwise(F.coalesce(score - in_way >= TIE_MARGIN, F.lit(True)))
    rows = rows.withColumn("decision", decision)
    chosen = F.when(F.col("decision") == "explicit", F.col("_only")).when(F.col("decision") == "matched", top["source_seq"])
    return rows.select(
        *place, "provisional_number", "score", "explicit", (F.col("possible") & open_way).alias("possible"), "decision",
        chosen.alias("chosen"), F.when(F.col("decision") == "explicit", 99).otherwise(best).alias("confidence"),
    )


def assign_edges(edges: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Decisions of serial claims over ``decision_edges``: keys, provisional_number, source_seq, confidence, decision.

    Each round decides every candidate that earlier open ones can no longer influence, all over the table at once; later
    ones then see what was claimed. The first open candidate of a matter always settles. A target's best free score falls
    by the tie margin with each claim by score, so that any number of candidates with the same target settle in a few
    rounds. Only chains longer than ``rounds`` remain; they are folded in order, each group of contenders by itself.
    Candidates without a decision have no row. The result does not depend on ``rounds``.
    """
    may = F.col("explicit") | (F.col("score") >= CLAIM_SCORE)
    open_ = edges.select(*keys, "source_seq", "provisional_number", "score", "explicit", may.alias("possible"))
    claims, parts = open_.select(*keys, "source_seq", F.col("provisional_number").alias("claimed_by")).limit(0), []
    for _ in range(rounds):
        told = cut_lineage(_settle_round(open_, claims, keys))
        settled = told.filter("decision is not null and decision <> 'none'").select(
            *keys, "provisional_number", F.col("chosen").alias("source_seq"), "confidence", "decision"
        ).distinct()
        parts.append(settled)
        claims = settled.filter("source_seq is not null").select(*keys, "source_seq", F.col("provisional_number").alias("claimed_by"))
        open_ = told.filter("decision is null").select(*open_.columns)
        if open_.isEmpty():
            break
    else:
        taken = open_.drop("possible").join(claims, [*keys, "source_seq"], "left")
        rest = contention_groups(taken.filter(F.coalesce(F.col("claimed_by") >= F.col("provisional_number"), F.lit(True))).drop("claimed_by"), keys)
        parts.append(_decide(rest, [*keys, "_group"]).drop("_group"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def greedy_assign(candidates: DataFrame, sources: DataFrame, keys: list[str], prefix: str = "AH") -> DataFrame:
    """Assigns sources in candidate order; a claimed source is not offered again inside its matter.

    Returns keys, provisional_number, source_seq (null: none), confidence, decision. The scoring is a Spark join. A
    decision depends on earlier ones through shared sources only: ``assign_edges`` settles in rounds whatever these can
    no longer change.
    """
    # read several times below: computed once
    candidates = stored(
        candidates.select(*keys, "provisional_number", "description", "citation", "date_text", "citation_count", "resolution", "mark")
    )
    decided = assign_edges(cut_lineage(decision_edges(candidates, sources, keys, prefix)), keys)
    best = top_sources(candidates.filter(F.col("citation_count") > 1), sources, keys, 1)
    several = candidates.filter(F.col("citation_count") > 1).select(*keys, "provisional_number").join(
        best.select(*keys, "provisional_number", "score"), [*keys, "provisional_number"], "left"
    )
    several = several.select(
        *keys, "provisional_number", F.lit(None).cast("long").alias("source_seq"),
        F.coalesce("score", F.lit(0)).alias("confidence"), F.lit("reviewer chooses").alias("decision"),
    )
    single = candidates.filter(F.col("citation_count") <= 1).select(*keys, "provisional_number")
    single = single.join(decided, [*keys, "provisional_number"], "left").select(
        *keys, "provisional_number", "source_seq", F.coalesce("confidence", F.lit(0)).alias("confidence"),
        F.coalesce("decision", F.lit("none")).alias("decision"),
    )
    return single.unionByName(several)


def unreferenced(sources: DataFrame, claims: DataFrame, on: list[str]) -> DataFrame:
    return sources.join(claims.select(*on), on, "left_anti")


def selected_sources(sources: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    return sources.join(candidates.filter("included").select(*on), on, "left_semi")


def match_resolutions(checks: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """First resolution, in list order, that applies to a check; its columns are null where none does.

    Two equi-joins replace the theta join: by blocker id, and by source hash for a decision
    to do without recognised text that covers a source.
    """
    code, bound = F.col("r.check_code"), F.col("r.source_sha256")
    agrees = (code.isNull() | (code == F.col("c.code"))) & (
        bound.isNull() | (bound == "") | F.coalesce(bound == F.col("c.source_sha256"), F.lit(False))
    )
    wide = (
        (F.col("r.action") == "proceed-without-ocr") & code.startswith("ocr.") & F.col("c.code").startswith("ocr.")
    )
    c, r = checks.alias("c"), resolutions.alias("r")
    same_keys = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys]

    def hits(condition: Column, extra: Column) -> DataFrame:
        on = condition
        for same in same_keys:
            on = on & same
        rows = c.join(r, on).filter(extra)
        return rows.select(
            *[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.check_id").alias("check_id"),
            F.struct("r.position", "r.action", "r.visual_review_confirmed").alias("hit"),
        )

    by_id = hits(F.col("c.check_id") == F.col("r.blocker_id"), agrees & (~F.coalesce(wide, F.lit(False)) | (bound == F.col("c.source_sha256"))))
    by_source = hits(F.col("c.source_sha256") == bound, agrees & wide)
    first = by_id.unionByName(by_source).groupBy(*keys, "check_id").agg(F.min_by("hit", "hit.position").alias("hit"))
    return checks.join(first, [*keys, "check_id"], "left").select(
        checks["*"], F.col("hit.position").alias("position"), F.col("hit.action").alias("action"),
        F.coalesce("hit.visual_review_confirmed", F.lit(False)).alias("visual_review_confirmed"),
    )
