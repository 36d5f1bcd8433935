"""Gold cases of the citation, order, planning and review rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casefile.functions import patterns as P
from casefile.functions import text as T
from casefile.functions.ordered import neighbours, number_rows, running_max, running_sum
from casefile.operators import arrangement, attachments, changes, citations, groups, matching, matter, planning, quality, report, sheets, similarity
from casefile.operators.components import components
from casefile.streaming import journal

K = ["m"]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


TOKENS = {
    "[AH xx; AH xx]": ["[AH xx]", "[AH xx]"], "[Exhibit]; [Exhibit]": ["[Exhibit]", "[Exhibit]"], "[Exhib xx]": ["[Exhib xx]"],
    "[for background only]": [], "I refer to the report [AH1/12-18].": ["[AH1/12-18]"], "See [RC 1 / xx].": ["[RC 1 / xx]"],
    "See [RC-1/34-38].": ["[RC-1/34-38]"], "text (CC-23) text": ["(CC-23)"], "text (Exhibit) text": ["(Exhibit)"], "text (AHxx)": ["(AHxx)"],
    "(BB-xx, BBxx, BB-x)": ["(BB-xx)", "(BBxx)", "(BB-x)"], "[AH-xx, AH-xx]": ["[AH-xx]", "[AH-xx]"], "[the contract, AH-xx]": [],
    "(emphasis added)": [], "(page 4)": [], "(March 3)": [], "(para 12)": [], "(COVID-19)": [], "des courriels [Exhibit; AH-xx].": ["[Exhibit]", "[AH-xx]"],
    "[Pièce A]": [], "": [],
}


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TOKENS)), "n int, text string")
    got = {r.text: [t.raw for t in r.t] for r in df.select("text", citations.citation_tokens("text").alias("t")).collect()}
    assert got == TOKENS


def test_page_tokens(spark):
    df = spark.createDataFrame([("a [AH1/12-18] b",), ("See [RC 1 / xx].",), ("[RC-1/34-38]",), ("[AH2/7]",)], "text string")
    got = [tuple(r.t[0])[4:9] for r in df.select(citations.citation_tokens("text").alias("t")).collect()]
    assert got == [("AH", 1, 12, 18, "resolved"), ("RC", 1, None, None, "unresolved"), ("RC", 1, 34, 38, "resolved"), ("AH", 2, 7, 7, "resolved")]


COUNTS = {
    "I refer to the email (CC-23). I attach the March invoices.": 2, "I attach the March invoices.": 1, "The contract is attached.": 1,
    "I enclose the purchase orders.": 1, "The appendices are appended.": 1, "I attach Dr. Smith's report.": 1,
    "I attached great importance to the timing of the meeting.": 0, "The 3 March email chain was hostile in tone.": 0,
    "The invoice was attached to that email.": 0, "I attach the contract and the invoice.": 1, "I refer to the email and invoice.": 1,
    "I refer to the email [LV1/xx] and invoice.": 1,
    "I also refer to the payment ledger [LV1/xx] and to the milestone invoice dated 28 February 2026.": 2,
    "I refer to the invoice [LV1/xx]; I also refer to the email [LV2/xx] and to the report dated 1 March 2026.": 3,
}


def test_candidates(spark):
    df = spark.createDataFrame([(i, 1, i + 1, t) for i, t in enumerate(COUNTS)], "m long, seq long, number int, text string")
    found = citations.create_candidates(df, K).toPandas()
    counts = found.groupby("m").size().reindex(range(len(COUNTS)), fill_value=0)
    assert list(counts) == list(COUNTS.values())
    ledger = found[found.m == 12].sort_values("provisional_number")
    assert list(ledger.description) == ["payment ledger", "milestone invoice"]
    assert list(ledger.date_text) == ["Date not stated", "28 February 2026"] and set(ledger.citation_count) == {2}
    third = found[found.m == 13].sort_values("provisional_number").iloc[2]
    assert (third.description, third.date_text, third.citation_ordinal) == ("report", "1 March 2026", 3)


def test_identity(spark):
    df = spark.createDataFrame([(1, 1, 1, "See the invoice [LV1/xx]."), (1, 2, 2, "See [LV-xx].")], "m long, seq long, number int, text string")
    configured = spark.createDataFrame([(1, "s", "Vera A", "VA")], "m long, statement_id string, witness_name string, witness_initials string")
    named = citations.resolve_identity(citations.create_candidates(df, K), configured, K)
    assert rows(named, "mark", "exhibit_initials", "exhibit_sequence") == [("LV 1", "LV", 1), ("LV 2", "LV", 1)]


def test_number_paragraphs(spark):
    texts = ["1. First", "2.", "Second", "3.", "4. Fourth", "loose", "item", ""]
    levels = [None] * 6 + [0, None]
    df = spark.createDataFrame([(1, i + 1, t, l) for i, (t, l) in enumerate(zip(texts, levels))], "m long, seq long, text string, list_level int")
    got = rows(citations.number_paragraphs(df, K), "seq", "number", "text")
    assert got == [(1, 1, "First"), (3, 2, "Second"), (5, 4, "Fourth"), (7, 1, "item")]


def test_text_rules(spark):
    df = spark.createDataFrame([("a&#65;&#x42;&amp;lt; Ｆｕｌｌ — x", "A   B ; a b;;C")], "t string, v string")
    got = df.select(
        T.decode_entities("t").alias("d"), T.normalize_matter("t").alias("n"), T.parse_value_list("v").alias("v"), T.roman(F.lit(1994)).alias("r"),
        T.split_clauses(F.lit("I saw Dr. Smith. He left! Then?")).alias("c"), T.safe_name(F.lit("..\\x/.a?b"), F.lit("1")).alias("s"),
    ).first()
    assert got.d == "aAB&lt; Ｆｕｌｌ — x" and "FULL-X" in got.n.replace(" ", "")
    assert got.v == ["A B", "C"] and got.r == "mcmxciv" and got.c == ["I saw Dr. Smith.", "He left!", "Then?"] and got.s == "_a_b"


def test_volumes(spark):
    data = [(1, "one", 1, 4), (1, "two", 2, 7), (1, "three", 3, 3)]
    df = spark.createDataFrame(data, "m long, item_id string, position long, pages int")
    assert rows(planning.plan_volumes(df, K, 10), "item_id", "volume", "volume_pages") == [("one", 1, 4), ("three", 2, 10), ("two", 2, 10)]
    df = spark.createDataFrame([(1, "long", 1, 22), (1, "later", 2, 2)], "m long, item_id string, position long, pages int")
    assert rows(planning.plan_volumes(df, K, 10), "item_id", "volume", "oversize") == [("later", 2, False), ("long", 1, True)]


def plan_items(spark, sizes, optional=0):
    data = [(1, f"e{i + 1}", i + 1, s + optional, optional, s) for i, s in enumerate(sizes)]
    return spark.createDataFrame(data, "m long, item_id string, position long, physical_pages int, optional_pages int, content_pages int")


def test_build_plan(spark):
    plan = planning.build_plan(plan_items(spark, [4, 5, 3]), K, page_limit=10)
    assert rows(plan, "item_id", "volume", "total_pages") == [("e1", 1, 6), ("e2", 2, 10), ("e3", 2, 10)]
    plan = planning.build_plan(plan_items(spark, [4, 2]), K, match_pdf_order=True)
    assert rows(plan, "legal_start", "legal_end") == [(3, 6), (7, 8)]
    plan = planning.build_plan(plan_items(spark, [2, 2]), K, page_limit=4, match_pdf_order=True)
    assert rows(plan, "legal_start") == [(3,), (7,)]
    for counted, start in ((False, 1), (True, 2)):
        plan = planning.build_plan(plan_items(spark, [1, 1], 1), K, page_limit=4, count_optional=counted, continuous=False)
        assert rows(plan, "legal_start", "content_start") == [(start, 4), (start, 4)]
    plan = planning.build_plan(plan_items(spark, [2, 2, 2]), K, page_limit=8, index_pages=3)
    assert rows(plan, "item_id", "volume", "total_pages") == [("e1", 1, 8), ("e2", 1, 8), ("e3", 2, 6)]


def test_next_fit_chunks_equal_one_pass(spark):
    rng = np.random.default_rng(3)
    data = [(m, i + 1, int(rng.integers(1, 12))) for m in range(6) for i in range(int(rng.integers(1, 90)))]
    df = spark.createDataFrame(data, "m long, position long, w int")
    whole = rows(planning.next_fit(df, K, "position", "w", "w", 20), "m", "position", "container", "used")
    assert rows(planning.next_fit(df, K, "position", "w", "w", 20, size=7), "m", "position", "container", "used") == whole
    expected, state = [], {}
    for m, p, w in sorted(data):
        number, used = state.get(m, (0, 0))
        if number == 0 or used + w > 20:
            number, used = number + 1, 0
        expected.append((m, p, number, float(used)))
        state[m] = (number, used + w)
    assert whole == expected


def test_ordered_functions_equal_plain_windows(spark):
    rng = np.random.default_rng(5)
    data = [(int(rng.integers(0, 3)) if rng.random() < 0.5 else 0, i, int(rng.integers(0, 50))) for i in range(400)]
    df = spark.createDataFrame(data, "m long, at long, v long").withColumn("wide", F.floor(F.col("at") / 64)).withColumn("fine", F.floor(F.col("at") / 8))
    frame = pd.DataFrame(data, columns=["m", "at", "v"])
    frame["n"] = frame.groupby("m").cumcount() + 1
    frame["s"] = frame.groupby("m").v.cumsum()
    frame["x"] = frame.groupby("m").v.cummax().groupby(frame.m).shift()
    got = number_rows(df, K, ["at"], "n", ["wide", "fine"])
    got = running_sum(got, K, ["at"], "v", "s", ["wide"])
    got = running_max(got, K, ["at"], "v", "x", ["wide", "fine"]).toPandas().sort_values("at", ignore_index=True)
    assert (got.n == frame.n).all() and (got.s == frame.s).all() and got.x.fillna(-1).astype(int).tolist() == frame.x.fillna(-1).astype(int).tolist()
    near = neighbours(number_rows(df, K, ["at"], "n", ["wide"]), K, "n", ["at"], size=5).toPandas().sort_values("at", ignore_index=True)
    assert near.prev_at.fillna(-1).tolist() == frame.groupby("m")["at"].shift().fillna(-1).tolist()
    assert near.next_at.fillna(-1).tolist() == frame.groupby("m")["at"].shift(-1).fillna(-1).tolist()


NODE = "m long, pos long, section_id string, heading string, inner_pos long, exhibit_id string"


def nodes(spark, *items):
    """Items: an exhibit id, or (section, [exhibits])."""
    data = []
    for pos, item in enumerate(items, 1):
        if isinstance(item, str):
            data.append((1, pos, None, None, None, item))
        else:
            data += [(1, pos, item[0], f"H {item[0]}", i, x) for i, x in enumerate(item[1], 1)] or [(1, pos, item[0], f"H {item[0]}", None, None)]
    return spark.createDataFrame(data, NODE)


def shape(df):
    out = []
    for r in sorted(df.collect(), key=lambda r: (r.pos, r.inner_pos or 0)):
        if r.section_id is None:
            out.append(r.exhibit_id)
        elif out and isinstance(out[-1], tuple) and out[-1][0] == r.section_id:
            out[-1][1].append(r.exhibit_id)
        else:
            out.append((r.section_id, [r.exhibit_id] if r.exhibit_id else []))
    return out


def test_reconcile_keeps_order_in_large_matters(spark):
    """Children of one parent far down the list: their order is no fraction of the parent's place."""
    n = 120_000
    whole = spark.range(1, n + 1).select(
        F.lit(1).cast("long").alias("m"), F.col("id").alias("pos"), F.lit(None).cast("string").alias("section_id"),
        F.lit(None).cast("string").alias("heading"), F.lit(None).cast("long").alias("inner_pos"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("exhibit_id"),
    )
    extra = [(1, n + i, f"c{i}", f"x{n}") for i in range(6)]
    added = spark.createDataFrame(extra, "m long, ord long, exhibit_id string, after_id string")
    ids = whole.select("m", (F.col("pos") - 1).alias("ord"), "exhibit_id").unionByName(added.select("m", "ord", "exhibit_id"))
    found = arrangement.reconcile_arrangement(whole, ids, K, added.select("m", "exhibit_id", "after_id"))
    tail = {r.exhibit_id: r.pos for r in found.filter(F.col("pos") >= n).collect()}
    assert tail == {f"x{n}": n} | {f"c{i}": n + 1 + i for i in range(6)}
    assert found.select("pos").distinct().count() == n + 6


def test_reconcile(spark):
    ids = spark.createDataFrame([(1, i, x) for i, x in enumerate(["keep", "also-keep", "new"])], "m long, ord long, exhibit_id string")
    got = arrangement.reconcile_arrangement(nodes(spark, ("s", ["keep", "stale"]), "also-keep"), ids, K)
    assert shape(got) == [("s", ["keep"]), "also-keep", "new"]
    glue = spark.createDataFrame([(1, "c1", "p"), (1, "c2", "p")], "m long, exhibit_id string, after_id string")
    ids = spark.createDataFrame([(1, i, x) for i, x in enumerate(["p", "x", "c1", "c2"])], "m long, ord long, exhibit_id string")
    assert shape(arrangement.reconcile_arrangement(nodes(spark, "c2", "p", "x"), ids, K, glue)) == ["p", "c1", "c2", "x"]
    assert shape(arrangement.reconcile_arrangement(nodes(spark, ("s", ["p", "x"]), ("t", ["gone"])), ids, K, glue)) == [("s", ["p", "c1", "c2", "x"]), ("t", [])]


def test_sort_and_location(spark):
    start = nodes(spark, "z", "y", ("s1", ["d", "b"]), "a", ("s2", ["c", "a2"]))
    names = spark.createDataFrame([(1, x, x) for x in ["z", "y", "d", "b", "a", "c", "a2"]], "m long, exhibit_id string, name string")
    got = shape(arrangement.sort_within_sections(start, names, K, ["name"]))
    assert got == ["y", "z", ("s1", ["b", "d"]), "a", ("s2", ["a2", "c"])]
    where = arrangement.container_location(nodes(spark, "a", "b", ("s", ["c"]), "d"), K)
    assert rows(where, "exhibit_id", "index", "length") == [("a", 0, 2), ("b", 1, 2), ("c", 0, 1), ("d", 0, 1)]


@pytest.mark.parametrize(
    ("action", "exhibit", "section", "index", "expected"),
    [
        ("move", "a", None, 2, ["b", ("s", ["c", "d"]), "a", "e"]),
        ("move", "e", None, 0, ["e", "a", "b", ("s", ["c", "d"])]),
        ("move", "a", "s", 1, ["b", ("s", ["c", "a", "d"]), "e"]),
        ("move", "d", "s", 0, ["a", "b", ("s", ["d", "c"]), "e"]),
        ("move", "c", None, 4, ["a", "b", ("s", ["d"]), "e", "c"]),
        ("move-section", None, "s", 0, [("s", ["c", "d"]), "a", "b", "e"]),
        ("move-section", None, "s", 3, ["a", "b", "e", ("s", ["c", "d"])]),
        ("delete-section", None, "s", 0, ["a", "b", "c", "d", "e"]),
        ("add-section", "b", "n", 0, [("n", ["b"]), "a", ("s", ["c", "d"]), "e"]),
        ("add-section", None, "n", 4, ["a", "b", ("s", ["c", "d"]), "e", ("n", [])]),
        ("move", "a", None, 4, None), ("move", "gone", None, 0, None), ("move", "a", "s", 3, None),
    ],
)
def test_edits(spark, action, exhibit, section, index, expected):
    start = nodes(spark, "a", "b", ("s", ["c", "d"]), "e")
    edit = spark.createDataFrame([(1, action, exhibit, section, "New", index)], "m long, action string, exhibit_id string, section_id string, heading string, index int")
    changed, refused = arrangement.edit_arrangement(start, edit, K)
    assert shape(changed) == (expected or shape(start)) and (refused.count() == 1) == (expected is None)


def test_paginate(spark):
    data = [(1, 1, "e1", "exhibit", False, 46.0), (1, 2, "s", "section", False, 30.0), (1, 3, "e2", "exhibit", False, 46.0)]
    df = spark.createDataFrame(data, "m long, position long, row_id string, kind string, group_break boolean, height double")
    placed, errors = planning.paginate_rows(df, K, 100.0, 2.0)
    assert rows(placed, "row_id", "page") == [("e1", 1), ("e2", 2), ("s", 2)] and errors.count() == 0
    _, errors = planning.paginate_rows(df, K, 70.0, 2.0)
    assert rows(errors, "problem") == [("ORPHAN_HEADING_UNAVOIDABLE",)]


def greedy_inputs(spark, copies=1):
    rng = np.random.default_rng(11)
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotel", "india", "juliet"]
    cands, sources = [], []
    for m in range(5):
        for n in range(1, 25):
            chosen = " ".join(rng.choice(words, 4, replace=False))
            cands.append((m, n, f"AH {n}", chosen, "", "Date not stated", 1 if rng.random() < 0.9 else 2, "none"))
            marker = f"AH{n}" if rng.random() < 0.1 else ("N/A" if rng.random() < 0.05 else None)
            text = " ".join(rng.choice(words, int(rng.integers(3, 7)), replace=False))
            for c in range(copies if n % 5 == 0 else 1):
                sources.append((m, n * 10 + c, "file.txt", text, marker))
    c = spark.createDataFrame(cands, "m long, provisional_number long, mark string, description string, citation string, date_text string, citation_count int, resolution string")
    return c, spark.createDataFrame(sources, "m long, source_seq long, name string, text string, marker string")


def brute_assign(cands, sources):
    out, claimed = [], {}
    for c in sorted(cands.collect(), key=lambda r: (r.m, r.provisional_number)):
        mine = [s for s in sorted(sources, key=lambda s: s.source_seq) if s.m == c.m]
        used = claimed.setdefault(c.m, set())
        target = {w for w in f"{c.description} {c.citation} {c.date_text}".lower().split() if len(w) > 3}
        score = lambda s: int(65 * len(target & set(f"file txt {s.text}".split())) / len(target) + 0.5)
        if c.citation_count > 1:
            out.append((c.m, c.provisional_number, None, max(score(s) for s in mine if s.marker != "N/A"), "reviewer chooses"))
            continue
        explicit = [s for s in mine if s.marker == c.mark.replace(" ", "") and s.source_seq not in used]
        if len(explicit) == 1:
            used.add(explicit[0].source_seq)
            out.append((c.m, c.provisional_number, explicit[0].source_seq, 99, "explicit"))
            continue
        ranked = sorted(((-score(s), s.source_seq) for s in mine if s.marker != "N/A" and s.source_seq not in used))
        if not ranked or -ranked[0][0] < 45:
            out.append((c.m, c.provisional_number, None, 0, "none"))
        elif len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 8:
            out.append((c.m, c.provisional_number, None, -ranked[0][0], "ambiguous"))
        else:
            used.add(ranked[0][1])
            out.append((c.m, c.provisional_number, ranked[0][1], -ranked[0][0], "matched"))
    return sorted(out, key=str)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 5), (7, 6), (None, 1)] + [(i, i + 1) for i in range(100, 160)] + [(9, i) for i in range(200, 260)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6, 9: 9} | {i: 100 for i in range(100, 161)} | {i: 9 for i in range(200, 260)}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_assign(spark):
    cands, sources = greedy_inputs(spark, copies=3)
    got = matching.greedy_assign(cands, sources, K)
    got = sorted((tuple(r) for r in got.select("m", "provisional_number", "source_seq", "confidence", "decision").collect()), key=str)
    assert got == brute_assign(cands, sources.collect())


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "POSTING_BLOCK", 5)
    rng = np.random.default_rng(2)
    vocabulary = [f"word{i:02d}" for i in range(60)]
    base = [list(rng.choice(vocabulary, 30, replace=False)) for _ in range(6)]
    docs = []
    for i in range(60):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 7))):
            words[int(rng.integers(0, 30))] = str(rng.choice(vocabulary))
        docs.append((i, " ".join(words[: int(rng.integers(20, 31))])))
    df = spark.createDataFrame(docs, "source_id long, text string")
    got = rows(similarity.near_duplicates(df), "left_id", "right_id", "percent")
    sets = {}
    for i, t in docs:
        sets.setdefault(frozenset(t.split()), i)
    items = sorted((i, s) for s, i in sets.items())
    expected = []
    for x, (i, a) in enumerate(items):
        for j, b in items[x + 1 :]:
            score = len(a & b) / min(len(a), len(b))
            if score >= 0.82:
                expected.append((i, j, int(score * 100 + 0.5)))
    assert got == sorted(expected)


CAND = (
    "m long, candidate_id string, seq long, bundle_mark string, evidence_id string, source_sha256 string, included boolean, confirmed boolean, "
    "manual_addition boolean, repeat_decision string, selection string, parent_sha256 string"
)


def test_groups(spark):
    def derive(second_hash, decision, second_pages="1-1"):
        data = [(1, "a", 4, "AH1", "e1", "h", True, True, False, None, "1-1", None), (1, "b", 30, "AH1", "e2", second_hash, True, True, False, decision, second_pages, None)]
        return groups.derive_groups(spark.createDataFrame(data, CAND), K)

    assert rows(derive("h", None), "decision_pending", "members") == [(True, 1)]
    assert rows(derive("h", "same"), "decision_pending", "members", "references") == [(False, 2, 2)]
    assert derive("other", None).count() == 2 and derive("h", "separate").count() == 2
    assert rows(derive("h", "same", "2-2"), "selection_conflict") == [(True,)]


def test_suggestions(spark):
    schema = (
        "m long, reference_id string, paragraph int, initials string, sequence int, page_start long, page_end long, label_start string, label_end string, "
        "requested_start long, requested_end long, volume int, multi_volume boolean, exhibit_number int, description string"
    )
    data = [
        (1, "a", 5, "RC", 1, 7, 30, None, None, None, None, 1, False, 1, ""), (1, "b", 7, "RC", 1, 7, 30, None, None, 34, 38, 1, False, 1, ""),
        (1, "c", 8, "RC", 1, 7, 30, "LV-0007", "LV-0030", None, None, 1, False, 1, ""), (1, "d", 9, "AH", 1, 6, 6, None, None, None, None, 2, True, 1, ""),
    ]
    loose = spark.createDataFrame([(1, "x", None, None, None, 1, 1, None, None, None, None, 1, False, 1, "Manual document")], schema)
    lines = planning.statement_suggestions(spark.createDataFrame(data, schema), loose, K).orderBy("block", "line_order")
    assert [r.line for r in lines.collect()] == [
        "Paragraph 5 - [RC1/7-30]", "Paragraph 7 - [RC1/7-30] (requested 34-38; review)", "Paragraph 8 - [RC1/LV-0007-LV-0030]",
        "Paragraph 9 - [AH1/Vol. 2/6]", "Uncited exhibits — no statement reference", "1. Manual document — page 1",
    ]


def test_unmatched_details(spark):
    schema = "m long, candidate_id string, paragraph int, citation_count int, citation_ordinal int, description string, manual_addition boolean, included boolean, evidence_id string"
    data = [(1, "a", 12, 1, None, "x", False, True, None), (1, "b", 12, 3, 2, "x", False, True, None), (1, "c", 0, 1, None, "Uncited checklist", True, True, None), (1, "d", 0, 1, None, " ", True, True, None)]
    got = [r.detail for r in quality.unmatched(spark.createDataFrame(data, schema), K).orderBy("candidate_id").collect()]
    assert got == [
        "Paragraph 12 has no selected source file.", "Paragraph 12, reference 2 of 3, has no selected source file.",
        "Uncited checklist has no selected source file.", "This added exhibit has no selected source file.",
    ]


def test_matter_details(spark):
    texts = ["IN THE LONDON COURT OF INTERNATIONAL ARBITRATION", "Case No. LCIA-2026-0042", "Northbridge Renewables Limited v Meridian Components Limited", "[HEARING DATE]"]
    df = spark.createDataFrame([(1, "cover", i, t) for i, t in enumerate(texts)], "m long, role string, line_no int, text string")
    got = rows(matter.matter_findings(df, K), "kind", "value")
    assert got == sorted([
        ("forum", texts[0]), ("matter-number", "LCIA-2026-0042"), ("matter-title", texts[2]), ("party-name", "Meridian Components Limited"),
        ("party-name", "Northbridge Renewables Limited"), ("placeholder", "[HEARING DATE]"),
    ])


def test_sheets(spark):
    areas = [("'Ledger'!$B$2:$D$9", "Ledger"), ("'O''Brien'!$A$1:$B$2", "O'Brien"), ("Ledger!A1:B2,Ledger!D1:E2", "Ledger")]
    df = spark.createDataFrame(areas, "raw string, sheet string")
    got = [tuple(r.a)[:4] for r in df.select(sheets.print_area("raw", "sheet").alias("a")).collect()]
    assert got == [(2, 2, 4, 9), (1, 1, 2, 2), (None,) * 4]
    corners = "sheet_id long, left_col int, top_row int, right_col int, bottom_row int"
    start, merge = spark.createDataFrame([(1, 1, 1, 8, 13)], corners), spark.createDataFrame([(1, 1, 13, 8, 15)], corners)
    assert rows(sheets.expand_ranges(start, merge), "right_col", "bottom_row") == [(8, 15)]
    assert rows(sheets.range_overlaps(start, merge), "clipped") == [(True,)]


def test_attachment_tree(spark):
    data = [("h", "1", "same.pdf", "x1"), ("h", "2", "same.pdf", "x1"), ("h", "3", "forwarded.eml", "x2"), ("h", "3.1", "inner.pdf", "x3"), ("h", "4", "photo.png", "x4")]
    parts = spark.createDataFrame([(1, *d, None) for d in data], "m long, parent_sha256 string, ordinal string, raw_name string, child_sha256 string, mime string")
    tree = attachments.attachment_tree(parts, K)
    assert tree.select("identity").distinct().count() == 5 and rows(tree.filter("nested"), "ordinal") == [("3.1",)] and rows(tree.filter("not supported"), "name") == [("photo.png",)]
    one = tree.filter("ordinal = '4'").select("m", "identity", F.lit("leave-out").alias("disposition"))
    assert attachments.unresolved_attachments(tree, one.limit(0), ["m", "identity"]).count() == 5
    assert attachments.unresolved_attachments(tree, one, ["m", "identity"]).count() == 4


def test_compare_builds(spark):
    snap = "m long, exhibit_id string, description string, position int, section string"
    a = spark.createDataFrame([(1, "x", "one", 1, "s"), (2, "x", "one", 1, "s"), (3, "x", "one", 1, "s"), (4, "x", "one", 1, "s")], snap)
    b = spark.createDataFrame([(1, "x", "one", 1, "s"), (2, "x", "two", 1, "s"), (3, "x", "one", 2, "t"), (4, "x", "one", 1, "t")], snap)
    settings = "m long, setting string, value string"
    p = spark.createDataFrame([(i, "volume_page_limit", "1") for i in (1, 2, 3, 4)], settings)
    c = spark.createDataFrame([(i, "volume_page_limit", "2" if i == 2 else "1") for i in (1, 2, 3, 4)], settings)
    got = rows(changes.compare_builds(a, b, K, p, c), "m", "categories")
    assert got == [(1, ""), (2, "Index description changed; Volume limit changed"), (3, "Order changed"), (4, "Index sections changed")]


def test_journal_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = [(int(rng.integers(1, 5)), i, "clean" if rng.random() < 0.2 else "write", int(rng.integers(0, 40))) for i in range(120)]
    schema = "journal_id long, arrival long, action string, revision long"
    df = spark.createDataFrame(data, schema)
    columns = ["journal_id", "arrival", "accepted", "current_revision"]
    expected = sorted((tuple(r) for r in journal.journal_states(df, ["journal_id"]).select(*columns).collect()), key=str)
    source = str(tmp_path / "in")
    df.filter("arrival < 60").coalesce(1).write.parquet(source)
    df.filter("arrival >= 60").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", journal.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = journal.journal_stream(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("memory").queryName("journal_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = sorted((tuple(r) for r in spark.table("journal_out").select(*columns).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == expected


def test_review_change_stream(spark, tmp_path):
    schema = "m long, candidate_id string, evidence_id string, source_sha256 string, repeat_decision string, confirmed boolean"
    base = spark.createDataFrame([(1, c, e, h, None, True) for c, e, h in (("a", "e1", "h1"), ("b", "e2", "h2"), ("c", "e3", "h3"), ("d", "e2", "h2"))], schema)
    event = "m long, candidate_id string, at long, action string, new_evidence string, new_sha256 string, new_decision string"
    events = [(1, "a", 1, "source", "e2", "h2", None), (1, "c", 2, "label", None, None, None), (1, "b", 3, "confirm", None, None, None)]
    df = spark.createDataFrame(events, event)
    expected = [("a", "e2", False), ("b", "e2", True), ("c", "e3", True), ("d", "e2", False)]
    assert rows(journal.review_changes(base, df, K), "candidate_id", "evidence_id", "confirmed") == expected
    got, _ = streamed_reviews(spark, tmp_path, base, [df])
    assert rows(got, "candidate_id", "evidence_id", "confirmed") == expected


def streamed_reviews(spark, tmp_path, base, batches):
    """State after the edits of ``batches``, one micro-batch each, and the log; the stream is stopped and resumed between them."""
    source, log, events = str(tmp_path / "in"), str(tmp_path / "log"), batches[0].schema
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", journal.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for batch in batches:
            batch.coalesce(1).write.mode("append").parquet(source)
            stream = journal.review_change_stream(spark.readStream.schema(events).parquet(source), base, K)
            query = stream.writeStream.format("parquet").option("path", log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = spark.read.parquet(log)
    return journal.review_state(base, found, K), found


def test_review_change_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(12)
    pick = lambda values: values[int(rng.integers(0, len(values)))]
    contents = {"e1": "h1", "e2": "h2", "e3": "h2", "e4": "h3", None: None}
    start = []
    for m in (1, 2):
        for c in range(9):
            e = pick(list(contents))
            start.append((m, f"c{c}", e, contents[e], pick([None, "same"]), pick([True, True, False, None])))
    base = spark.createDataFrame(start, "m long, candidate_id string, evidence_id string, source_sha256 string, repeat_decision string, confirmed boolean")
    events = []
    for at in range(1, 121):
        action = pick(["source", "confirm", "confirm", "repeat", "pages", "label"])
        e = pick(list(contents)) if action == "source" else None
        decision = pick([None, "same", "other"]) if action == "repeat" else None
        events.append((int(rng.integers(1, 4)), f"c{int(rng.integers(0, 10))}", at, action, e, contents[e], decision))  # some are of unknown candidates
    df = spark.createDataFrame(events, "m long, candidate_id string, at long, action string, new_evidence string, new_sha256 string, new_decision string")
    expected = rows(journal.review_changes(base, df, K), *base.columns)
    got, log = streamed_reviews(spark, tmp_path, base, [df.filter("at <= 50"), df.filter("at > 50 AND at <= 90"), df.filter("at > 90")])
    assert rows(got, *base.columns) == expected
    known = {r[:2] for r in start}
    assert log.count() == sum(e[:2] in known for e in events)  # a row per edit, none for siblings
    assert {r[-1] for r in expected} >= {True, False}


def test_nested_messages_keep_deep_ones(spark):
    data = [(1, 10, 1, 1), (1, 11, 10, 2), (1, 12, 11, 1), (1, 13, 12, 1), (1, 14, 1, 2)]
    parts = spark.createDataFrame(data, "root long, message_id long, parent_id long, place int")
    found = {r.message_id: (r.ordinal, r.issue) for r in attachments.flatten_messages(parts, "root", depth=3).collect()}
    assert found == {10: ("1", None), 14: ("2", None), 11: ("1.2", None), 12: ("1.2.1", None), 13: (None, "attachment is nested too deeply")}


def test_identity_and_disposition(spark):
    children = spark.createDataFrame([(1, "h", "1", "c", "h:1:c"), (2, "h", "2", "d", "h:1:d")], "id long, parent_sha256 string, ordinal string, child_sha256 string, identity string")
    assert rows(attachments.verify_identity(children), "id") == [(2,)]
    decisions = spark.createDataFrame([(1, "leave-out"), (2, "print-with-email")], "id long, disposition string")
    assert rows(attachments.by_disposition(children, decisions, ["id"], "print-with-email"), "id") == [(2,)]


def test_patches_bind_to_the_reviewed_hash(spark):
    schema = "m long, role string, finding_id string, value string, reviewed_sha256 string"
    found = spark.createDataFrame([(1, "cover", "a", "Old", "h"), (1, "cover", "b", "Gone", "h"), (1, "cover", "c", "Kept", "h")], schema)
    patches = spark.createDataFrame([(1, "cover", "a", "h", " New. "), (1, "cover", "b", "h", " "), (1, "cover", "c", "stale", "Other")], "m long, role string, finding_id string, pdf_sha256 string, value string")
    assert rows(matter.apply_patches(found, patches, K), "finding_id", "value") == [("a", "New"), ("c", "Kept")]


def test_resolutions_need_current_hashes(spark):
    given = spark.createDataFrame([(1, "r1", "s", "h", None), (1, "r2", "s", "old", None), (1, "r3", None, None, "c1"), (1, "r4", None, None, "c2"), (1, "r5", None, None, None)],
                                  "m long, id string, source_id string, source_sha256 string, candidate_id string")
    hashes = spark.createDataFrame([(1, "s", "h")], "m long, source_id string, sha256 string")
    valid = spark.createDataFrame([(1, "c1")], "m long, candidate_id string")
    assert rows(changes.valid_resolutions(given, hashes, valid, K), "id") == [("r1",), ("r3",), ("r5",)]


def test_section_around_several_exhibits(spark):
    schema = "m long, pos int, section_id string, heading string, inner_pos int, exhibit_id string"
    data = [(1, "a", None), (2, "b", "s"), (2, "c", "s"), (3, "d", None), (4, "e", "t"), (5, "f", None)]
    tops, seen = [], {}
    for pos, x, section in data:
        seen[pos] = seen.get(pos, 0) + 1
        tops.append((pos, section, section and section.upper(), seen[pos] if section else None, x))
    nodes = spark.createDataFrame([(m, *t) for m in range(1, 9) for t in tops], schema)
    wanted = {1: ("n", "N", 2, ["f", "e", "c", "a"]), 2: ("n", "N", 4, ["a"]), 3: ("n", "N", 5, ["a"]), 4: ("s", "N", 0, []), 5: ("n", "N", 0, ["a", "a"]), 6: ("n", "N", 0, ["zz"]), 7: ("n", "N", 0, []), 8: ("n", " ", 0, [])}
    sections = spark.createDataFrame([(m, w[0], w[1], w[2]) for m, w in wanted.items()], "m long, section_id string, heading string, index int")
    members = spark.createDataFrame([(m, x) for m, w in wanted.items() for x in w[3]], "m long, exhibit_id string")
    placed, refused = arrangement.add_sections(nodes, sections, members, K)
    assert rows(refused, "m", "issue") == [(3, "index is outside"), (4, "section already exists"), (5, "exhibit is selected more than once"), (6, "exhibit is not present"), (8, "section id or heading is invalid")]
    of = lambda m: sorted(((r.pos, r.inner_pos or 0, r.section_id, r.exhibit_id) for r in placed.filter(f"m = {m}").collect()), key=str)
    # an exhibit keeps its order, and a section that lost all of its own stays empty
    assert of(1) == [(1, 1, "s", "b"), (2, 0, None, "d"), (3, 1, "n", "a"), (3, 2, "n", "c"), (3, 3, "n", "e"), (3, 4, "n", "f"), (4, 0, "t", None)]
    assert of(2) == [(1, 1, "s", "b"), (1, 2, "s", "c"), (2, 0, None, "d"), (3, 1, "t", "e"), (4, 0, None, "f"), (5, 1, "n", "a")]
    assert of(7)[0] == (1, 0, "n", None) and len(of(7)) == 7
    assert of(3) == of(8) == [(p, i or 0, s_, x) for p, s_, _, i, x in tops]


def test_flat_saved_order(spark):
    order = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "m long, position int, exhibit_id string")
    nodes = arrangement.legacy_order(order, K)
    ids = spark.createDataFrame([(1, 0, "y"), (1, 1, "x"), (1, 2, "z")], "m long, ord long, exhibit_id string")
    assert rows(arrangement.reconcile_arrangement(nodes, ids, K), "pos", "exhibit_id") == [(1, "x"), (2, "y"), (3, "z")]


def test_files_in_and_out(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.TXT").write_bytes(b"hello")
    found = attachments.read_sources(spark, f"file://{tmp_path}/in").first()
    assert (found["name"], found["extension"], found["bytes"], found["sha256"]) == ("note.TXT", "txt", 5, hashlib.sha256(b"hello").hexdigest())
    manifest = spark.createDataFrame([(2, "file", "b"), (1, "file", "a"), (1, "note", "c")], "m long, kind string, entry string")
    report.write_manifest(manifest, f"file://{tmp_path}/manifest", K)
    assert rows(spark.read.json(f"file://{tmp_path}/manifest"), "m", "kind", "entry") == [(1, "file", "a"), (1, "note", "c"), (2, "file", "b")]
    lines = spark.createDataFrame([(1, "head", 1, 1, "t")], "m long, section string, row_order int, line_no int, text string")
    report.write_report(lines, f"file://{tmp_path}/report", K)
    assert rows(spark.read.parquet(f"file://{tmp_path}/report"), "text") == [("t",)]


def test_source_marker_and_wide_numbers(spark):
    df = spark.createDataFrame([("EXHIBIT AH 12 follows",), ("Exhibit N/A",), ("exhibit AH1000",), ("none",), ("&#0000000065;&#x000042;&#0;",)], "t string")
    got = [r.x for r in df.select(T.source_marker("t").alias("x")).collect()]
    assert got == ["AH12", "N/A", "AH1000", None, None]
    assert df.select(T.decode_entities("t").alias("d")).collect()[4].d.startswith("AB")


def test_compare_builds_of_settings_and_fingerprints(spark):
    exhibit = "m long, exhibit_id string, description string"
    prev = spark.createDataFrame([(1, "x", "a"), (2, "x", "a")], exhibit)
    cur = spark.createDataFrame([(1, "x", "a"), (2, "x", "a"), (3, "x", "a"), (4, "x", "a")], exhibit)
    setting = sorted(s for names in changes.SETTING_CATEGORIES.values() for s in names)[0]
    before = spark.createDataFrame([(4, setting, "1"), (5, setting, "1")], "m long, setting string, value string")
    after = spark.createDataFrame([(4, setting, "1"), (5, setting, "2")], "m long, setting string, value string")
    prints = spark.createDataFrame([(1, "f", "g"), (2, "f", "f")], "m long, previous string, current string")
    found = {r.m: (r.changed, r.summary) for r in changes.compare_builds(prev, cur, K, before, after, fingerprints=prints).collect()}
    assert found[1] == (True, changes.OTHER_CHANGE) and found[2] == (False, "No substantive change")
    assert found[3] == (True, "Bundle created.") and found[4][1] != "Bundle created."
    assert found[5][0] and set(found) == {1, 2, 3, 4, 5}


def test_near_duplicates_leave_a_task_when_alike(spark, monkeypatch):
    """Sets that share one rare word are met where they are: only pairs that share most of their rarest words come out."""
    words = [f"common{i:02d}" for i in range(40)]
    docs = [(i, " ".join([f"rare{i % 5}", *[f"own{i}x{j}" for j in range(12)], *words[: 20 + i % 7]])) for i in range(60)]
    docs += [(100 + i, docs[i][1] + f" extra{i}") for i in range(3)]
    df = spark.createDataFrame(docs, "source_id long, text string")
    sets, _ = similarity.fingerprint_sets(df)
    assert rows(similarity.near_set_pairs(sets), "left_set", "right_set") == [(0, 100), (1, 101), (2, 102)]
    arrow = sets.selectExpr("set_id", "0 as block", "n", "cast(ceil(n * 0.82) as int) as needed", "transform(words, w -> cast(shiftright(w, 32) as int)) as words").toArrow()
    for portion in (1, 50, 10_000):
        met = similarity._shared_words(arrow, portion).to_pylist()
        assert sorted((r["small"], r["large"]) for r in met) == [(0, 100), (1, 101), (2, 102)]


def test_paragraph_jobs_fold_copies(spark, monkeypatch):
    """Copies of a text are read once a share, with the rows that the rules give for every paragraph by itself."""
    texts = ["I attach the contract. It was signed.", "I refer to the email [AH-xx; AH1/3-XX]. See (para 12).", "No more.", None, "A\u0000. I enclose the report."]
    df = spark.createDataFrame([(i % 3, i, i, texts[i % 5]) for i in range(200)], "m long, seq long, number int, text string")
    read, cut = [], citations.cut_lineage
    monkeypatch.setattr(citations, "cut_lineage", lambda frame: read.append(cut(frame)) or read[-1])
    found = citations.paragraph_jobs(df, K)
    assert [r.count() for r in read] == [df.select("text", F.pmod(F.xxhash64("m", "seq"), F.lit(citations.SHARES))).distinct().count()]
    assert found.filter("text is null").isEmpty()
    got = found.select("m", "seq", F.explode("jobs").alias("j")).select("m", "seq", "j.span", "j.tokens", "j.count", "j.signals")
    plain = df.select("m", "seq", F.explode(citations.citation_jobs("text")).alias("j"))
    signals = F.array_join(citations.citation_signals("j.span", "AH", F.size("j.tokens") > 0), "|").alias("signals")
    want = plain.select("m", "seq", "j.span", "j.tokens", "j.count", signals)
    assert want.count() > 100 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_split_at_is_split(spark):
    df = spark.createDataFrame([("a. b!  c",), ("Dr. x",), ("",), ("a\u0000b. c",), (" .",), (None,)], "t string")
    for pattern in (P.CLAUSE_BREAK, P.BRACKETS, "b"):
        same = df.select(T.split_at("t", pattern).alias("x"), F.split("t", pattern, -1).alias("y")).collect()
        assert all(r.x == r.y for r in same)


def test_scored_pairs_are_narrow(spark, monkeypatch):
    """Pairs are named by numbers and their words are numbers: no digest or word is shuffled with a pair."""
    cands, sources = greedy_inputs(spark, copies=2)
    seen, score = [], matching.score_profiles
    monkeypatch.setattr(matching, "score_profiles", lambda *a: seen.append(score(*a)) or seen[-1])
    matching.score_pairs(cands, sources, K).collect()
    matching.top_sources(cands, sources, K).collect()
    matching.decision_edges(cands, sources, K).collect()
    assert len(seen) == 4
    for pairs in seen:
        assert {dict(pairs.dtypes)[c] for c in ("target", "profile")} == {"bigint"}
