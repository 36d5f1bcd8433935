from __future__ import annotations

import random
import re

from casefile.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items, window=10):
    words, hit, ids = split(text), set(), set()
    for item_id, body in items:
        w = split(body)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if n else ():
            for q in range(len(words) - n + 1):
                if words[q : q + n] == w[p : p + n]:
                    hit.update(range(q, q + n))
                    ids.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(ids)


def corpus():
    draw = random.Random(5)
    vocabulary = [*"abcdefgh", *(f"w{i}" for i in range(60)), "É", "é"]
    text = lambda n: " ".join(draw.choices(vocabulary, weights=[30] * 8 + [1] * 62, k=n))
    items = [(i, text(draw.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "..."), (None, text(15)), (15, items[5][1]), (3, text(14)), (3, items[3][1]), (16, "a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        parts = [text(draw.randrange(40))]
        for _ in range(draw.randrange(3)):
            w = split(draw.choice(items)[1])
            a = draw.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + draw.choice([5, 9, 10, 12, 40])]).upper() if "é" not in w else " ".join(w), text(draw.randrange(20))]
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (100, ""), (None, docs[3][1]), (None, docs[4][1]), (5, docs[5][1]), (6, docs[7][1]), (101, "a " * 300), (102, "A-b c.d'e" * 500)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, pos int, term string").repartition(5)
    found = D.contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) for r in found.collect()))
    want = []
    for doc_id, text in docs:
        n, hit, ids = slow(text, items)
        want.append((str(doc_id), n, hit, ids, len(ids), hit > 0))
    assert got == sorted(want)
    assert sum(w[5] for w in want) > 10
    kept = D.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in docs if not slow(t, items)[1])


def test_shuffled_lists_agree(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    found = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted((str(r.doc_id), r.n_hit, r["items"]) for r in found.collect()) == sorted((str(i), *slow(t, items, 5)[1:]) for i, t in docs)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{k} long, text string") for k in ("doc_id", "item_id"))
    assert D.contamination(docs.filter("false"), items).count() == 0
    assert [r.n_items for r in D.contamination(docs, items.filter("false")).collect()] == [0]


def test_proximity(spark, tmp_path):
    docs, items = corpus()
    docs = [(i, t) for i, t in docs if i is not None and i < 60]
    items = [x for x in items if x[0] in (1, 2, 4, 6, 8)]
    terms = D.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string"), terms, f"{tmp_path}/index")
    counts = {}
    for _, t in docs:
        for w in split(t):
            counts[w] = counts.get(w, 0) + 1
    got = {(r.item_id, r.doc_id) for r in D.proximity(index, terms, 12).collect()}
    for item_id, body in items:
        need = set(split(body))
        least = min(counts.get(w, 0) for w in need)
        for doc_id, t in docs:
            w = split(t)
            rare = [x for x in need if counts.get(x, 0) == least]
            near = [any(set(w[max(0, p - 12) : p + 13]) >= need for p, v in enumerate(w) if v == x) for x in rare]
            if all(near) or not any(near):  # equally rare words may serve as the middle
                assert ((item_id, doc_id) in got) == all(near)
    assert got
