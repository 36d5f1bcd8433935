from __future__ import annotations

import random

import pyarrow.parquet as pq

from casefile.llm import minhash
from casefile.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingles(text, k=3):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow(docs, percent=85):
    """(doc_id, n_shingles, component_id, kept), all pairs compared."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        ids = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return sorted(((d, len(s), least[find(i)], d is not None and d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus():
    """Families around the threshold, chains, a large family, texts with shared passages, copies and odd rows."""
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return words

    for n in (3, 5, 20, 60, 150, 400):
        for _ in range(8):
            words = draw.choices(vocabulary, k=n)
            texts += [words, edited(words, 1), edited(words, max(1, n // 60)), edited(words, max(1, n // 30)), words + draw.choices(vocabulary, k=n // 10)]
            texts.append(edited(texts[-2], max(1, n // 60)))
    centre = draw.choices(vocabulary, k=200)
    texts += [edited(centre, draw.choice([1, 2, 3, 6])) for _ in range(80)]
    passage = draw.choices(vocabulary, k=60)
    texts += [passage + draw.choices(vocabulary, k=draw.randrange(5, 30)) for _ in range(80)]
    draw.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return docs + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE "), (None, docs[0][1]), (None, None), (None, "alone here"), (7, docs[7][1]), (7, docs[7][1]), (9005, "b c d")]


def test_against_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, size int, key string").repartition(5)
    want = slow(docs)
    assert found(minhash.near_duplicates(frame)) == want
    assert found(minhash.near_duplicates(frame, long_list=3)) == want  # every list beyond three is split
    assert len({w[2] for w in want}) < 0.8 * len(docs)
    assert minhash.near_duplicates(frame.limit(0)).collect() == []


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    assert found(QUERIES["op13_minhash"](spark, FOLDER)) == slow(docs)


def test_threshold():
    m = minhash.least_matches(85, 1e-6)
    tail = lambda m: sum(__import__("math").comb(48, i) * 0.85**i * 0.15 ** (48 - i) for i in range(m))
    assert tail(m) < 1e-6 <= tail(m + 1)
    assert minhash.least_matches(100, 1e-6) == 48


def test_very_long_text(spark):
    words = [f"t{i}" for i in range(200_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:190_000] + ["x"])), (3, " ".join(words[:100_000]))]
    assert [(r[0], r[2]) for r in found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))] == [(1, 1), (2, 1), (3, 3)]


def test_family_without_a_near_centre(spark, monkeypatch):
    """Copies with few and with many changes out of few words: most are far from the centre, and near to one another."""
    draw = random.Random(9)
    vocabulary, pool = [f"w{i}" for i in range(3000)], [f"p{i}" for i in range(12)]
    base = draw.choices(vocabulary, k=300)
    docs = []
    for i in range(400):
        words = list(base)
        for at in draw.sample(range(5, 295, 10), draw.choice([4, 6, 9, 10, 12])):
            words[at] = pool[at // 10 % 12]
        docs.append((i, " ".join(words)))
    compared, verified = [], minhash.verified

    def counted(pairs, held, percent):
        compared.append(pairs.count())
        return verified(pairs, held, percent)

    monkeypatch.setattr(minhash, "verified", counted)
    assert found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == slow(docs)
    assert sum(compared) < 50 * len(docs)  # of 79,800 pairs; 70,547 when whole lists met at once
