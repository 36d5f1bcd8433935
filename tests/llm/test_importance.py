from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from casefile.llm import importance
from casefile.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def features(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]


def slow(docs, target, percent=25, least=20):
    """Sorted (doc_id, n_features, weight, score, rank) by the definition, features spelt out."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows, able = [], []
    for d, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, None])
        if len(words(text)) >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in frame.collect()), key=str)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    target = pq.read_table(f"{FOLDER}/benchmark.parquet")["text"].to_pylist()
    assert found(QUERIES["op11_importance"](spark, FOLDER)) == slow(docs, target)


def test_odd_rows(spark):
    draw = random.Random(5)
    vocabulary = ["Alpha", "beta", "ÄÖ", "naïve", "x" * 63, "y" * 64, "z" * 200, "7", "日本語", "É", "a b", "--", "one\x00two", "tab\there"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 5, 19, 20, 40, 300])))) for i in range(60)]
    docs += [(None, docs[5][1]), (None, None), (3, docs[3][1]), (3, docs[3][1]), (80, None), (81, ""), (82, " .,- \n"), (83, "Z" * 5000)]
    target = ["alpha beta beta " * 30, None, "", "É ÄÖ 7"]
    frame = spark.createDataFrame([(*d, "junk", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(5)
    goal = spark.createDataFrame([(t, 2) for t in target], "text string, doc_id int")
    for most in (importance.DICTIONARY, 3, 0):  # the dictionary's size changes nothing
        assert found(importance.resample(frame, goal, most=most)) == slow(docs, target)
    assert found(importance.resample(frame, goal.limit(0))) == slow(docs, [])
    assert importance.resample(frame.limit(0), goal).collect() == []


def test_pieces(monkeypatch):
    """Long texts in pieces, with pairs across them."""
    draw = random.Random(6)
    texts = [" ".join(draw.choices(["ab", "cde", "q" * 70, "Füße", "1"], k=n)) for n in (0, 1, 3, 400, 2, 700)] + ["w" * 900, "  " * 300 + "end"]
    automaton = importance.automaton_of([b"ab", b"cde"])
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(importance, "PIECE", size)
        got = [Counter() for _ in texts]
        for owner, buckets, _ in importance.scan([t.encode() for t in texts], automaton):
            for o, b in zip(owner.tolist(), buckets.tolist()):
                got[o][b] += 1
        assert got == [Counter(features(t)) for t in texts]


def test_composition():
    draw = random.Random(7)
    for n in (1, 2, 31, 63):
        a, b = draw.randbytes(9), draw.randbytes(n)
        got = importance.composed(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)
