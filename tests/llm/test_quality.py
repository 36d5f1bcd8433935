from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from casefile.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    n = len(words)
    base = (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return base, sum(text.count(c) for c in "!?"), n < 50 or 100 * len(covered) > 50 * n


def low(v):
    shift = max(0, v.bit_length() - 6)
    return v >> shift << shift


def slow(docs, rule=Q.Limits()):
    """What is kept, with sorted lists in place of sketches."""
    rows = []
    for doc_id, text, lang, source in docs:
        base, shouts, failed = counts(text)
        rate = None if failed else {"symbols": base[2], "shouts": shouts, "repeats": base[4], "dup_lines": base[3], "length": base[1]}
        rows.append((doc_id, base, failed, lang, source, rate and {k: low(v * 1000 // base[0]) for k, v in rate.items()}))

    def quartiles(match, wider=None):
        own = [r[5] for r in rows if r[5] and match(r)]
        out = {}
        for k, _ in rule.slack:
            values = sorted(r[k] for r in own)
            q = {p: values[-(-len(values) * p // 100) - 1] for p in (25, 50, 75)}
            out[k] = q if wider is None else {p: (len(own) * q[p] + rule.prior * wider[k][p]) // (len(own) + rule.prior) for p in q}
        return out

    def fences(r):
        q = quartiles(lambda x: x[3:5] == r[3:5], quartiles(lambda x: x[3] == r[3], quartiles(lambda x: True)))
        return {k: (q[k][50] - rule.spread * (q[k][50] - q[k][25]) - slack, q[k][50] + rule.spread * (q[k][75] - q[k][50]) + slack) for k, slack in rule.slack}

    kept = []
    for r in rows:
        if r[2]:
            kept.append(False)
            continue
        f = fences(r)
        kept.append(all(r[5][k] <= f[k][1] for k in f) and r[5]["length"] >= f["length"][0])
    return [(r[0], *r[1], r[2], k) for r, k in zip(rows, kept)]


def corpus():
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)] + ["longer", "wordsé", "日本"]
    docs = []
    for i in range(400):
        words = draw.choices(vocabulary, k=draw.choice([3, 49, 50, 80, 200]))
        if i % 17 == 0:
            words = [w + "###" for w in words]
        if i % 19 == 0:
            words = [w + "!!" for w in words]
        if i % 23 == 0:
            words = words[:3] * 40 + words
        text = " ".join(words)
        if i % 5 == 0:
            text = text.replace(" w1", "\n w1") + "\nsame line here\n \nsame line here\t"
        docs.append((i, text, draw.choice(["en", "en", "de", None]), draw.choice(["big", "big", "big", "small", None])))
    docs += [(900, None, "en", "big"), (901, "", None, None), (902, " \x0b\n", "en", "big"), (None, "x y z " * 30, "xx", "rare"), (1, docs[1][1], *docs[1][2:]), (903, " ".join(draw.choices(vocabulary, k=60)), "xx", "rare")]
    docs += [(904, "a b c " * 20000, "en", "big"), (905, "one\x85two " * 40, "en", "big")]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, source string, kept string, n_words int").repartition(5)
    found = Q.assess(frame)
    got = sorted(map(str, (tuple(r) for r in found.select("doc_id", *Q.BASE, "base_failed", "kept").collect())))
    want = slow(docs)
    assert got == sorted(map(str, want))
    assert any(not k and not f for *_, f, k in want) and sum(w[-1] for w in want) > 100
    kept = Q.filter_documents(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[-1])


def test_every_size_has_limits_of_its_own(spark):
    """Sources of one and of many documents, in a language of few: no size below which nothing is judged."""
    draw = random.Random(8)
    plain = lambda n: " ".join(draw.choices(["word", "other", "letters", "paper", "river", "stone"], k=n)) + f" {draw.random()}"
    docs = [(i, " ".join(f"w{draw.randrange(9999)}" for _ in range(90)), "en", "web") for i in range(120)]
    docs += [(500 + i, " ".join(f"w{draw.randrange(9999)} {'#' if j % 3 else ''}" for j in range(90)), "en", "code") for i in range(80)]
    docs += [(700, plain(2) + " " + " ".join(f"x{i}##" for i in range(70)), "qq", "rare"), (701, " ".join(f"y{i}" for i in range(70)), "qq", "rare")]
    got = {r.doc_id: r.kept for r in Q.assess(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {w[0]: w[-1] for w in slow(docs)}
    assert all(got[500 + i] for i in range(80))  # symbols are usual in this source


def test_sketches_merge(spark):
    frame = spark.range(1000).select(F.lit("en").alias("lang"), (F.col("id") % 3).alias("source"), (F.col("id") * F.col("id")).alias("v"))
    parts = Q.sketch(frame, ["lang", "source"], {"v": F.col("v")})
    whole = Q.sketch(frame, ["lang"], {"v": F.col("v")})
    assert sorted(map(tuple, Q.merge(parts, ["lang"]).collect())) == sorted(map(tuple, whole.collect()))
    q = Q.quantiles(whole, ["lang"], {"q50": 50}).first()
    assert q["size"] == 1000 and q["q50"] == low(499 * 499)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.assess(frame).count() == 0 and Q.filter_documents(frame).count() == 0
