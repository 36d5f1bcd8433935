from __future__ import annotations

import random
import re

from casefile.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, known, containment=0.8):
    out = set()
    for doc_id, text in docs:
        w = split(text)
        at = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, body in known:
            t = split(body)
            have = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            if not have:
                continue
            n = L.length_class(len(t))
            for k in range(len(at) // n + 1):
                window = at[k * n : k * n + 2 * n - 4]
                places = [k * n + i for i, s in enumerate(window) if s in have]
                share = len({at[p] for p in places}) / len(have)
                if share >= containment - 1e-9:
                    out.add((doc_id, name, min(places), max(places) + 5, round(share, 9)))
    return out


def corpus():
    draw = random.Random(4)
    filler = lambda n: " ".join(draw.choices([f"w{i}" for i in range(50)] + ["licensed", "under", "the", "license"], k=n))
    known = list(L.NOTICES.items()) + [("short", "GPL v3"), ("none", None), ("MIT notice", L.NOTICES["MIT notice"])]
    docs = []
    for i in range(60):
        parts = [filler(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            words = draw.choice(list(L.NOTICES.values())).split()
            if draw.random() < 0.5:
                words[draw.randrange(len(words))] = "changed"
            parts += [" ".join(words), filler(draw.randrange(30))]
        docs.append((i, "\n".join(parts)))
    docs += [(90, None), (91, ""), (92, "MIT"), (None, L.NOTICES["MIT notice"]), (93, L.NOTICES["Apache-2.0"].upper()), (93, L.NOTICES["Apache-2.0"].upper()), (94, (L.NOTICES["MIT notice"] + " ") * 200)]
    return docs, known


def test_against_brute_force(spark):
    docs, known = corpus()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, template string")
    found = L.scan(frame, spark.createDataFrame(known, "template string, text string")).collect()
    got = [(r.doc_id, r.template, r.start, r.stop, round(r.containment, 9)) for r in found]
    assert len(got) == len(set(got)) and set(got) == slow(docs, known)


def test_bands_and_empty_tables(spark):
    for length in (5, 9, 16, 20, 100):
        assert L.length_class(length) >= length
        n = L.length_class(length)
        assert (1 - 1 / (2 * n)) ** L.bands(n, 0.8, 1e-6) < 1
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    known = L.templates(spark)
    assert [r.template for r in L.scan(docs, known).collect()] == ["MIT notice"]
    assert L.scan(docs.filter("false"), known).count() == 0
    assert L.scan(docs, known.filter("false")).count() == 0


def test_common_licences(spark):
    """A whole text, a body beyond the opening passage, other versions and identifiers."""
    docs = [
        (1, "Some words before. " + L.NOTICES["GPL-2.0 notice"]),
        (2, "SPDX-License-Identifier: LGPL-2.1-only"),
        (3, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (4, "x y " + L.NOTICES["MIT disclaimer"]),
        (5, L.NOTICES["BSD-3-Clause text"]),
    ]
    found = L.scan(spark.createDataFrame(docs, "doc_id long, text string"), L.templates(spark)).collect()
    got = {(r.doc_id, r.template) for r in found}
    assert {(1, "GPL-2.0 notice"), (2, "SPDX LGPL-2.1-only"), (3, "CC-BY-SA-4.0 notice"), (4, "MIT disclaimer"), (5, "BSD-3-Clause text")} <= got
