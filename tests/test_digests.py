from __future__ import annotations

import hashlib
import json
import random

from casefile.operators import digests

K = ["m"]
SCHEMA = "m long, id string, n long, f struct<b:string,a:array<struct<y:int,x:string>>>, tags map<string,int>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(row):
    _, name, n, f, tags = row
    out = {"id": name, "n": n}
    if f is not None:
        inner = {"a": f[1] and [{"x": x, "y": y} for y, x in f[1]], "b": f[0]}
        out["f"] = {k: v for k, v in inner.items() if v is not None}
    if tags is not None:
        out["tags"] = [{"key": k, "value": tags[k]} for k in sorted(tags)]
    return json.dumps({k: out[k] for k in sorted(out) if out[k] is not None}, separators=(",", ":"), ensure_ascii=False)


def tree(rows):
    """All nodes of one matter, in one task."""
    leaves: dict = {}
    for r in rows:
        leaves.setdefault(sha(r[1])[:4], []).append(sha(canonical(r)))
    level = {p: (len(d), sha(",".join(sorted(d)))) for p, d in leaves.items()}
    nodes = dict(level)
    for size in (2, 0):
        above: dict = {}
        for p in sorted(level):
            above.setdefault(p[:size], []).append(p)
        level = {p: (sum(level[c][0] for c in kids), sha(",".join(f"{c}:{level[c][1]}" for c in kids))) for p, kids in above.items()}
        nodes |= level
    return nodes


def build(seed, count):
    draw = random.Random(seed)
    rows = []
    for m in (1, 2):
        for i in range(count):
            f = draw.choice([None, (None, None), ("b", [(1, "x"), (2, 'q"\\é')]), ("c", [])])
            rows.append((m, f"r{i}", draw.choice([None, i]), f, draw.choice([None, {}, {"k": 1, "a": 2}])))
    return rows


def test_equals_a_tree_made_in_one_task(spark):
    rows = build(1, 700)
    rows.append(rows[5])  # an equal row counts again
    found = digests.digest_tree(spark.createDataFrame(rows, SCHEMA).repartition(5), K, "id")
    got = {(r.m, r.path): (r.rows, r.digest) for r in found.collect()}
    assert got == {(m, p): v for m in (1, 2) for p, v in tree([r for r in rows if r[0] == m]).items()}
    swapped = [(m, i, n, f, t and dict(reversed(t.items()))) for m, i, n, f, t in rows[::-1]]
    again = digests.digest_tree(spark.createDataFrame(swapped, SCHEMA).select("tags", "f", "id", "n", "m"), K, "id")
    assert {(r.m, r.path): (r.rows, r.digest) for r in again.collect()} == got
    assert digests.digest_tree(spark.createDataFrame([], SCHEMA), K, "id").count() == 0


def test_changed_rows(spark):
    before = build(2, 300)
    after = [r for r in before if r[1] not in ("r7", "r250")]
    after = [(m, i, -1 if (m, i) in ((1, "r9"), (1, "r200")) else n, f, t) for m, i, n, f, t in after] + [(2, "new", 1, None, None), (3, "only", 1, None, None)]
    prev, cur = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)
    trees = [digests.digest_tree(x, K, "id") for x in (prev, cur)]
    want = {(1, "r7", "removed"), (2, "r7", "removed"), (1, "r250", "removed"), (2, "r250", "removed"), (1, "r9", "changed"), (1, "r200", "changed"), (2, "new", "added"), (3, "only", "added")}
    assert {tuple(r) for r in digests.changed_rows(prev, cur, K, "id", *trees).collect()} == want
    leaves = {tuple(r) for r in digests.changed_leaves(*trees, K).collect()}
    assert leaves == {(m, sha(i)[:4]) for m, i, _ in want}
    same = digests.root_pairs(trees[0], trees[0], K)
    assert same.filter("previous <=> current").count() == 2 and digests.changed_leaves(trees[0], trees[0], K).count() == 0
