from __future__ import annotations

import numpy as np
import corpus_pipeline as P

from casefile.llm import simhash
from casefile.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    """Runs all stages and compares each with what its operator decides on the stage's own input."""
    docs = table(spark, FOLDER, "documents")
    columns, inputs = docs.columns, {}
    for name, stage in P.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, FOLDER)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in [*inputs.items(), ("result", docs)]}
    first, cleaned, lined, fresh, kept, result = rows.values()
    judged = {r.doc_id: r.kept for r in P.quality.assess(inputs["quality_rules"]).collect()}
    assert set(cleaned) == {d for d in first if judged[d]} and all(cleaned[d].text == first[d].text for d in cleaned)
    assert set(lined) == set(cleaned) and sum(len(r.text) for r in lined.values()) < sum(len(r.text) for r in cleaned.values())
    seen = {r.doc_id: r.component_id for r in simhash.near_duplicates(inputs["near_dedup"], 5).collect()}
    assert set(fresh) == set(seen.values())
    dirty = {r.doc_id for r in P.decontaminate.contamination(inputs["decontamination"], table(spark, FOLDER, "benchmark")).collect() if r.contaminated}
    assert dirty and set(kept) == set(fresh) - dirty == set(result)
    library = P.pieces.encoder(P.MODEL).vocabulary.library
    assert all(np.frombuffer(r.ids, dtype="<u4").tolist() == library.encode(r.text, add_bos=True, add_eos=True) for r in result.values())
    again = {r.doc_id: bytes(r.ids) for r in P.run(spark, FOLDER).collect()}
    assert again == {d: bytes(r.ids) for d, r in result.items()}


def test_awkward_rows(spark):
    """Nulls in any column, repeated rows, empty texts, extra columns, and no rows at all."""
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(1, body, "en", "a", 1, 5), (1, body, "en", "a", 1, 5), (2, body, None, None, None, 6), (None, body + " x", "en", "a", 1, 7), (3, None, "en", "a", 0, 8), (4, "", "en", "a", 0, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line int")
    for given, want in ((docs, 1), (docs.filter("false"), 0)):
        for _, stage in P.STAGES:
            given = stage(spark, given, FOLDER)
        assert given.count() >= want


def test_one_of_each_group(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(5, body, 0), (5, body, 0), (6, body, 1), (None, body, 2), (7, "other", 3), (7, "other", 4), (None, "third", 5), (None, "third", 5), (8, None, 6), (9, "", 7)]
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in found) == sorted(map(str, [(5, body), (7, "other"), (None, "third"), (8, None)]))
