"""Every corpus query on the smallest tables: against its reference SQL, or what its contract says of any result."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from casefile.llm.queries import QUERIES, SQL
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), connection.execute(SQL[name]).fetchdf()) is None


def documents(connection):
    return dict(connection.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_sharding(spark, connection):
    docs, rows = documents(connection), QUERIES["op9_sharding"](spark, FOLDER).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in docs.items()}
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(40) for i in range(len(docs) // 40)]
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_pieces(spark, connection):
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    want = {}
    for d, t in documents(connection).items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_pieces"](spark, FOLDER).collect()} == want


def test_simhash(spark, connection):
    from test_simhash import slow_groups, slow_print

    docs = sorted(documents(connection).items())
    prints = [slow_print(t, 3) for _, t in docs]
    want = {docs[i][0]: (f"{prints[i]:016x}", docs[g][0]) for i, g in enumerate(slow_groups(prints, 2))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, FOLDER).collect()} == want


def test_lines(spark, connection):
    from test_lines import slow

    docs = sorted(documents(connection).items())[:60]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines.dedup_lines(frame).collect()} == dict(slow(docs))
    rows = QUERIES["op2_lines"](spark, FOLDER).collect()
    assert len(rows) == len(documents(connection)) and sum(r.n_removed for r in rows) > 0


def test_materialise(spark, connection):
    rows = QUERIES["op4_materialise"](spark, FOLDER).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.doc_id for r in rows} == set(documents(connection))
