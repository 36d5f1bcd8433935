from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from casefile.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encode():
    return pieces.Encoder(pieces.Vocabulary(MODEL), memory=500)


def test_against_the_library(encode):
    draw = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    alphabet = " a\n\tb▁é日\r;<>0x41 \U0001f600the tion "
    for k in range(4000):
        text = "".join(draw.choices(alphabet, k=draw.randrange(0, 30)))
        ids = np.frombuffer(encode.encode(text), dtype="<u4").tolist()
        assert ids == library.encode(text)
        any_ids = [draw.randrange(0, 300) if draw.random() < 0.6 else draw.randrange(32000) for _ in range(draw.randrange(9))]
        for x in (ids, any_ids):
            assert encode.vocabulary.decode(x) == library.decode(x)
    encode.check([])
    encode.fresh.append(("▁the", b"1234"))
    with pytest.raises(ValueError, match="differs"):
        encode.check([])


def test_long_stretches(encode):
    for text in ("a" * 50_000, "ab日" * 20_000, "  " * 30_000, "x" * 65 + " " + "y" * 65):
        assert np.frombuffer(encode.encode(text), dtype="<u4").tolist() == encode.vocabulary.library.encode(text)


def test_documents(spark):
    rows = [(1, "the text", 5), (2, None, 6), (2, "", 7), (None, "né\n\n ", 8), (1, "the text", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = pieces.tokenize(frame, MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, t, library.encode(t or "", add_bos=True, add_eos=True)) for i, t, _ in rows]
    assert [(r.doc_id, r.text, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in found] == want
    assert [r.n_tokens for r in found] == [len(w[2]) for w in want]
    assert [r.decoded for r in found] == [t or "" for _, t, _ in rows]
    assert pieces.tokenize(frame.filter("false"), MODEL, ids=False).count() == 0
