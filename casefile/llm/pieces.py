"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, with a score-ordered agenda.

A text becomes one symbol per character. The agenda holds every adjacent pair whose join is a piece; the pair with the
best score is merged, the leftmost of equal ones first, and the two new neighbour pairs join the agenda, until none is
left. Symbols that are no piece become byte pieces.

Where no piece reaches across a kind of border (white space behind another character, a letter beside another character,
a line end), no merge crosses it. That is checked when a vocabulary is loaded. The stretches between the borders are
encoded one by one, and the ids of a stretch are remembered within a Python worker, up to ``MEMORY`` stretches.

Applies to models with the identity normaliser, a dummy prefix and kept white space. After every Arrow batch all stretches
seen for the first time are compared with the library's ids, and each text whose decoding does not give back the input
with the library's decoding; a difference ends the job (``check=False`` leaves that out).
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MEMORY = 1_000_000
SHORT = 32
NEVER = float("inf")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("casefile.eachbyte", _each_byte)


class Vocabulary:
    """Pieces of a model file, and the library's processor to check against."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        special = lambda i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)
        if any(self.library.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        ids = {self.library.id_to_piece(i): i for i in range(n) if not special(i)}
        self.cost = {p: -self.library.get_score(i) for p, i in ids.items()}
        self.ids = ids
        bytes_ = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = bytes_ if all(self.library.is_byte(i) for i in bytes_) else None
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        joined = [p for p in ids if len(p) > 1]
        self.alone = "".join(c for c in "\n\t" if not any(c in p for p in joined))
        # from fine to coarse; the first whose borders cut no piece
        letters = "".join(sorted({c for p in joined for c in p if c.isalpha()}))
        ways = [f"{SPACE}*[{letters}]+|{SPACE}*[^{letters}{SPACE}{self.alone}]+|{SPACE}+", f"{SPACE}+[^{SPACE}{self.alone}]*|[^{SPACE}{self.alone}]+", r"(?s:.+)"]
        for way in ways:
            self.border = re.compile(f"[{self.alone}]|{way}" if self.alone else way)
            if all(self.border.match(p).end() == len(p) for p in joined):
                break
        surface = [self.library.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for i in range(n):
            if self.library.is_control(i):
                surface[i] = b""
            elif self.library.is_unknown(i):
                surface[i] = " ⁇ ".encode()
            elif self.library.is_byte(i):
                surface[i] = bytes([int(self.library.id_to_piece(i)[3:5], 16)])
        self.surface = surface
        self.controls = {i for i in range(n) if self.library.is_control(i)}

    def merge(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of a stretch."""
        n, cost = len(text), self.cost
        if n < 2:
            return [text] if n else []
        symbols = list(text)
        if n <= SHORT:  # a plain list serves as the agenda; min and index find the leftmost of the best
            get = cost.get
            pairs = [get(text[i : i + 2], NEVER) for i in range(n - 1)]
            while pairs and (best := min(pairs)) < NEVER:
                i = pairs.index(best)
                symbols[i : i + 2] = [joined] = [symbols[i] + symbols[i + 1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(joined + symbols[i + 1], NEVER)
                if i:
                    pairs[i - 1] = get(symbols[i - 1] + joined, NEVER)
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = joined, _ = a + b, ""
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                pair = joined + symbols[following]
                if (c := cost.get(pair)) is not None:
                    heappush(agenda, (c, left, following, len(pair)))
            previous = before[left]
            if previous >= 0:
                pair = symbols[previous] + joined
                if (c := cost.get(pair)) is not None:
                    heappush(agenda, (c, previous, left, len(pair)))
        return [s for s in symbols if s]

    def stretch(self, text: str) -> bytes:
        """The ids of a stretch as little-endian unsigned 32-bit integers."""
        found: list[int] = []
        for symbol in self.merge(text):
            if (i := self.ids.get(symbol)) is not None:
                found.append(i)
            elif self.byte_ids is not None:
                found.extend(self.byte_ids[b] for b in symbol.encode())
            elif not found or found[-1] != self.library.unk_id():
                found.append(self.library.unk_id())
        return np.array(found, dtype="<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the dummy prefix goes, bytes that are no UTF-8 become U+FFFD each."""
        inner = ids[1:-1]
        if self.controls.isdisjoint(inner):
            text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "casefile.eachbyte")
        else:  # byte pieces on either side of a control piece do not belong together
            runs: list[list[int]] = [[]]
            for i in ids:
                runs[-1].append(i) if i not in self.controls else runs.append([])
            text = "".join(b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "casefile.eachbyte") for run in runs)
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if first is not None and self.library.id_to_piece(first).startswith(SPACE) else text


class Encoder(dict):
    """Encodes texts with a vocabulary; remembers the ids of stretches, and which of them are still to be checked."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY) -> None:
        super().__init__()
        self.vocabulary, self.memory = vocabulary, memory
        self.fresh: list[tuple[str, bytes]] = []

    def __missing__(self, stretch: str) -> bytes:
        found = self.vocabulary.stretch(stretch)
        self.fresh.append((stretch, found))
        if len(stretch) <= 64:
            if len(self) >= self.memory:
                self.clear()
            self[stretch] = found
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text, without begin and end."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.vocabulary.border.findall(SPACE + text.replace(" ", SPACE))))

    def check(self, texts: list[str]) -> None:
        """Compares all stretches that are new since the last call, in one batch, with the library's ids.

        The library sees each behind a line end, which keeps it apart from the dummy prefix. Where a vocabulary's pieces
        hold line ends, the texts themselves are compared.
        """
        words, fresh, self.fresh = self.vocabulary, self.fresh, []
        if "\n" in words.alone:
            head = len(words.library.encode("\n"))
            want = words.library.encode(["\n" + s for s, _ in fresh], num_threads=1)
            pairs = zip(fresh, (w[head:] for w in want))
        else:
            pairs = (((t, self.encode(t)), words.library.encode(t)) for t in texts)
        for (text, own), ids in pairs:
            if np.array(ids, dtype="<u4").tobytes() != own:
                raise ValueError(f"differs from the library on {text[:60]!r}")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and model file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Vocabulary(path))
    return _LOADED[path]


def tokenize(docs: DataFrame, model: str, text: str = "text", check: bool = True, ids: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens`` (begin and end included), ``ids`` (binary, little-endian unsigned 32-bit),
    ``decoded``; columns of these names in ``docs`` are replaced. With ``ids=False`` there are digests instead:
    ``ids_sha256`` and ``decoded_sha256``. A null text is encoded as an empty one.

    ``model`` is a file every executor can open.
    """
    new = {"n_tokens": "bigint"} | ({"ids": "binary", "decoded": "string"} if ids else {"ids_sha256": "string", "decoded_sha256": "string"})
    kept = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes), *(f"{c} {t}" for c, t in new.items())])

    def one(encode: Encoder, body: str) -> tuple:
        words = encode.vocabulary
        ends = [np.array([i], dtype="<u4").tobytes() if i >= 0 else b"" for i in (words.bos, words.eos)]
        data = ends[0] + encode.encode(body) + ends[1]
        numbers = np.frombuffer(data, dtype="<u4").tolist()
        decoded = words.decode(numbers)
        if check and decoded != body and decoded != words.library.decode(numbers):
            raise ValueError(f"decodes otherwise than the library: {body[:60]!r}")
        if ids:
            return len(numbers), data, decoded
        return len(numbers), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(len(kept))]
            rows = [one(encode, x) for x in texts]
            if check:
                encode.check(texts)
            encode.fresh.clear()
            types = [pa.int64(), pa.binary() if ids else pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *new])

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)
