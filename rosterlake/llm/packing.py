"""Cost-balanced packing of documents into fixed-length sequences.

A sequence of documents of lengths l costs the sum of ``linear * l + quadratic *
l * l``, as attention stays within a document. Documents are cut at full
sequences; what remains is taken by descending cost and given to the sequence of
lowest cost that has room for it. The number of sequences is that of the tokens
divided by the length, so the last documents find no room as a whole and are cut
to fill the gaps, the lowest cost first.

Every task packs what it reads, in windows of bounded size, and has less than
one sequence left over. The remainders of ``FAN`` tasks are packed together in
the same way, so at most one sequence in some hundred thousand is short.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import materialise, only

WINDOW = 1 << 22
FAN = 256
CACHE = 1_000_000

_ODD = re.compile("[\x1c-\x1f]|<\\|")
_LATIN = re.compile("[\x00-ɏ]*")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    No token of this kind of vocabulary crosses white space, so the ids of each
    run of other characters are kept and joined. The memory is emptied when it
    holds ``CACHE`` runs. Texts for which splitting or lower-casing first could
    matter (separators that only Python counts as white space, strings of
    special tokens) are encoded whole or as written.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end = np.array([end], dtype="<u4").tobytes()
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        split, whole = [], {}
        for n, text in enumerate(texts):
            text = text or ""
            if _ODD.search(text):
                whole[n] = self._bytes(self.tok.encode(text, add_special_tokens=False).ids)
                split.append([])
            else:
                split.append((text.lower() if text.isascii() or _LATIN.fullmatch(text) else text).split())
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            known.update(zip(some, (self._bytes(e.ids) for e in self.tok.encode_batch_fast(some, add_special_tokens=False))))
        get = known.__getitem__
        return [(whole[n] if n in whole else b"".join(map(get, words))) + self.end for n, words in enumerate(split)]

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


class Piece:
    """Tokens ``start`` to ``start + length`` of a document; ``ids`` are the bytes of these tokens."""

    __slots__ = ("doc", "doc_tokens", "ids", "length", "start")

    def __init__(self, doc, doc_tokens: int, start: int, ids: memoryview):
        self.doc, self.doc_tokens, self.start, self.ids, self.length = doc, doc_tokens, start, ids, len(ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.doc_tokens, self.start, self.ids[: 4 * at]), Piece(self.doc, self.doc_tokens, self.start + at, self.ids[4 * at :])


def assign(pieces: list[Piece], size: int, linear: float, quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and the pieces (fewer tokens than one sequence) that remain."""
    full, items = [], []
    for p in pieces:
        while p.length > size:
            head, p = p.cut(size)
            full.append([head])
        items.append(p)
    items.sort(key=lambda p: -p.length)  # the cost rises with the length; the sort is stable
    n = sum(p.length for p in items) // size
    if not n:
        return full, items
    room, cost = np.full(n, size), np.zeros(n)
    open_: list[list[Piece]] = [[] for _ in range(n)]
    late = []

    def put(p: Piece, s: int) -> None:
        open_[s].append(p)
        room[s] -= p.length
        cost[s] += linear * p.length + quadratic * p.length**2

    for p in items:
        s = int(np.where(room >= p.length, cost, np.inf).argmin())
        if room[s] >= p.length:
            put(p, s)
        else:
            late.append(p)
    gaps = iter([int(s) for s in np.argsort(cost, kind="stable") if room[s]])
    s = next(gaps, None)
    rest = []
    for p in late:
        while s is not None and p.length > room[s]:
            if room[s]:
                head, p = p.cut(int(room[s]))
                put(head, s)
            s = next(gaps, None)
        if s is None:
            rest.append(p)
        else:
            put(p, s)
    return full + open_, rest


def _rows(sequences: list[list[Piece]], first: int) -> list[tuple]:
    out = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            out.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, first + k, offset))
            offset += p.length
    return out


def _packer(path: str, end: int, size: int, linear: float, quadratic: float):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("part", pa.int64()), ("ids", pa.binary())])

    def batch(rows: list[tuple], part: int | None, ids: list[bytes | None]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([part] * len(rows), pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _encoder(path, end), TaskContext.get().partitionId()
        held: list[Piece] = []
        tokens = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, made
            sequences, held = assign(held, size, linear, quadratic)
            rows = _rows(sequences, (part << 32) + made)
            made += len(sequences)
            tokens = sum(p.length for p in held)
            return batch(rows, None, [None] * len(rows))

        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for doc, ids in zip(some.column(0).to_pylist(), enc.ids(some.column(1).to_pylist())):
                    held.append(Piece(doc, len(ids) // 4, 0, memoryview(ids)))
                    tokens += len(ids) // 4
                if tokens >= WINDOW:
                    yield flush()
        if tokens:
            yield flush()
        if held:
            yield batch([(p.doc, p.start, p.length, None, p.doc_tokens, None, None) for p in held], part, [bytes(p.ids) for p in held])

    return run


def _rest(size: int, linear: float, quadratic: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "doc_id", "start"])
        pieces = [Piece(None if pd.isna(d) else int(d), t, s, memoryview(i)) for d, t, s, i in zip(pdf["doc_id"], pdf["doc_tokens"], pdf["start"], pdf["ids"])]
        sequences, last = assign(pieces, size, linear, quadratic)
        rows = _rows([*sequences, last] if last else sequences, (1 << 62) + (int(key[0]) << 32))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 4096,
    end: int = 2,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their places in the sequences.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A document is the ids of its text followed by ``end``; a null text counts as
    empty, so it is one token long. Pieces of a document are disjoint and cover
    it. Offsets of a sequence run from 0 without gaps. Documents without an id
    and repeated rows are packed like any others; documents of equal cost are
    taken in the order in which they are read, and of sequences of equal cost the
    first is filled. An empty table gives an empty result; other columns are
    ignored. The result depends on how the input is
    split into tasks, which is the same whenever a task runs again.
    """
    if not (size > 0 and linear >= 0 and quadratic >= 0):
        raise ValueError("size must be positive, the weights of the cost not negative")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    first = materialise(rows.mapInArrow(_packer(tokenizer, end, size, linear, quadratic), f"{PIECES}, part long, ids binary"), "packed")
    names = [c.split()[0] for c in PIECES.split(", ")]
    rest = first.where("part is not null").groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInPandas(_rest(size, linear, quadratic), PIECES)
    return first.where("part is null").select(*names).unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all ``documents`` in sequences of 4096 tokens."""
    import public_tokenizers

    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
