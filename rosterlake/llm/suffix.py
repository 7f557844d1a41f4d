"""Removal of long byte strings that occur more than once.

Every string of ``SPAN`` bytes of a text that also starts anywhere else is to be
removed. All suffixes cannot be sorted within bounded disk (a difference cover
modulo 3 samples two of three positions, each a row of a position and a name),
so the sample is a cover chosen by content instead of by position: of the
``CORE``-byte strings inside a span, the one with the smallest hash, the
rightmost of equal ones. Equal spans choose the same offset, which is what a
difference cover is for, and one position in about 70 is sampled.

1. Sample. Each sampled position serves a run of consecutive spans. Samples
   whose core occurs once in all texts are dropped: no span of theirs repeats.
2. Name. A sample's triple is the text left of the core, the core and the text
   right of it, as far as its spans reach. Triples are named and counted; all
   spans of a triple that occurs twice repeat.
3. Merge the rest. Among triples that occur once but share a core with others,
   the spans are ordered by their offset to the core and their content, and
   neighbours are compared.
4. Cut. The spans' bytes are joined back to the texts and removed.

Steps 2 and 3 compare contents by 128-bit hashes; the 64-bit hash of a core only
says which samples may belong together. A task never gets all samples of a
frequent string: they are counted before they are shuffled, and joined by salts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import counted_join, materialise, only

SPAN = 200
CORE = 64
CHUNK = 1 << 17
FILTER_BITS = 26
DENSE = 4096
PIECE = 4096

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
_LOW = (1 << 22) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        out[size : 2 * size] = out[: min(size, n - size)] * step
        size *= 2
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        size = CHUNK + 4 * SPAN + 1
        _TABLES["place"] = (_LOW - np.arange(size)).astype(np.uint64)  # the later position is the smaller number
        for k, base in enumerate(_BASES):
            _TABLES[f"up{k}"] = _powers(base, size)
            _TABLES[f"down{k}"] = _powers(pow(base, -1, 1 << 64), size)
            _TABLES[f"byte{k}"] = np.random.default_rng(11 + k).integers(1, 1 << 63, 256, dtype=np.uint64)
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all substrings of a piece of bytes, each in constant time; ``kind`` 0 and 1 are independent."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        t = _tables()
        self.down = t[f"down{kind}"]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(t[f"byte{kind}"][data] * t[f"up{kind}"][: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.down[start])


def samples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """For texts data[starts[i]:ends[i]]: hashes, core positions, and first and last span served by each."""
    hashes = Hashes(data)
    n = len(data)
    if n < SPAN:
        none = np.empty(0, np.int64)
        return hashes, none, none, none
    low = (hashes.prefix[CORE:] - hashes.prefix[: n - CORE + 1]) * hashes.down[: n - CORE + 1]
    low &= ~np.uint64(_LOW)
    low |= _tables()["place"][: len(low)]
    reach, width = 1, SPAN - CORE + 1
    while 2 * reach <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    core = _LOW - (low & np.uint64(_LOW)).astype(np.int64)  # of the span at each position
    inside = np.zeros(n + 1, np.int64)
    long = ends - starts >= SPAN
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - SPAN + 1, -1)
    valid = np.cumsum(inside)[: len(core)] > 0
    new = np.r_[True, core[1:] != core[:-1]]
    new[starts[long]] = True
    new &= valid
    first = np.flatnonzero(new)
    end = valid & np.r_[~valid[1:] | new[1:], True]
    return hashes, core[first], first, np.flatnonzero(end)


def _pieces(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(data, starts, ends, values of the columns, offsets in the texts) in pieces of about CHUNK bytes.

    A longer text comes in pieces that overlap by SPAN - 1 bytes, so each span
    is in one of them.
    """
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        body = text.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        row, n = 0, len(text)
        while row < n:
            if offsets[row + 1] - offsets[row] > CHUNK:
                for s in range(0, offsets[row + 1] - offsets[row] - SPAN + 1, CHUNK):
                    e = min(s + CHUNK + SPAN - 1, offsets[row + 1] - offsets[row])
                    yield data[offsets[row] + s : offsets[row] + e], np.array([0]), np.array([e - s]), [v[row : row + 1] for v in values], np.array([s])
                row += 1
                continue
            last = row + 1
            while last < n and offsets[last + 1] - offsets[row] <= CHUNK:
                last += 1
            yield data[offsets[row] : offsets[last]], offsets[row:last] - offsets[row], offsets[row + 1 : last + 1] - offsets[row], [v[row:last] for v in values], np.zeros(last - row, np.int64)
            row = last


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data, starts, ends, _, _ in _pieces(batches, ()):
        hashes, core, _, _ = samples(data, starts, ends)
        h, n = np.unique(hashes.of(core, CORE).view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])


class Filter:
    """A fixed number of bits that says no only for hashes that were not put in."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def passes(self, h: np.ndarray) -> np.ndarray:
        u = h.view(np.uint64)
        ok = np.ones(len(h), bool)
        for part in (u & np.uint64((1 << FILTER_BITS) - 1), u >> np.uint64(64 - FILTER_BITS)):
            ok &= ((self.words[part >> np.uint64(6)] >> (part & np.uint64(63))) & np.uint64(1)) == 1
        return ok

    @staticmethod
    def of(df: DataFrame) -> Filter:
        """Of the column ``h``; at most 2 ** FILTER_BITS / 64 rows reach the driver."""
        low = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        high = F.expr(f"shiftrightunsigned(h, {64 - FILTER_BITS})")
        bits = df.select(F.explode(F.array(low, high)).alias("p"))
        one = F.expr("shiftleft(1L, cast(p & 63 as int))")
        rows = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
        words = np.zeros((1 << FILTER_BITS) // 64, np.uint64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
        return Filter(words)


def _triple(data: np.ndarray, core: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128-bit names of triples, shape (samples, 2): of the text that a sample's spans reach and the core's offset in it."""
    body = memoryview(np.ascontiguousarray(data))
    digest = xxhash.xxh3_128_digest
    names = b"".join(digest(body[a:b], seed) for a, b, seed in zip(first.tolist(), (last + SPAN).tolist(), (core - first).tolist()))
    return np.frombuffer(names, np.int64).reshape(-1, 2)


def _triples(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Filter = known.value
        for data, starts, ends, (a, b), begin in _pieces(batches, ("a", "b")):
            hashes, core, first, last = samples(data, starts, ends)
            h = hashes.of(core, CORE).view(np.int64)
            keep = wanted.passes(h)
            core, first, last, h = core[keep], first[keep], last[keep], h[keep]
            if len(h):
                doc = np.searchsorted(starts, first, side="right") - 1
                lo = (first - starts[doc] + begin[doc]).astype(np.int64)
                g = _triple(data, core, first, last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[doc]), pa.array(b[doc]), pa.array(lo), pa.array((last - first).astype(np.int32)), pa.array(h), pa.array(g[:, 0]), pa.array(g[:, 1])],
                    names=["a", "b", "lo", "more", "h", "g", "g2"],
                )

    return run


def _contexts(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Filter = known.value
        seen: set[tuple[int, int]] = set()
        for data, starts, ends, _, _ in _pieces(batches, ()):
            hashes, core, first, last = samples(data, starts, ends)
            h = hashes.of(core, CORE).view(np.int64)
            keep = np.flatnonzero(wanted.passes(h))
            g = _triple(data, core[keep], first[keep], last[keep])
            if len(seen) > 1_000_000:
                seen.clear()
            new = []
            for i, x in zip(keep.tolist(), map(tuple, g.tolist())):
                if x not in seen:
                    seen.add(x)
                    new.append((h[i], *x, core[i] - first[i], data[first[i] : last[i] + SPAN].tobytes()))
            if new:
                cols = list(zip(*new))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "g", "g2", "off", "body"])

    return run


def _spans_of(bodies: list[bytes], off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all spans of some contexts: the context's number, the span's place in it, and two hashes (spans, 2) of its content, the first of its offset to the core too."""
    who, place, key = [], [], []
    at, size = 0, 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and (size == 0 or size + len(bodies[end]) <= CHUNK):
            size += len(bodies[end])
            end += 1
        length = np.array([len(b) for b in bodies[at:end]])
        begin = np.cumsum(length) - length
        n = length - SPAN + 1
        own = np.repeat(np.arange(end - at), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        data = np.frombuffer(b"".join(bodies[at:end]), np.uint8)
        h, h2 = (Hashes(data, kind).of(begin[own] + inner, SPAN) for kind in (0, 1))
        rel = (off[at:end][own] - inner).astype(np.uint64)
        who.append(own + at)
        place.append(inner)
        key.append(np.stack([mix(h ^ mix(rel + np.uint64(0x632BE59BD9B4E019))), h2], 1))
        at = end
    return np.concatenate(who), np.concatenate(place), np.concatenate(key)


def _repeated(t: pa.Table) -> pa.RecordBatch:
    """The spans that stand in two of the contexts: runs (g, g2, skip, more). Equal spans have equal cores, so cores need not be told apart."""
    who, place, key = _spans_of(t["body"].to_pylist(), t["off"].to_numpy())
    by = np.lexsort((key[:, 1], key[:, 0]))
    same = (key[by][1:] == key[by][:-1]).all(1)
    hit = np.zeros(len(key), bool)
    hit[by[1:][same]] = True
    hit[by[:-1][same]] = True
    return _runs(t["g"].to_numpy(), t["g2"].to_numpy(), who[hit], place[hit])


def _by_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by core, compared in pieces that end with a core; no core has more than DENSE contexts here."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            kept.append(batch.slice(at, PIECE))
            size += kept[-1].num_rows
            if size > PIECE:
                t = pa.Table.from_batches(kept).combine_chunks()
                h = t["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield _repeated(t.slice(0, cut))
                    kept, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if size:
        yield _repeated(pa.Table.from_batches(kept))


def _runs(g: np.ndarray, g2: np.ndarray, who: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    start = np.r_[True, (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)] if len(who) else np.empty(0, bool)
    s = np.flatnonzero(start)
    e = np.r_[s[1:] - 1, len(who) - 1] if len(s) else s
    cols = [pa.array(g[who[s]]), pa.array(g2[who[s]]), pa.array(place[s].astype(np.int32)), pa.array((place[e] - place[s]).astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, names=["g", "g2", "skip", "more"])


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            some = batch.slice(at, 2048)
            who, place, key = _spans_of(some.column("body").to_pylist(), some.column("off").to_numpy())
            key = key.view(np.int64)
            cols = [pa.array(some.column(c).to_numpy()[who]) for c in ("g", "g2")] + [pa.array(place.astype(np.int32)), pa.array(key[:, 0]), pa.array(key[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "g2", "skip", "key", "key2"])


def repeats(docs: DataFrame) -> DataFrame:
    """Removed bytes per text: (a, b, spans) for texts (a, b, text) with some; spans are pairs (from, upto) that may overlap."""
    spark = docs.sparkSession
    text = docs.select("text")
    often = text.mapInArrow(_cores, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    known = spark.sparkContext.broadcast(Filter.of(often.select("h")))
    rows = materialise(docs.select("a", "b", "text").mapInArrow(_triples(known), "a long, b long, lo long, more int, h long, g long, g2 long"), "triples")
    named = materialise(rows.groupBy("h", "g", "g2").agg(F.count("*").alias("m")), "named")
    cores = named.groupBy("h").agg(F.count("*").alias("kinds"), F.min("m").alias("least"))
    open_ = materialise(cores.where("kinds > 1 and least = 1").select("h", "kinds"), "open")
    again = spark.sparkContext.broadcast(Filter.of(open_.select("h")))
    bodies = text.mapInArrow(_contexts(again), "h long, g long, g2 long, off int, body binary")
    bodies = materialise(bodies.join(open_, "h"), "bodies")
    name = ["g", "g2"]
    few = bodies.where(F.col("kinds") <= DENSE).dropDuplicates(["h", *name]).select("h", *name, "off", "body")
    few = few.repartition("h").sortWithinPartitions("h").mapInArrow(_by_core, "g long, g2 long, skip int, more int")
    many = bodies.where(F.col("kinds") > DENSE).dropDuplicates(["h", *name]).select(*name, "off", "body").mapInArrow(_span_rows, "g long, g2 long, skip int, key long, key2 long")
    many = materialise(many, "dense")
    pairs = materialise(many.groupBy("key", "key2").agg(F.count("*").alias("times")).where("times > 1"), "pairs")
    dense = counted_join(many, pairs, ["key", "key2"], "times").select(*name, "skip", F.lit(0).alias("more"))
    part = few.unionByName(dense).withColumn("whole", F.lit(False))
    whole = named.where("m > 1").select(*name, F.lit(0).alias("skip"), F.lit(0).alias("more"), F.lit(True).alias("whole"), "m")
    part = part.join(named.where("m = 1").select(*name, "m"), name)
    hits = counted_join(rows.select("a", "b", "lo", F.col("more").alias("all"), *name), materialise(whole.unionByName(part), "repeated"), name, "m")
    start = F.col("lo") + F.col("skip")
    upto = start + F.when(F.col("whole"), F.col("all")).otherwise(F.col("more")) + SPAN
    spans = hits.select("a", "b", F.struct(start.alias("s"), upto.alias("e")).alias("x"))
    return spans.groupBy("a", "b").agg(F.collect_set("x").alias("spans"))


def _merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _cut(text_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                removed, runs, digest, left = [], [], [], []
                n_bytes = []
                for body, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                    body = body or b""
                    gone = _merged(spans)
                    kept, here = [], 0
                    for s, e in gone:
                        kept.append(body[here:s])
                        here = e
                    rest = b"".join([*kept, body[here:]])
                    n_bytes.append(len(body))
                    removed.append(len(body) - len(rest))
                    runs.append(len(gone))
                    digest.append(hashlib.sha256(rest).hexdigest())
                    left.append(rest.decode("utf-8", "ignore") if text_out else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(left, pa.string())],
                    names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_out: bool = True) -> DataFrame:
    """The input's columns other than the text, with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    A byte is removed if some SPAN-byte string that covers it also starts
    anywhere else in the input, in the same text or in another; strings do not
    cross texts and are judged on the input. Texts of fewer than SPAN bytes stay
    as they are, and so does an empty text; null counts as empty. ``kept_text``
    is the rest decoded, without characters that were cut in part, or null if
    ``text_out`` is false. Rows repeated as a whole are each other's copies.
    Input columns named like the added ones are replaced, all others may have any
    name; a null id counts as one id of its own. An empty table gives an empty
    result.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    names = [c for c in docs.columns if c not in added and c != text_col]
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"), docs[id_col].cast("long").alias("id"))
    keyed = keyed.select("row", "text", F.coalesce("id", F.lit(0)).alias("a"), F.xxhash64(F.col("id").isNull(), "text").alias("b"))
    spans = materialise(repeats(keyed.select("a", "b", "text")), "spans")
    joined = keyed.join(spans, ["a", "b"], "left").select("row", "text", "spans")
    fields = T.StructType([joined.schema["row"], *(T.StructField(c, T.LongType()) for c in added[:3]), *(T.StructField(c, T.StringType()) for c in added[3:])])
    return joined.mapInArrow(_cut(text_out), fields).select(*[F.col("row").getField(c).alias(c) for c in names], *added)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: what all ``documents`` keep."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return remove_repeats(docs, text_out=False).drop("kept_text")
