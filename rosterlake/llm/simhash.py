"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Of two fingerprints that differ in 3 bits at most,
one 32-bit half differs in 1 bit at most. On each half the anchors are the words
of a covering code: the perfect Hamming code of length 31, beside one free bit.
Every half lies within ``RADIUS`` = 1 of its home anchor, so a half at distance
1 lies within ``RADIUS`` + 1 = 2 of it. Each fingerprint is replicated to all
anchors within 2 of either half, 1 or 16 a half, and compared with the
fingerprints that have their home there.

Equal fingerprints are one node. Anchors that are home to more than ``BLOCK``
fingerprints are cut into blocks whose pairs are dealt to different tasks; such
a task returns each fingerprint's smallest fellow, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import HOT_KEYS, components, counted_join, materialise, only

SEED = 42
BITS = 3
BLOCK = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: For each byte value, its eight bits from the least significant on.
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned integer.

    Upper-case ASCII letters are lowered; words are runs of bytes other than
    ASCII white space. Shorter texts give one shingle of all their words, texts
    without words give 0.
    """
    return of_hashes(hashes(text, shingle))


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each word shingle of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    grams = zip(*[words[i:] for i in range(shingle)])
    return np.fromiter((digest(g, SEED) for g in map(b" ".join, grams)), dtype=np.uint64, count=len(words) - shingle + 1)


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    return _majority(h) if len(h) > 1 else int(h.sum())


def _majority(h: np.ndarray) -> int:
    """The bits set in more than half of the hashes; byte by byte through a count of byte values."""
    n = len(h)
    if n < 512:
        votes = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        parts = h.view(np.uint8).reshape(n, 8)
        votes = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS_OF for i in range(8)])
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(shingle: int):
    """Pandas UDF: text -> fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64), index=texts.index)

    return run


# the code ----------------------------------------------------------------------------


def syndrome(half: np.ndarray) -> np.ndarray:
    """Syndrome of bits 0..30 in the Hamming code whose parity check at bit i is i + 1."""
    s = np.zeros(half.shape, dtype=np.int64)
    for i in range(31):
        s ^= np.where((half >> i) & 1, i + 1, 0)
    return s


#: For each syndrome, the flips of bits that lead to all anchors within distance 2; the home anchor first.
_FLIPS = [
    [(1 << (s - 1)) if s else 0] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if s and i < (i ^ s) and (i ^ s) < 32]
    for s in range(32)
]
_WIDTH = max(map(len, _FLIPS))
_TABLE = np.array([f + [-1] * (_WIDTH - len(f)) for f in _FLIPS], dtype=np.int64)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, is home) of all replicas of the fingerprints (signed longs).

    A key holds the half (bit 33), the free bit (bit 31) and the anchor's 31 bits.
    A word of distance 0 from its home anchor has none other within 2; next to
    the free bit's other value, the home anchor itself lies at distance 1.
    """
    rows, keys, homes = [], [], []
    n = len(fp)
    for half in (0, 1):
        word = (fp >> (32 * half)) & 0xFFFFFFFF
        low, free = word & 0x7FFFFFFF, word >> 31
        flips = _TABLE[syndrome(low)]
        there = flips >= 0
        row = np.broadcast_to(np.arange(n)[:, None], flips.shape)[there]
        anchor = (low[:, None] ^ np.where(there, flips, 0))[there]
        home = np.broadcast_to(np.arange(_WIDTH) == 0, flips.shape)[there]
        key = (np.int64(half) << 33) | (free[row] << 31) | anchor
        rows += [row, np.arange(n)]
        keys += [key, key[home] ^ (1 << 31)]  # the free bit may be the differing one
        homes += [home, np.zeros(n, dtype=bool)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy()
            row, key, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(home)], names=["key", "fp", "home"])


def _block_links(bits: int):
    """For one pair of blocks of an anchor: each fingerprint with the smallest one of its part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy())
        label = fp.copy()
        parts = [(i, np.nonzero(np.bitwise_count((fp[i : i + 256, None] ^ fp[None, :]).view(np.uint64)) <= bits)) for i in range(0, len(fp), 256)]
        a = np.concatenate([x + i for i, (x, _) in parts])
        b = np.concatenate([y for _, (_, y) in parts])
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            if (new == label).all():
                break
            label = new
        far = label != fp
        return pd.DataFrame({"a": fp[far], "b": label[far]})

    return run


def linked(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``(a, b)`` of distinct fingerprints (column ``fp``, signed long) that join the same fingerprints as all pairs of at most ``bits`` differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the covering handles 0 to 3 differing bits")
    placed = materialise(fps.select("fp").mapInArrow(_replicas, "key long, fp long, home boolean"), "replicas")
    homes = placed.where("home").select("key", F.col("fp").alias("at"))
    hot = materialise(homes.groupBy("key").count().where(F.col("count") > BLOCK), "hot")
    few = hot.count() <= HOT_KEYS
    hot_keys = F.broadcast(hot) if few else hot
    cool = homes.join(hot_keys, "key", "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("at"))) <= bits
    pairs = placed.join(cool, "key").where((F.col("fp") != F.col("at")) & near).select(F.col("fp").alias("a"), F.col("at").alias("b"))
    sizes = hot.select("key").join(placed, "key").groupBy("key").count()
    cut = sizes.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = placed.join(F.broadcast(cut) if few else cut, "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    dense = dealt.groupBy("key", "lo", "hi").applyInPandas(_block_links(bits), "a long, b long")
    return pairs.unionByName(dense)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = BITS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``bits``
    differing bits, the document's own included. Null and empty texts have
    fingerprint zero and link like any others. Ties and repeated rows are kept
    as rows; rows without an id take part but never give the component its name.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprints(shingle)(F.col(text_col)).alias("fp"))
    return grouped(materialise(rows, "fingerprints"), bits)


def grouped(rows: DataFrame, bits: int = BITS, more: DataFrame | None = None) -> DataFrame:
    """What ``near_duplicates`` returns, from rows (doc_id, fp); ``more`` has further links (a, b) of fingerprints."""
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    close = linked(nodes, bits)
    comp = components(close if more is None else close.unionByName(more))
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named, "named")
    first = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    by_fp = materialise(counted_join(named.select("fp", "component", "n"), materialise(first, "first"), ["component"], "size").select("fp", "n", "component_id"), "by_fp")
    back = counted_join(rows.select("doc_id", "fp"), by_fp, ["fp"], "n")  # any number of texts may share a fingerprint
    return back.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: near-duplicate components of all ``documents`` on 3-word shingles."""
    return near_duplicates(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
