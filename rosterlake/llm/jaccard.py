"""Links between texts whose sets of word shingles have a Jaccard similarity of at least ``LEAST``.

Each distinct text gets ``BANDS`` * ``ROWS`` min-hashes; texts that agree in all
hashes of one band are candidates. A pair of similarity s is one with chance
1 - (1 - s^ROWS)^BANDS, 0.99995 at 0.8. Candidates are compared by their exact
sets: first every text with the smallest of its bucket, then, in buckets that
these links leave in several components, all texts of different components. Such
buckets are cut into blocks whose pairs are dealt to different tasks, which
return links to smallest fellows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import simhash
from rosterlake.llm.common import components, counted_join, materialise

LEAST = 0.8
BANDS = 25
ROWS = 5
BLOCK = 256
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """One number per band from the min-hashes of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, (found[at : at + 4096, None] * _FACTORS).min(axis=0))
    data = low.tobytes()
    return np.array([xxhash.xxh64_intdigest(data[i : i + 8 * ROWS], i) for i in range(0, len(data), 8 * ROWS)], np.uint64).view(np.int64)


def _node(found: np.ndarray, fp: int) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), fp & 0xFFFFFFFF)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _read(shingle: int):
    """Rows (id, text) to (doc_id, fp, node, bands); ``bands`` is empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                fps, nodes, keys = [], [], []
                for text in some.column("text").to_pylist():
                    h = simhash.hashes(text, shingle)
                    fp = simhash.of_hashes(h)
                    found = np.unique(h)
                    fps.append(fp)
                    nodes.append(_node(found, fp))
                    keys.append(bands(found) if len(found) else [])
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(_signed(fps)), pa.array(_signed(nodes)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "node", "bands"]
                )

    return run


def _sets(shingle: int):
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.unique(simhash.hashes(t, shingle)).tobytes())

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _similarity():
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)])

    return run


def _compare(least: float):
    """For one pair of blocks of a bucket: links between texts of different components, at most one per text and component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        size = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(size) - size
        node, comp = pdf["node"].to_numpy(), pdf["comp"].to_numpy().copy()
        out = []
        mark = np.zeros(ids.max() + 1, np.int64)
        for i in range(len(sets) - 1):
            if (comp[i + 1 :] == comp[i]).all():
                continue
            own = ids[begin[i] : begin[i] + size[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids], begin)
            mark[own] = 0
            near = np.flatnonzero((both >= least * (size + size[i] - both)) & (comp != comp[i]))
            for j in near:
                if comp[j] != comp[i]:
                    out.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def read(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, node, bands) of every row (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", "text").mapInArrow(_read(shingle), f"doc_id {kind}, fp long, node long, bands array<long>"), "shingles")


def links(docs: DataFrame, rows: DataFrame, shingle: int, least: float = LEAST) -> DataFrame:
    """Links ``(a, b)`` of fingerprints that join the same texts as all candidates of similarity ``least`` or more.

    ``docs`` has doc_id and text, ``rows`` is what ``read`` made of it.
    """
    nodes = materialise(rows.where("size(bands) > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.min("doc_id").alias("doc_id")), "texts")
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    crowd = dealt.groupBy("bucket").agg(
        F.min("node").alias("lead"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    ).where("n > 1")
    # buckets of the same texts are one
    crowd = materialise(crowd.groupBy("lead", "n", "members").agg(F.min("bucket").alias("bucket")), "buckets")
    placed = materialise(counted_join(dealt, crowd.select("bucket", "lead", "n"), ["bucket"], "n"), "candidates")
    needed = placed.select("node").distinct().join(nodes.select("node", "fp", "doc_id"), "node")
    text = docs.select("doc_id", "text").join(needed, "doc_id")
    own = text.select("node", "fp", _sets(shingle)("text").alias("set"), "doc_id").dropDuplicates(["node"])
    own = materialise(own.select("node", "fp", "set"), "sets")
    pairs = placed.where("node <> lead").select("node", "lead").distinct()
    one = own.select("node", F.col("set").alias("s"))
    two = own.select(F.col("node").alias("lead"), F.col("set").alias("t"))
    star = pairs.join(one, "node").join(two, "lead").where(_similarity()("s", "t") >= least).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    star = materialise(star, "stars")
    labelled = placed.join(components(star), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("comp"))
    labelled = materialise(labelled, "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.first("n").alias("members")).where("x <> y").select("bucket", "members")
    left = counted_join(labelled, materialise(open_, "open"), ["bucket"], "members").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "comp")
    more = left.join(own.select("node", "set"), "node").groupBy("bucket", "lo", "hi").applyInPandas(_compare(least), "a long, b long")
    all_ = star.unionByName(more)
    fp = own.select("node", "fp")
    named = all_.join(fp.withColumnsRenamed({"node": "a", "fp": "x"}), "a").join(fp.withColumnsRenamed({"node": "b", "fp": "y"}), "b")
    return named.select(F.col("x").alias("a"), F.col("y").alias("b"))
