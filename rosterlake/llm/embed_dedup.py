"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

Each of ``tables`` hash tables rotates a vector by three rounds of random signs
and a fast Hadamard transform, ``k`` times, and takes the nearest signed axis of
each rotation; the axes together name the bucket. A vector is stored in its home
bucket and in the ``probes`` next best ones. Vectors that meet in a bucket where
one of them is at home are compared exactly, in double precision.

Vectors are scaled by their largest component first, so that no component is too
large or too small to be squared. They travel as bytes of double precision.

Equal vectors are one class with a multiplicity. A bucket with more than
``BLOCK`` classes is cut into blocks, and pairs of blocks are dealt to different
tasks. Tasks return a row per class, never pairs: the number of links, counted
in the first table in which a pair meets, and the smallest class of the part of
its component seen there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import HOT_KEYS, components, counted_join, materialise, only

BLOCK = 2048
CHUNK = 16384
CLOSE = 1e-9
#: Unrelated vectors that a bucket may hold on average, and tables for each number of rotations: longer codes are met less often.
FELLOWS = 64
TABLES = {1: 8, 2: 8, 3: 10, 4: 16, 5: 24, 6: 40}


def rotations(n: int, d: int) -> int:
    """Rotations per table for ``n`` vectors of length ``d``: as many as keep a bucket's unrelated vectors at FELLOWS on average."""
    full, k = 1 << max(1, (d - 1).bit_length()), 2
    while (2 * full) ** k * FELLOWS < n and k < max(TABLES) and (2 * full) ** (k + 1) < 1 << 46:
        k += 1
    return k


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int, k: int, probes: int, seed: int) -> np.ndarray:
    """Bucket codes, shape (rows, tables, 1 + probes); the first is the home bucket.

    The probes of a table are the cheapest changes of one of its axes, by the
    loss in absolute coordinate.
    """
    n, d = x.shape
    full = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, full - d)))
    rng = np.random.default_rng(seed)
    deep = min(1 + probes, full)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        axes, heights = [], []
        for _ in range(k):
            y = x
            for sign in rng.choice([-1.0, 1.0], (3, full)):
                y = hadamard(y * sign)
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :deep]
            top = np.take_along_axis(y, best, 1)
            axes.append(best * 2 + (top > 0))
            heights.append(np.abs(top))
        place = [(2 * full) ** (k - 1 - i) for i in range(k)]
        home = sum(a[:, 0] * p for a, p in zip(axes, place))
        cost = np.concatenate([h[:, :1] - h[:, 1:] for h in heights], axis=1)
        other = np.concatenate([home[:, None] + (a[:, 1:] - a[:, :1]) * p for a, p in zip(axes, place)], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = home
        out[:, t, 1:] = np.take_along_axis(other, order, 1)[:, :probes] if order.shape[1] == probes else home[:, None]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """The rows, none of them zero, at length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) for each length of vector; vectors are bytes or lists of numbers."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_binary(col.type):
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] // 8
        flat = np.frombuffer(col.buffers()[2], np.float64) if col.buffers()[2] is not None else np.empty(0)
    else:
        offsets = np.asarray(col.offsets)
        flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[offsets[rows][:, None] + np.arange(d)]))
    return out


def _place(d: int, k: int) -> np.int64:
    """The number of buckets of a table for vectors of length ``d``."""
    return np.int64((2 << max(1, (d - 1).bit_length())) ** k)


def _bucketed(tables: int, k: int, probes: int, seed: int, whole: bool):
    """Rows (key, home, rep, copies, vec) of all places of a vector, or the keys alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                for rows, x in _vectors(some.column("vec")):
                    x = unit(x)
                    d = x.shape[1]
                    c = codes(x, tables, k, probes, seed)
                    key = c + ((np.int64(d) * tables + np.arange(tables))[None, :, None]) * _place(d, k)
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(key.ravel())], names=["key"])
                        continue
                    each = tables * (1 + probes)
                    taken = np.repeat(rows, each)
                    home = np.zeros(c.shape, dtype=bool)
                    home[:, :, 0] = True
                    body = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * 8 * d).tobytes()), pa.py_buffer(x.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.ravel()),
                            pa.array(home.ravel()),
                            pa.array(some.column("rep").to_numpy()[taken]),
                            pa.array(some.column("copies").to_numpy()[taken]),
                            body.take(pa.array(np.repeat(np.arange(len(x)), each))),
                        ],
                        names=["key", "home", "rep", "copies", "vec"],
                    )

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The smallest start value of each component of the graph on 0..n-1 with edges (a, b)."""
    label = start.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _met(x: np.ndarray, home: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a bucket's rows with enough cosine, one of them at home; between the two blocks if there are two.

    Products of whole matrices may round a pair differently from bucket to
    bucket; pairs near the threshold are summed once more, alone and in one order.
    """
    near = x @ x.T >= threshold - CLOSE
    near &= home[:, None] | home[None, :]
    if side.any():
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    keep = np.ones(len(i), dtype=bool)
    for s in range(0, len(i), CHUNK):
        keep[s : s + CHUNK] = (x[i[s : s + CHUNK]] * x[j[s : s + CHUNK]]).sum(axis=1) >= threshold
    return i[keep], j[keep]


def _compared(threshold: float, tables: int, k: int, probes: int, seed: int):
    def chunk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        home, side, key = t["home"].to_numpy(), t["side"].to_numpy(), t["key"].to_numpy()
        run = np.flatnonzero(np.diff(key, prepend=key[0] - 1) | np.diff(t["lo"].to_numpy(), prepend=-1) | np.diff(t["hi"].to_numpy(), prepend=-1))
        ends = np.append(run[1:], len(key))
        for rows, x in _vectors(t["vec"]):
            at = np.full(len(key), -1)
            at[rows] = np.arange(len(rows))
            left, right, table, bucket = [], [], [], []
            place = _place(x.shape[1], k)
            for s, e in zip(run, ends):
                if e - s > 1 and at[s] >= 0 and home[s:e].any():
                    i, j = _met(x[at[s] : at[e - 1] + 1], home[s:e], side[s:e], threshold)
                    if len(i):
                        left.append(i + s)
                        right.append(j + s)
                        table.append(np.full(len(i), (key[s] // place) % tables))
                        bucket.append(np.full(len(i), key[s] % place))
            if not left:
                continue
            left, right, table, bucket = (np.concatenate(v) for v in (left, right, table, bucket))
            keep = rep[left] != rep[right]
            left, right, table, bucket = left[keep], right[keep], table[keep], bucket[keep]
            ids, back = np.unique(rep[np.concatenate([left, right])], return_inverse=True)
            if not len(ids):
                continue
            a, b = back[: len(left)], back[len(left) :]
            some = np.empty(len(ids), dtype=np.int64)
            some[back] = at[np.concatenate([left, right])]
            c = codes(x[some], tables, k, probes, seed)
            first = np.ones(len(a), dtype=bool)  # in its first table, and there in the smaller of the two homes
            for u in range(tables):
                at_b, at_a = (c[a, u] == c[b, u, :1]).any(1), (c[b, u] == c[a, u, :1]).any(1)
                first &= ~((at_a | at_b) & (table > u))
                lower = np.minimum(np.where(at_b, c[b, u, 0], place), np.where(at_a, c[a, u, 0], place))
                first &= (table != u) | (bucket == lower)
            links = np.zeros(len(ids), dtype=np.int64)
            pair = np.unique(np.stack([a[first], b[first]], 1), axis=0) if first.any() else np.empty((0, 2), dtype=int)
            weight = np.zeros(len(ids), dtype=np.int64)
            weight[back] = copies[np.concatenate([left, right])]
            np.add.at(links, pair[:, 0], weight[pair[:, 1]])
            np.add.at(links, pair[:, 1], weight[pair[:, 0]])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(_labels(len(ids), a, b, ids))], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                t = pa.Table.from_batches(kept).combine_chunks()
                ids = [t[c].to_numpy() for c in ("key", "lo", "hi")]
                cut = int(np.flatnonzero(np.any([v != v[-1] for v in ids], axis=0))[-1]) + 1 if any((v != v[-1]).any() for v in ids) else 0
                if cut:
                    yield from chunk(t.slice(0, cut).combine_chunks())
                    kept, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if size:
            yield from chunk(pa.Table.from_batches(kept).combine_chunks())

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    tables: int | None = None,
    probes: int = 3,
    seed: int = 1234,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows found with cosine of at least
    ``threshold``, equal vectors included; ``component_id`` is the smallest id
    reachable by links. The number of rotations per table follows the number of
    vectors and their length, so that a bucket holds some dozens of unrelated
    vectors at most; the number of tables follows the rotations, so that at least
    98 of 100 pairs at the threshold meet.

    Null or zero vectors, vectors with null or non-finite components and rows
    without an id link with nothing; a row without an id gets a null component
    and is kept = false. Vectors of different lengths never link. Repeated rows
    count as rows of their own. An empty table gives an empty result; further
    columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    classes = materialise(
        rows.where("ok").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    n, d = classes.agg(F.count("*"), F.min(F.size("vec"))).first()
    k = rotations(n, d or 1)
    tables = tables or TABLES[k]
    placed = classes.mapInArrow(_bucketed(tables, k, probes, seed, True), "key long, home boolean, rep long, copies long, vec binary")
    sizes = classes.select("vec").mapInArrow(_bucketed(tables, k, probes, seed, False), "key long").groupBy("key").count()
    hot = sizes.where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    hot = materialise(hot, "hot")
    small = hot.count() <= HOT_KEYS
    placed = placed.join(F.broadcast(hot) if small else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), (F.col("own") > F.col("with")).alias("side"), "home", "rep", "copies", "vec"
    )
    # within a block, a row stands once; in a pair of blocks, `side` tells the two apart
    found = (
        dealt.repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
        .mapInArrow(_compared(threshold, tables, k, probes, seed), "rep long, links long, root long")
    )
    found = materialise(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.join(links, "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vec", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    good = counted_join(rows.where("ok").select("vec_id", "vec"), materialise(per_class, "per_class"), ["vec"], "copies").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    bad = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.unionByName(bad)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: near-duplicate links of all rows of ``embeddings``."""
    return near_duplicates(only(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
