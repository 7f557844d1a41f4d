"""Hard negatives by exact integer scores from residues.

Components become integers. A score is an inner product of such vectors, up to
2^61, and is found without rounding from products of float32 matrices: the
components are reduced modulo several small primes, chosen so that a sum of
products of residues stays below 2^24, each prime has a matrix product of its
own, and the signed score is put together from the residues in balanced mixed
radix (Chinese remainders). How many primes are used follows from the lengths of
the vectors at hand.

Anchors are the stated query set. They are sent to the tasks in blocks of at
most ``BLOCK_BYTES``; for each block the rows are read once in place, without an
exchange, and a task returns a few rows per anchor: its best positives in the
first pass, its best negatives inside each positive's window in the second. The
partial lists are merged by windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.common import materialise, only

#: Bytes of the anchors' components, as doubles, that one block broadcasts.
BLOCK_BYTES = 32 << 20
#: Anchors and rows whose scores are held at once.
TALL, WIDE = 512, 8192
NONE = np.int64(-(1 << 62))
#: Scores below this may be paired with a row number in one long.
SMALL = 2.0**46
#: Squared lengths of integer vectors from which on scores may not fit a long.
MOST = 2.0**61


def primes_for(d: int, bound: float) -> tuple[int, list[int]]:
    """Columns that a product may sum over, and primes whose product exceeds twice ``bound``."""
    width = max(1, min(d, 4096))
    while True:
        top = 2 * math.isqrt((1 << 24) // width) + 1
        found, product = [], 1
        for p in range(top, 2, -1):
            if product > 2 * bound + 1:
                return width, found
            if all(p % f for f in range(2, math.isqrt(p) + 1)):
                found.append(p)
                product *= p
        if product > 2 * bound + 1:
            return width, found
        width = max(1, width // 4)


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues of integers held as doubles, exact at any size."""
    r = np.fmod(x, p)
    return (r - p * np.rint(r / p)).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, integers held as doubles, as exact longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = math.sqrt(float((a * a).sum(1).max()) * float((b * b).sum(1).max())) * (1 + 1e-9) + 1
    width, primes = primes_for(a.shape[1], bound)
    value, modulus = np.zeros((len(a), len(b)), dtype=np.int64), 1
    for p in primes:
        x, y = _residues(a, p), _residues(b, p)
        part = np.zeros_like(value)
        for c in range(0, a.shape[1], width):
            part += (x[:, c : c + width] @ y[:, c : c + width].T).astype(np.int32)
        digit = (part - value) % p
        if modulus > 1:
            digit = digit * pow(modulus, -1, p) % p
        digit[digit > p // 2] -= p
        value += digit * modulus
        modulus *= p
    return value


def scaled_share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``score`` * ``percent`` / 100, rounded down or up, without overflow."""
    score = -score if up else score
    out = score // 100 * percent + score % 100 * percent // 100
    return -out if up else out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ``k`` largest scores and their columns, the smaller column first among equals."""
    n, m = scores.shape
    k = min(k, m)
    if np.abs(scores[scores != NONE]).max(initial=0) < SMALL:
        bits = max(1, (m - 1).bit_length())
        keys = np.where(scores == NONE, np.int64(-(1 << 46)), scores) * (1 << bits) + (m - 1 - np.arange(m))
        keys = -np.sort(-np.partition(keys, m - k, axis=1)[:, m - k :], axis=1) if k < m else -np.sort(-keys, axis=1)
        at = m - 1 - (keys & ((1 << bits) - 1))
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, at, 1), at


def merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of best scores as one of the first's length, by score, then id."""
    k = scores.shape[-1]
    scores, ids = np.concatenate([scores, more], -1), np.concatenate([ids, more_ids], -1)
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def windowed(scores: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` scores from ``high`` downwards, none under ``low``, for each row and each of its windows.

    ``ids`` ascend; scores of NONE are no candidates.
    """
    out, out_ids = np.full((*low.shape, k), NONE), np.zeros((*low.shape, k), dtype=np.int64)
    usable = (scores != NONE) & (scores >= low.min(1, keepdims=True)) & (scores <= high.max(1, keepdims=True))
    i, j = np.nonzero(usable)
    if not len(i):
        return out, out_ids
    s = scores[i, j]
    kinds, rank = np.unique(s, return_inverse=True)
    order = np.lexsort((j, -rank, i))
    i, j, s, rank = i[order], j[order], s[order], rank[order]
    far = len(kinds) + 1
    keys = i * far - rank  # ascends: within a row, larger scores come first
    first = np.searchsorted(keys, np.arange(len(low))[:, None] * far - (np.searchsorted(kinds, high, "right") - 1))
    for t in range(k):
        at = first + t
        good = at < len(s)
        at = np.minimum(at, len(s) - 1)
        good &= (i[at] == np.arange(len(low))[:, None]) & (s[at] >= low) & (s[at] <= high)
        out[..., t][good], out_ids[..., t][good] = s[at][good], ids[j[at]][good]
    return out, out_ids


def matrices(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector."""
    offsets = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    return [(rows, flat[offsets[rows][:, None] + np.arange(d)]) for d in np.unique(sizes) for rows in [np.flatnonzero(sizes == d)]]


def _groups(n: int, norms: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Row numbers in pieces; the few very long vectors are kept apart, since others need fewer primes."""
    large = norms >= math.sqrt(SMALL)
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        for s in range(0, len(rows), step):
            yield rows[s : s + step]


def _read(batches: Iterator[pa.RecordBatch]):
    """(uid, id, label, matrix) of the rows of a batch that have one length, ids ascending."""
    for batch in batches:
        uid, ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "id", "label"))
        for rows, x in matrices(batch.column("vec")):
            order = np.lexsort((uid[rows], ids[rows]))
            yield uid[rows][order], ids[rows][order], label[rows][order], x[order]


def _positives(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        state = {d: (np.full((len(a["uid"]), k), NONE), np.zeros((len(a["uid"]), k), dtype=np.int64)) for d, a in anchors.items()}
        for uid, ids, label, x in _read(batches):
            if x.shape[1] not in anchors:
                continue
            a, (top, top_ids) = anchors[x.shape[1]], state[x.shape[1]]
            for kind in np.intersect1d(label, a["label"]):
                own, rows = np.flatnonzero(a["label"] == kind), np.flatnonzero(label == kind)
                for t in _groups(len(own), np.linalg.norm(a["vec"][own], axis=1), TALL):
                    t = own[t]
                    for r in _groups(len(rows), np.linalg.norm(x[rows], axis=1), WIDE):
                        r = rows[r]
                        scores = exact_scores(a["vec"][t], x[r])
                        scores[a["uid"][t][:, None] == uid[r][None, :]] = NONE
                        more, at = best(scores, k)
                        top[t], top_ids[t] = merged(top[t], top_ids[t], more, ids[r][at])
        for d, (top, top_ids) in state.items():
            i, j = np.nonzero(top != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[d]["uid"][i]), pa.array(top[i, j]), pa.array(top_ids[i, j])], names=["anchor", "score", "id"])

    return run


def _negatives(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        state = {d: (np.full((*a["low"].shape, k), NONE), np.zeros((*a["low"].shape, k), dtype=np.int64)) for d, a in anchors.items()}
        for _, ids, label, x in _read(batches):
            if x.shape[1] not in anchors:
                continue
            a, (top, top_ids) = anchors[x.shape[1]], state[x.shape[1]]
            for t in _groups(len(a["uid"]), np.linalg.norm(a["vec"], axis=1), TALL):
                for r in _groups(len(x), np.linalg.norm(x, axis=1), WIDE):
                    scores = exact_scores(a["vec"][t], x[r])
                    scores[a["label"][t][:, None] == label[r][None, :]] = NONE
                    more, more_ids = windowed(scores, ids[r], a["low"][t], a["high"][t], k)
                    top[t], top_ids[t] = merged(top[t], top_ids[t], more, more_ids)
        for d, (top, top_ids) in state.items():
            i, w, j = np.nonzero(top != NONE)
            names = ["anchor", "place", "score", "id"]
            yield pa.RecordBatch.from_arrays([pa.array(anchors[d]["uid"][i]), pa.array((w + 1).astype(np.int32)), pa.array(top[i, w, j]), pa.array(top_ids[i, w, j])], names=names)

    return run


def _block(anchors: DataFrame, windows: DataFrame | None = None, percent: tuple[int, int] = (0, 0), k: int = 0) -> dict:
    """A bounded block of anchors by length of vector, with the windows of their positives."""
    table = anchors.select("uid", "label", "vec").toArrow().combine_chunks()
    out = {}
    uid, label = table["uid"].to_numpy(), table["label"].to_numpy()
    for rows, x in matrices(table["vec"].combine_chunks()) if len(uid) else []:
        out[x.shape[1]] = {"uid": uid[rows], "label": label[rows], "vec": x}
    if windows is not None:
        t = windows.select("anchor", "place", "positive_score").toArrow()
        owner, place, score = (t[c].to_numpy() for c in ("anchor", "place", "positive_score"))
        for a in out.values():
            order = np.argsort(a["uid"])
            at = order[np.minimum(np.searchsorted(a["uid"][order], owner), len(order) - 1)]
            mine = a["uid"][at] == owner
            a["low"], a["high"] = np.ones((len(order), k), dtype=np.int64), np.zeros((len(order), k), dtype=np.int64)
            a["low"][at[mine], place[mine] - 1] = scaled_share(score[mine], percent[0], True)
            a["high"][at[mine], place[mine] - 1] = scaled_share(score[mine], percent[1], False)
    return out


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_col: str = "anchor",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels.

    A component x becomes floor(scale * x); the score of two rows is their
    integer inner product. An anchor, a row whose ``anchor_col`` is true, has as
    positives the ``positives`` other rows of its label with the highest scores,
    and for each of them as negatives the first ``negatives`` rows of other labels
    whose score lies between ``low`` and ``high`` per cent of the positive's.
    Higher scores come first, then smaller ids.

    Rows without id, label or vector, and rows with a null or non-finite
    component, take no part; nor do rows whose squared length after scaling
    reaches 2^61, as their scores need not fit a long. Vectors of different
    lengths have no score. Repeated rows are rows of their own: they may be each
    other's positives, and a repeated anchor has its result twice. Other columns
    are ignored; an empty table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(F.col(anchor_col), F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vec")
    )
    size = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)) & (size < MOST)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    # integers are held as doubles, as floor() of Spark gives longs
    whole = F.transform("vec", lambda x: F.floor(x * scale).cast("double"))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "anchor", whole.alias("vec")), "members")
    anchors = rows.where("anchor")
    n, d = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks = max(1, -(-n * max(d, 1) * 8 // BLOCK_BYTES))
    mine = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    kind = "anchor long, score long, id long"
    first, last = [], []
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(_block(anchors.where(mine("uid") == b)))
        found = rows.select("uid", "id", "label", "vec").mapInArrow(_positives(sent, positives), kind)
        order = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
        first.append(materialise(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives"))
        sent.unpersist()
        windows = first[-1].select("anchor", "place", F.col("score").alias("positive_score"))
        sent = spark.sparkContext.broadcast(_block(anchors.where(mine("uid") == b), windows, (low, high), positives))
        found = rows.select("uid", "id", "label", "vec").mapInArrow(_negatives(sent, negatives), "anchor long, place int, score long, id long")
        order = W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
        last.append(materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives"))
        sent.unpersist()
    chosen = reduce(DataFrame.unionByName, first).select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = reduce(DataFrame.unionByName, last).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return out.join(chosen, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: hard negatives of every fiftieth of the ``embeddings``, some of which have another row's label."""
    rows = only(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor")))


SQL = """
WITH members AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda t: t[1] * t[2])), 0) AS BIGINT) AS score
  FROM members a JOIN members r ON r.vec_id <> a.vec_id AND len(r.v) = len(a.v)
  WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS n
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE n <= 3
"""
