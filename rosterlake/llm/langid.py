"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window; each
filter keeps its highest response, and a softmax layer turns these into
languages. The network is trained in numpy on a bounded sample of labelled
windows and sent to the tasks, which apply it to all windows of every text in
batches. A text's language is the one with the highest mean of the windows'
log-chances, weighted by the windows' lengths.

A filter's response is a sum over its width of one weight per byte value, so a
trained filter is a table over byte pairs: a width-2 filter looks up one pair, a
width-3 filter a pair and a byte, a width-4 filter two pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.common import only

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 1000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_SPACE = regex.compile(rb"\s+")


class Network:
    """Weights: per width a table (width, 256, filters) with biases, then a dense layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def pairs(self) -> list[list[np.ndarray]]:
        """Look-up tables over byte pairs (65536, filters), or single bytes (256, filters), per width."""
        out = []
        for f in self.filters:
            tables = []
            for i in range(0, len(f), 2):
                tables.append((f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, FILTERS) if i + 1 < len(f) else f[i])
            out.append(tables)
        return out

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Highest responses (windows, filters of all widths), and their positions. x: bytes (windows, LENGTH)."""
        tables = tables or self.pairs()
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best, where = [], []
        for w, (parts, bias) in enumerate(zip(tables, self.bias)):
            n = x.shape[1] - WIDTHS[w] + 1
            y = np.zeros((len(x), n, FILTERS), np.float32)
            for i, t in enumerate(parts):
                y += t[(pair if len(t) == 65536 else x)[:, 2 * i : 2 * i + n]]
            at = y.argmax(1)
            best.append(np.take_along_axis(y, at[:, None, :], 1)[:, 0] + bias)
            where.append(at)
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def highest(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """As ``pooled`` without the positions, a few columns at a time."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best = []
        for w, (parts, bias) in enumerate(zip(tables, self.bias)):
            n = x.shape[1] - WIDTHS[w] + 1
            top = np.full((len(x), FILTERS), -np.inf, np.float32)
            for s in range(0, n, 32):
                e = min(n, s + 32)
                y = None
                for i, t in enumerate(parts):
                    part = (t.take((pair if len(t) == 65536 else x)[:, 2 * i + s : 2 * i + e], axis=0))
                    y = part if y is None else np.add(y, part, out=y)
                np.maximum(top, y.max(1), out=top)
            best.append(top + bias)
        return np.concatenate(best, 1)

    def log_chances(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.offset
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, seed: int = 1) -> Network:
        """Adam on the cross-entropy; only each filter's best position gets a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, *self.bias, self.dense, self.offset]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                some = order[s : s + batch]
                xs, n = x[some], len(some)
                pooled, where = self.pooled(xs)
                g = np.exp(self.log_chances(pooled))
                g[np.arange(n), y[some]] -= 1
                g /= n
                grads = [np.zeros_like(p) for p in params]
                grads[-2], grads[-1] = np.maximum(pooled, 0).T @ g, g.sum(0)
                back = (g @ self.dense.T) * (pooled > 0)
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    d, at = back[:, cols], where[:, cols]
                    grads[len(WIDTHS) + k] = d.sum(0)
                    f = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for i in range(w):
                        np.add.at(grads[k], (i, xs[np.arange(n)[:, None], at + i], f), d)
                step += 1
                for p, q, a, b in zip(params, grads, m, v):
                    a += 0.1 * (q - a)
                    b += 0.001 * (q * q - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows of LENGTH bytes, white space squeezed; the last one is shorter."""
    text = _SPACE.sub(b" ", text.strip())
    return [text[i : i + LENGTH] for i in range(0, len(text), LENGTH)]


def rows_of(parts: list[bytes]) -> np.ndarray:
    """Windows as a byte matrix; short ones are filled with spaces."""
    return np.frombuffer(b"".join(p.ljust(LENGTH) for p in parts), np.uint8).reshape(-1, LENGTH)


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, fold: int = 4, held_out: int = 2) -> Network:
    """A network from documents whose crc32(doc_id as text) mod ``fold`` is not ``held_out``.

    Every language found is learned. Of each one some ``per_language`` documents
    with different windows give one window, from a place that a hash names:
    those whose text has a hash below a bound that the number of different texts
    of the language sets, and of these the smallest hashes. Documents without a
    text, a letter or a language teach nothing; a null id counts as the empty
    text; of rows with equal texts one is learned. Without any usable document
    the network knows no language.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    usable = docs.where((F.crc32(key) % fold != held_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - LENGTH // 2, F.lit(1))).cast("int")
    hashed = usable.select("lang", F.xxhash64("text", F.lit(0)).alias("h"), F.substring("text", start + 1, F.lit(LENGTH)).alias("part"))
    found = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row per language, as the network has one output each
    top = sorted(r["lang"] for r in found)
    # rows are thinned out where they are read: a task of the ranking gets little more than it keeps, whatever a language's share of the rows
    bound = {r["lang"]: min(1.0, (1.5 * per_language + 100) / max(r["n"], 1)) for r in found}
    limit = F.create_map(*[F.lit(x) for lang in top for x in (lang, min(2**63 - 1, int((bound[lang] - 0.5) * 2.0**64)))]) if top else None
    picked = hashed.where(F.col("h") <= limit[F.col("lang")]).distinct() if top else hashed
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "part"))
    sample = picked.withColumn("r", rank).where(F.col("r") <= per_language).drop("r").toPandas() if top else None
    languages = top
    net = Network(languages)
    if not languages:
        return net
    sample = sample.sort_values(["lang", "h", "part"])
    parts = [(windows(_folded(t)) or [b""])[0] for t in sample["part"]]
    y = np.searchsorted(languages, sample["lang"].to_numpy().astype(str))
    # short texts too: a copy of every third window, cut to 32 bytes
    short = [p[:32] for p in parts[::3]]
    return net.fit(rows_of(parts + short), np.concatenate([y, y[::3]]))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = model.value
        tables = net.pairs()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = batch.column("text").to_pylist()
                lang: list[str] = [UNKNOWN] * len(texts)
                score = np.zeros(len(texts))
                parts, owner = [], []
                for i, t in enumerate(texts):
                    if t and net.languages and _LETTER.search(t):
                        own = windows(_folded(t))
                        parts += own
                        owner += [i] * len(own)
                if parts:
                    owner = np.array(owner)
                    logs = np.empty((len(parts), len(net.languages)))
                    for s in range(0, len(parts), 256):
                        logs[s : s + 256] = net.log_chances(net.highest(rows_of(parts[s : s + 256]), tables))
                    weight = np.array([len(p) for p in parts], float)
                    total = np.zeros((len(texts), len(net.languages)))
                    np.add.at(total, owner, logs * weight[:, None])
                    some = np.unique(owner)
                    mean = total[some] / np.bincount(owner, weights=weight, minlength=len(texts))[some, None]
                    chance = np.exp(mean - mean.max(1, keepdims=True))
                    chance /= chance.sum(1, keepdims=True)
                    best = chance.argmax(1)
                    score[some] = chance[np.arange(len(some)), best]
                    for i, b in zip(some, best):
                        lang[i] = net.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in batch.schema.names), pa.array(lang), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"]
                )

    return run


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from the column ``text`` alone.

    A text that is null or has no letter, or any text where no language was
    learned, is ``und`` with score 0. Input columns of these two names are
    replaced; an empty table gives an empty result.
    """
    kept = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(net)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_predict(model), f"{fields}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the language of all ``documents``."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    net = train(docs)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.crc32(key) % 4 == 2).alias("held_out"), "text")
    return predict(rows, net).select("doc_id", "held_out", "lang_pred", "score")
