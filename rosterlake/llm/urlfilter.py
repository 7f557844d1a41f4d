"""URL filtering: host and path rules first, a character language-model ratio for the rest.

URLs that a rule accepts or rejects are the labelled ones. One smoothed
variable-order Markov model of characters is counted over the accepted and one
over the rejected URLs. A URL without a rule is judged by the difference of its
two log-likelihoods over its length, against a threshold that splits the
labelled URLs best. For the threshold each labelled URL is scored by models of
the other of two folds.

The models keep all n-grams and are dealt over parts by the contexts' last
symbols, as in ``lm_score``: each block of URLs sends the counts of its n-grams
to the parts and gets the differences of the log-chances back, once per distinct
n-gram. Only n-grams of three bytes at most are one table that every part has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import materialise, only
from rosterlake.llm.lm_score import CHUNK, CORE, PART_BYTES, PARTS, Level, by_part, encoded, keys_in, levels, log_chances, squeeze, summed, unsqueeze

ORDER = 5
BLOCK_BYTES = 4 << 20
BINS = 4000
RANGE = 4.0

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered and path of a URL; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest fitting rule, null without one. Of equally long ones the first in order of text counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _line(url: str | None) -> bytes:
    """A URL as the models read it: the bytes after the scheme, then the end."""
    text = (url or "").split("://", 1)[-1]
    return text.replace("\n", " ").encode("utf-8", "surrogatepass") + b"\n"


#: A block of rows: kind is 2 * (allow: 0, block: 1) + fold for labelled URLs, else -1.
_BLOCKS = "block long, ids array<long>, urls array<string>, kinds array<int>"
#: The sets of kinds that the accepted and the rejected model learn, for URLs of fold 0 and 1 and for all others.
_MODELS = [((1,), (3,)), ((0,), (2,)), ((0, 1), (2, 3))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    kept: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        t = pa.Table.from_batches(kept)
        cols = [pa.array([t[c].to_pylist()], kind) for c, kind in (("page_id", pa.list_(pa.int64())), ("url", pa.list_(pa.string())), ("kind", pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays([pa.array([at]), *cols], names=["block", "ids", "urls", "kinds"])

    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            kept.append(batch.slice(start, 4096))
            size += kept[-1].nbytes
            if size >= BLOCK_BYTES:
                yield block()
                kept, size, at = [], 0, at + 1
    if kept:
        yield block()


def _read(batch: pa.RecordBatch, row: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a block's URLs, the n-gram of each byte, and the URLs' lengths."""
    lines = [_line(u) for u in batch.column("urls")[row].as_py()]
    return *encoded(np.frombuffer(b"\n" + b"".join(lines), np.uint8), order), np.array([len(x) for x in lines])


def _counted(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, at, sizes = _read(batch, row, order)
                kind = np.repeat(np.array(batch.column("kinds")[row].as_py()), sizes)
                n = np.stack([np.bincount(at[kind == k], minlength=len(keys)) for k in range(4)], 1).astype(np.uint32)
                by, names, begin = by_part(keys, parts)
                keys, n = keys[by], n[by]
                cut = [slice(a, b) for a, b in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(names), batch.column("block")[row].as_py())),
                        pa.array(names.astype(np.int64)),
                        pa.array([squeeze(np.diff(keys[c], prepend=np.int64(0))) for c in cut], pa.binary()),
                        pa.array([squeeze(n[c].ravel()) for c in cut], pa.binary()),
                    ],
                    names=["block", "part", "keys", "n"],
                )

    return run


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of the columns of their counts."""
    found, back = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(back, weights=n[:, k], minlength=len(found)) for k in range(4)], 1)


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest n-grams of CORE symbols at most, by kind."""
    for batch in batches:
        for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist()):
            keys, n = keys_in(keys), unsqueeze(n, np.uint32).reshape(-1, 4)
            length = np.minimum(keys >> 56, CORE)
            key, n = _summed((keys & ((np.int64(1) << (8 * length)) - 1)) | (length << 56), n)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(n[:, k].astype(np.int64)) for k in range(4))], names=["key", "n0", "n1", "n2", "n3"])


def low_levels(keys: np.ndarray, n: np.ndarray, order: int) -> list[tuple[list[Level], list[Level]]]:
    """The short n-grams of the accepted and the rejected model for URLs of fold 0, of fold 1 and for all others."""

    def one(kinds: tuple[int, ...]) -> list[Level]:
        c = n[:, list(kinds)].sum(1)
        return levels(*summed(keys[c > 0], c[c > 0]), 1, min(CORE, order), None)

    return [(one(a), one(b)) for a, b in _MODELS]


def gaps(keys: np.ndarray, n: np.ndarray, low: list[tuple[list[Level], list[Level]]], order: int) -> np.ndarray:
    """For each n-gram the log10-chance under the accepted model less that under the rejected one, a column per pair of models."""
    out = [log_chances(keys, n[:, list(a)].sum(1), la, order) - log_chances(keys, n[:, list(b)].sum(1), lb, order) for (a, b), (la, lb) in zip(_MODELS, low)]
    return np.stack(out, 1)


def _answered(low, order: int):
    def run(table: pa.Table) -> pa.Table:
        keys, n = np.empty(0, np.int64), np.empty((0, 4))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            nonlocal keys, n, waiting
            keys, n = _summed(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([n, *(x for _, x in waiting)]))
            waiting = []

        for k, c in zip(table["keys"], table["n"]):
            waiting.append((keys_in(k.as_py()), unsqueeze(c.as_py(), np.uint32).reshape(-1, 4)))
            if sum(len(x) for x, _ in waiting) > max(len(keys), CHUNK):
                add()
        add()
        gap = gaps(keys, n, low.value, order).astype(np.float32)
        out = [squeeze(gap[np.searchsorted(keys, keys_in(k.as_py()))].ravel()) for k in table["keys"]]
        return pa.table([table["block"], table["part"], pa.array(out, pa.binary())], names=["block", "part", "gaps"])

    return run


_SCORED = "page_id long, url string, kind int, tested double, score double"


def _scored(order: int, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right["part"].to_pylist(), right["gaps"].to_pylist()))
        out = []
        for batch in left.to_batches():
            for row in range(batch.num_rows):
                keys, at, sizes = _read(batch, row, order)
                by, names, begin = by_part(keys, parts)
                gap = np.empty((len(keys), 3))
                for p, a, b in zip(names.tolist(), begin, begin[1:]):
                    gap[by[a:b]] = unsqueeze(answers[p], np.float32).reshape(-1, 3)
                mean = np.add.reduceat(gap[at], np.cumsum(sizes) - sizes) / sizes[:, None] if len(sizes) else np.empty((0, 3))
                kind = np.array(batch.column("kinds")[row].as_py(), np.int32)
                own = mean[np.arange(len(kind)), np.where(kind < 0, 2, kind % 2)]
                cols = [batch.column("ids")[row].values, batch.column("urls")[row].values, pa.array(kind), pa.array(own), pa.array(mean[:, 2])]
                out.append(pa.table(cols, names=["page_id", "url", "kind", "tested", "score"]))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in kinds], names=[c.split()[0] for c in _SCORED.split(", ")])

    return run


def threshold(hist: list[tuple[str, int, int]]) -> float:
    """The bin edge with the least sum of both classes' error shares, the middle of equally good ones. hist: (verdict, bin, n)."""
    n = {v: np.zeros(BINS) for v in ("allow", "block")}
    for verdict, b, count in hist:
        n[verdict][b] += count
    if not n["allow"].sum() or not n["block"].sum():
        return 0.0
    lost = np.concatenate([[0], np.cumsum(n["allow"])]) / n["allow"].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(n["block"])]) / n["block"].sum()
    best = np.flatnonzero(np.isclose(lost + passed, (lost + passed).min()))
    return float(best[len(best) // 2] / BINS * 2 * RANGE - RANGE)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and ``score`` and ``threshold`` of the models.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; the longest decides. Other URLs are allowed if their score reaches the
    threshold. Where no URL or only one kind is labelled, the threshold is 0 and
    a model without URLs gives all bytes the same chance. Null ids, null or
    empty URLs and repeated rows stay rows of their own; a URL of any length is
    read whole. Other columns are ignored; an empty table gives an empty result.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    name, verdict = rule_of(*host_and_path(url), rules)
    fold = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), verdict.alias("by_rule"))
    rows = rows.select("page_id", "url", F.when(F.col("by_rule") == "allow", fold).when(F.col("by_rule") == "block", fold + 2).otherwise(-1).alias("kind"))
    blocks = materialise(rows.mapInArrow(_blocks, _BLOCKS), "urls")
    held = blocks.agg(F.sum(F.aggregate("urls", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    parts = max(PARTS, -(-held // PART_BYTES))
    sent = materialise(blocks.mapInArrow(_counted(order, parts), "block long, part long, keys binary, n binary"), "url_ngrams")
    counts = sent.mapInArrow(_low_counts, "key long, n0 long, n1 long, n2 long, n3 long").groupBy("key").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    lowest = counts.toArrow()  # 256 ** CORE rows at most
    low = low_levels(lowest["key"].to_numpy(), np.stack([lowest[f"n{k}"].to_numpy() for k in range(4)], 1), order)
    known = pages.sparkSession.sparkContext.broadcast(low)
    answered = sent.groupBy("part").applyInArrow(_answered(known, order), "block long, part long, gaps binary")
    scored = materialise(blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_scored(order, parts), _SCORED), "scored")
    bins = F.least(F.greatest(F.floor((F.col("tested") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    label = F.when(F.col("kind") < 2, "allow").otherwise("block")
    hist = scored.where("kind >= 0").groupBy(label.alias("verdict"), bins.alias("b")).count()
    at = threshold([tuple(r) for r in hist.collect()])  # at most 2 * BINS rows
    host, path = host_and_path(F.col("url"))
    rule, _ = rule_of(host, path, rules)
    verdict = F.when(F.col("kind") >= 0, label).otherwise(F.when(F.col("score") >= at, "allow").otherwise("block"))
    return scored.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"), "score", F.lit(at).alias("threshold"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the verdict for every URL of ``pages``."""
    return judge(only(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url"))
