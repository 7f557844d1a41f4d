"""Periodic runs of words, found on a Re-Pair grammar.

A task reads documents until they have ``BLOCK`` words and turns those into one
grammar. Pairs of neighbouring symbols that occur at least twice are replaced by
a new nonterminal, the more frequent pair first where two of them overlap, until
no pair occurs twice; pairs never reach over the end of a document. What is left
of each document is closed by a balanced tree. A run lies in the text of a
lowest node of the derivation, whose boundary it crosses. So it is enough to look
for runs that cross the boundary between the two halves of a nonterminal, once
for each nonterminal however often it is used, and to carry them to all places
where the nonterminal is derived. Pieces of one run that several nodes saw are
merged there.

A run that crosses a boundary and has three periods or more holds a square that
begins at, ends at or is centred on the boundary. Squares are found by hashes of
prefixes, and what they grow to is compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import only, text_or_empty

#: Words of the documents that share a grammar; one longer document has its own.
BLOCK = 1 << 20
#: Pairs of a node and a period that are looked at together.
CHUNK = 1 << 21
LEAST, TIMES = 24, 3
LOW = np.int64(0xFFFFFFFF)


class Grammar:
    """Nonterminals ``base``, ``base`` + 1, ...: their halves, lengths and first places in the text."""

    def __init__(self, base: int):
        self.base = base
        self.left = self.right = self.size = self.first = np.empty(0, dtype=np.int64)
        self.cuts = [0]

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        big = symbols >= self.base
        out[big] = self.size[symbols[big] - self.base]
        return out

    def add(self, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
        new = self.base + len(self.left) + np.arange(len(left))
        size = self.lengths(left) + self.lengths(right)
        self.left, self.right = np.concatenate([self.left, left]), np.concatenate([self.right, right])
        self.size, self.first = np.concatenate([self.size, size]), np.concatenate([self.first, first])
        self.cuts.append(len(self.left))
        return new


def re_pair(words: np.ndarray, base: int) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar of ``words`` (numbers below ``base``; -1 ends a document), the root of each document and its place.

    A round replaces every occurrence of a repeated pair that is more frequent
    than the pairs it overlaps with; equally frequent pairs are ordered by a
    mixed number. The most frequent pair is always among them.
    """
    g, seq, at = Grammar(base), words.astype(np.int64), np.arange(len(words))
    live = np.zeros(len(seq), dtype=bool)  # whether the pair that begins here may occur twice
    live[:-1] = (seq[:-1] >= 0) & (seq[1:] >= 0)
    known, names = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    last = False
    while True:
        i = np.flatnonzero(live)
        code = (seq[i] << 32) | seq[i + 1] if len(i) else i
        same = np.flatnonzero((np.diff(i) == 1) & (np.diff(code) == 0)) + 1
        if len(same):  # of a a a a, every other pair counts
            inside = np.zeros(len(i), dtype=bool)
            inside[same] = True
            start = np.maximum.accumulate(np.where(inside, 0, np.arange(len(i))))
            even = (np.arange(len(i)) - start) % 2 == 0
            i, code = i[even], code[even]
        kinds, back, counts = np.unique(code, return_inverse=True, return_counts=True)
        found = np.searchsorted(known, kinds)
        old = np.zeros(len(kinds), dtype=bool)
        if len(known):
            old = known[np.minimum(found, len(known) - 1)] == kinds
        twice = (counts > 1) | old
        live[i[~twice[back]]] = False
        if not twice.any():
            if last:
                break
            last = True  # a name used again may have made a pair that was single before: all pairs once more
            live[:-1] = (seq[:-1] >= 0) & (seq[1:] >= 0)
            continue
        last = False
        bits = max(1, int(len(kinds) - 1).bit_length())
        mixed = (np.arange(len(kinds)) * 0x9E3779B1) & ((1 << bits) - 1)
        weight = np.where(twice, (counts << bits) | mixed, 0)
        heavy = np.zeros(len(seq) + 1, dtype=np.int64)
        heavy[i] = weight[back]
        chosen = (heavy[i] > heavy[i - 1]) & (heavy[i] > heavy[i + 1])
        chosen &= (old | (np.bincount(back[chosen], minlength=len(kinds)) > 1))[back]
        i, back = i[chosen], back[chosen]
        used = np.zeros(len(kinds), dtype=bool)
        used[back] = True
        first = np.zeros(len(kinds), dtype=np.int64)
        first[back[::-1]] = at[i[::-1]]
        name = np.zeros(len(kinds), dtype=np.int64)
        name[old] = names[found[old]]
        new = used & ~old
        if new.any():
            name[new] = g.add(kinds[new] >> 32, kinds[new] & LOW, first[new])
            known, names = np.concatenate([known, kinds[new]]), np.concatenate([names, name[new]])
            order = np.argsort(known, kind="stable")
            known, names = known[order], names[order]
        seq[i] = name[back]
        keep = np.ones(len(seq), dtype=bool)
        keep[i + 1] = False
        place = np.cumsum(keep)[i] - 1
        seq, at, live = seq[keep], at[keep], live[keep]
        live[place] = seq[place + 1] >= 0  # the last symbol ends a document
        before = place[place > 0] - 1
        live[before] = seq[before] >= 0
    doc = np.cumsum(seq < 0)[seq >= 0]
    at, seq = at[seq >= 0], seq[seq >= 0]
    while len(doc) and (doc[1:] == doc[:-1]).any():
        head = np.flatnonzero(np.diff(doc, prepend=-1))
        nth = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
        i = np.flatnonzero((nth[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
        seq[i] = g.add(seq[i], seq[i + 1], at[i])
        keep = np.ones(len(seq), dtype=bool)
        keep[i + 1] = False
        seq, at, doc = seq[keep], at[keep], doc[keep]
    return g, seq, at


class _Hashes:
    """Hashes of all stretches of a text; equal stretches have equal hashes."""

    def __init__(self, words: np.ndarray):
        values = (words.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15)
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(32)
        self.power = np.full(len(words) + 1, 0xD6E8FEB86659FD93, dtype=np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * self.power[:-1])])

    def again(self, start: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``start`` stand ``q`` words later once more."""
        s = self.sums
        return (s[start + n] - s[start]) * self.power[q] == s[start + q + n] - s[start + q]


def _longest(most: np.ndarray, holds) -> np.ndarray:
    """The largest t from 0 to ``most`` for which ``holds(t)``, elementwise; smaller ones hold then, too."""
    low, high = np.zeros(len(most), dtype=np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        good = holds(mid)
        low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
    return low


def _plain(words: np.ndarray, lo: int, hi: int, m: int, q: int) -> list[tuple[int, int]]:
    """Runs of period ``q`` across ``m`` within lo..hi, by comparing all words."""
    equal = np.concatenate([[False], words[lo : hi - q] == words[lo + q : hi], [False]])
    edges = np.flatnonzero(np.diff(equal.astype(np.int8)))
    spans = [(int(s) + lo, int(e) + lo + q) for s, e in zip(edges[::2], edges[1::2])]
    return [(s, e) for s, e in spans if s < m < e and e - s >= max(LEAST, TIMES * q)]


def crossing(words: np.ndarray, g: Grammar) -> np.ndarray:
    """Rows (nonterminal, start, end, smallest period) of the runs across the boundaries, places as in the first derivation.

    Runs are maximal within the text of their nonterminal.
    """
    hashes = _Hashes(words)
    nodes = np.flatnonzero(g.size >= LEAST)
    lo, hi = g.first[nodes], g.first[nodes] + g.size[nodes]
    mid = lo + g.lengths(g.left[nodes])
    ends = np.cumsum(g.size[nodes] // TIMES)
    found = []
    start = 0
    while start < len(nodes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        n = g.size[nodes[start:stop]] // TIMES
        k = np.repeat(np.arange(start, stop), n)
        q = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + 1
        m, a, b = mid[k], lo[k], hi[k]
        start = stop
        here, before = words[m], words[m - 1]
        squares = []
        for x, fits, word in ((m, m + 2 * q <= b, here), (m - q, (m - q >= a) & (m + q <= b), here), (m - 2 * q, m - 2 * q >= a, before)):
            i = np.flatnonzero(fits)
            last = i if word is here else None
            y = x[i] if word is here else m[i] - 1 - q[i]
            i = i[words[y] == (words[y + q[i]] if last is not None else word[i])]
            i = i[hashes.again(x[i], q[i], q[i])]
            squares.append((k[i], q[i], x[i]))
        k, q, x = (np.concatenate(v) for v in zip(*squares))
        if not len(k):
            continue
        right = _longest(hi[k] - x - 2 * q, lambda t: hashes.again(x + q, t, q))
        left = _longest(x - lo[k], lambda t: hashes.again(x - t, t, q))
        s, e = x - left, x + 2 * q + right
        good = (e - s >= np.maximum(LEAST, TIMES * q)) & (s < mid[k]) & (e > mid[k])
        rows = np.unique(np.stack([k[good], s[good], e[good], q[good]], 1), axis=0)
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)  # multiples of the smallest period
        for k1, s1, e1, q1 in rows[first].tolist():
            if np.array_equal(words[s1 : e1 - q1], words[s1 + q1 : e1]):
                found.append((nodes[k1], s1, e1, q1))
            else:  # hashes of different words were equal
                for p in range(1, int(hi[k1] - lo[k1]) // TIMES + 1):
                    found += [(nodes[k1], s2, e2, p) for s2, e2 in _plain(words, int(lo[k1]), int(hi[k1]), int(mid[k1]), p)]
    if not found:
        return np.empty((0, 4), dtype=np.int64)
    rows = np.unique(np.array(found, dtype=np.int64), axis=0)
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[first]


def _derived(g: Grammar, roots: np.ndarray, at: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Rows (period, start, end) of the runs at all places where their nonterminals are derived."""
    own = np.bincount(runs[:, 0], minlength=len(g.left))
    heads = np.cumsum(own) - own
    has = own > 0
    for a, b in zip(g.cuts, g.cuts[1:]):  # halves come from earlier rounds
        for half in (g.left, g.right):
            big = np.flatnonzero(half[a:b] >= g.base) + a
            has[big] |= has[half[big] - g.base]
    out = []
    while True:
        keep = roots >= g.base
        roots, at = roots[keep] - g.base, at[keep]
        keep = has[roots]
        roots, at = roots[keep], at[keep]
        if not len(roots):
            break
        n = own[roots]
        i = np.repeat(heads[roots], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shift = np.repeat(at - g.first[roots], n)
        out.append(np.stack([runs[i, 3], runs[i, 1] + shift, runs[i, 2] + shift], 1))
        at = np.concatenate([at, at + g.lengths(g.left[roots])])
        roots = np.concatenate([g.left[roots], g.right[roots]])
    return np.concatenate(out) if out else np.empty((0, 3), dtype=np.int64)


def word_runs(words: np.ndarray, base: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``words``, by start and period; -1 ends a document, also the last."""
    g, roots, at = re_pair(words, base)
    rows = _derived(g, roots, at, crossing(words, g))
    if not len(rows):
        return rows
    q, s, e = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 0]))].T
    far = np.int64(len(words) + 1)
    rank = np.cumsum(np.diff(q, prepend=q[0]) > 0)
    reach = np.maximum.accumulate(e + rank * far) - rank * far
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (s[1:] > reach[:-1] - q[1:])  # stretches of one period overlap by a period or belong to different runs
    head = np.flatnonzero(new)
    rows = np.stack([s[head], np.maximum.reduceat(e, head), q[head]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(text_out: bool):
    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        parts, starts, n = [], [], 0
        for words in texts:
            starts.append(n)
            if len(words) >= LEAST:
                parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words] + [-1], dtype=np.int64))
                n += len(words) + 1
        rows, drop = np.empty((0, 3), dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        if n:
            rows = word_runs(np.concatenate(parts), len(numbers))
            np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
            np.add.at(drop, rows[:, 1], -1)
        keep = np.cumsum(drop) == 0
        cuts = np.searchsorted(rows[:, 0], np.append(starts, n + 1))
        runs, digests, rest, rest_text = [], [], [], []
        for d, words in enumerate(texts):
            own = [] if len(words) < LEAST else rows[cuts[d] : cuts[d + 1]] - [starts[d], starts[d], 0]
            own = [(s, e - s, q) for s, e, q in own.tolist()] if len(own) else []
            runs.append([{"start": s, "length": e, "period": q} for s, e, q in own])
            digests.append(hashlib.sha256("".join(f"{s},{e},{q}\n" for s, e, q in own).encode()).hexdigest())
            left = b" ".join(compress(words, keep[starts[d] : starts[d] + len(words)].tolist()) if own else words)
            rest.append(hashlib.sha256(left).hexdigest())
            rest_text.append(left.decode() if text_out else None)
        sizes = pa.array([len(w) for w in texts], pa.int64())
        columns = [pa.array(ids, pa.int64()), sizes, pa.array(runs, RUNS), pa.array(digests), pa.array(rest), pa.array(rest_text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "runs_sha256", "collapsed_sha256", "collapsed_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                words = text.as_py().split()  # at space, tab, line feed, vertical tab, form feed, return
                if size and size + len(words) > BLOCK:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc.as_py())
                texts.append(words)
                size += len(words) + 1
        if ids:
            yield block(ids, texts)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_out: bool = True) -> DataFrame:
    """One row per document: its runs of words and what is left of it without their repeats.

    Words are separated by the ASCII white space characters. A run is a stretch
    with smallest period q, of 24 words and three periods at least, that no
    neighbouring word extends at that period; ``runs`` has the first word, the
    length and the period of each, by first word, then period. ``collapsed_text``
    has the words that lie in no run or in the first period of every run that
    holds them, joined by single spaces; it is null if ``text_out`` is false.
    ``runs_sha256`` and ``collapsed_sha256`` are digests of ``start,length,period``
    lines and of the collapsed text.

    A null text counts as empty; texts of fewer than 24 words have no runs. Ids
    may be null or repeated; every row gives a row, and no document affects the
    runs of another. Other columns are ignored; an empty table gives an empty
    result. A document is looked at as a whole by one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string, collapsed_text string"
    return rows.mapInArrow(_found(text_out), kind)


def longest(runs: Column) -> Column:
    """Of the runs the one with the greatest length / period; the first, then the one of smaller period among equals."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """Of one document in ten, told by the checksum of its id, the words from a place on repeat a period of their own."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int"))))

    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(periodic(w), " ")).otherwise(""))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(made, F.lit(0))).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the runs of all ``documents``, one in ten of them made periodic from some word on."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), text_or_empty("text")).alias("text")), text_out=False)
    best = longest(F.col("runs"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs_sha256", "collapsed_sha256")
    exponent = F.expr("best.length * 1000L div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
