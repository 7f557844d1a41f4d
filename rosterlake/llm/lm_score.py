"""Language-model scores from a weighted backoff automaton.

The model reads a text as its tokens' bytes, a space after each token and a line
feed as the end. Byte n-grams up to ``ORDER`` are counted over all training
texts, and all of them are kept. They are smoothed by absolute discounting; the
mass left goes to the other symbols in proportion to their chances after the
next shorter context, down to equal chances for bytes never seen. Every
context's chances sum to 1.

Contexts are states, n-grams are arcs with log-probabilities, and each state has
a failure arc to its longest proper suffix whose weight is the mass left to
shorter contexts. Above them stands one state with an arc for every token of the
training texts: a token's chance is ``WHOLE`` times its discounted share of all
tokens, and the rest of the mass is spelt by the bytes' automaton.

The automaton is dealt over parts by the last ``CORE`` symbols of its states, so
all failure arcs down to states of that length stay inside a part; a part holds
its own n-grams only, and parts become more as the texts grow. Shorter n-grams,
of which there are 256 to the power of ``CORE`` at most, are one small table
that every part has. A byte's chance depends on its n-gram of ``ORDER`` bytes
alone: each block of documents asks the parts for its distinct n-grams once and
reads its texts with the answers. ``Automaton`` is the same model in one piece.

Token counts for the base score travel by blocks of documents: each block asks
for the counts of its distinct tokens once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.common import materialise, only

ORDER = 6
CORE = 3
PARTS = 32
PART_BYTES = 32 << 20
DISCOUNT = 0.75
WHOLE = 0.3
BLOCK_BYTES = 8 << 20
PORTION = 1 << 20
LANE = 256
CHUNK = 1 << 18
END = 10
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

BLOCKS = "block long, ids array<long>, sizes array<int>, body binary"


# counting ----------------------------------------------------------------------------


def ngrams(stream: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a stream that begins with END, and their counts.

    One n-gram per position from 1 on: the symbol with ``order`` - 1 symbols
    before it, or fewer where a text began since. A key holds the length in the
    top byte and the bytes below, the last one lowest.
    """
    keys, counts = [], []
    for at in range(1, len(stream), CHUNK):
        key, n = _ngrams(stream[max(0, at - order + 1) : at + CHUNK], order, min(at, order - 1))
        keys.append(key)
        counts.append(n)
    if len(keys) < 2:
        return (keys[0], counts[0]) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def _ngrams(stream: np.ndarray, order: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams that end at position ``first`` or later, and their counts."""
    return np.unique(_keys(stream, order, first), return_counts=True)


def _keys(stream: np.ndarray, order: int, first: int) -> np.ndarray:
    """The n-gram of each position from ``first`` on."""
    n = len(stream)
    x = stream.astype(np.int64)
    at = np.arange(n)
    begun = np.maximum.accumulate(np.where(stream == END, at, -1))
    length = np.minimum(order, at[1:] - begun[:-1] + 1)
    key = np.zeros(n - 1, np.int64)
    for back in range(order - 1, -1, -1):
        inside = length > back
        value = np.zeros(n - 1, np.int64)
        value[max(back - 1, 0) :] = x[max(1 - back, 0) : n - back]
        key = (key << 8) | np.where(inside, value, 0)
    return (key | (length << 56))[first - 1 :]


def encoded(stream: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a stream in no order, and the number of its n-gram among them for each position from 1 on."""
    parts = [_keys(stream[max(0, at - order + 1) : at + CHUNK], order, min(at, order - 1)) for at in range(1, len(stream), CHUNK)]
    found = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def stream_of(texts: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n" + b"".join(texts), dtype=np.uint8)


# the automaton -----------------------------------------------------------------------


class Automaton:
    """States, arcs and failure arcs as arrays.

    ``bitmap`` and ``base`` say for a state and a byte whether there is an arc,
    and which: four 64-bit words per state, and the number of arcs before each.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, discount: float = DISCOUNT):
        self.order = order
        length = keys >> 56
        body = keys & ((np.int64(1) << 56) - 1)
        ctx_len = length - 1
        ctx = (body >> 8) | (ctx_len << 56)
        sym = body & 255
        states = np.unique(ctx)  # the empty context has key 0 and comes first
        if not len(states) or states[0] != 0:
            states = np.concatenate([[0], states]).astype(np.int64)
        where = np.searchsorted(states, ctx)
        size = np.zeros(len(states))
        size[0] = counts[length == 1].sum() if len(counts) else 0
        spot = np.searchsorted(keys, states[1:])
        size[1:] = counts[spot]
        gain = (counts - discount) / size[where]
        left = 1.0 - np.bincount(where, weights=gain, minlength=len(states))
        if size[0] == 0:
            left[0] = 1.0
        # an n-gram has its discounted share; the mass left is spread over the other symbols as after the shorter context
        chance = gain.copy()
        taken = np.zeros(len(states))
        for j in range(2, order + 1):
            at = np.flatnonzero(length == j)
            short = (body[at] & ((np.int64(1) << (8 * (j - 1))) - 1)) | (np.int64(j - 1) << 56)
            taken += np.bincount(where[at], weights=chance[np.searchsorted(keys, short)], minlength=len(states))
        loss = np.maximum(left, 1e-12) / np.maximum(1.0 - taken, 1e-12)
        # the empty context has an arc for every byte
        known = sym[length == 1]
        rest = np.setdiff1d(np.arange(256), known)
        where = np.concatenate([where, np.zeros(len(rest), np.int64)])
        sym = np.concatenate([sym, rest])
        chance = np.concatenate([chance, np.full(len(rest), max(left[0], 1e-12) / max(len(rest), 1))])
        target = np.concatenate([body, rest])
        span = np.concatenate([length, np.ones(len(rest), np.int64)])
        by = np.lexsort((sym, where))
        where, sym, target, span = where[by], sym[by], target[by], span[by]
        self.weight = np.log10(chance[by])
        self.next = self._longest(states, target, np.where(sym == END, 1, span)).astype(np.int32)
        self.fail = self._longest(states, states & ((np.int64(1) << 56) - 1), (states >> 56) - 1).astype(np.int32)
        self.loss = np.log10(loss)
        self.bitmap = np.zeros(4 * len(states), np.uint64)
        slot = 4 * where + (sym >> 6)
        np.bitwise_or.at(self.bitmap, slot, np.uint64(1) << (sym & 63).astype(np.uint64))
        self.base = (np.cumsum(np.bitwise_count(self.bitmap)) - np.bitwise_count(self.bitmap)).astype(np.int32)
        self.start = int(self._longest(states, np.array([END]), np.array([1]))[0])

    def _longest(self, states: np.ndarray, body: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Number of the longest suffix, of at most ``span`` and order - 1 symbols, that is a state."""
        out = np.zeros(len(body), np.int64)
        for j in range(1, self.order):
            key = (body & ((np.int64(1) << (8 * j)) - 1)) | (np.int64(j) << 56)
            at = np.minimum(np.searchsorted(states, key), len(states) - 1)
            out = np.where((states[at] == key) & (span >= j), at, out)
        return out

    def positions(self, stream: np.ndarray) -> np.ndarray:
        """log10 of the chance of each symbol of a stream from 1 on; symbol 0 is END."""
        run_up = self.order - 1
        parts = []
        for at in range(1, len(stream), CHUNK):
            before = min(at, run_up)
            parts.append(self._positions(stream[at - before : at + CHUNK], before))
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def _positions(self, stream: np.ndarray, before: int) -> np.ndarray:
        n = len(stream) - before
        lanes = -(-n // LANE)
        steps = -(-n // lanes)
        run_up = self.order - 1
        padded = np.full(run_up + lanes * steps, END, np.uint8)
        padded[run_up - before : run_up + n] = stream
        cells = np.lib.stride_tricks.as_strided(padded, (lanes, run_up + steps), (steps, 1)).T.copy()
        out = np.empty((steps, lanes), np.float32)
        state = np.zeros(lanes, np.int32)
        one = np.uint64(1)
        below = (one << np.arange(64, dtype=np.uint64)) - one
        word, bit = (cells >> 6).astype(np.int32), (cells & 63).astype(np.uint64)
        for t in range(run_up + steps):
            w, b = word[t], bit[t]
            got = np.zeros(lanes)
            slot = state * 4 + w
            arcs = self.bitmap[slot]
            lost = np.flatnonzero(((arcs >> b) & one) == 0)
            while len(lost):
                at = state[lost]
                got[lost] += self.loss[at]
                at = self.fail[at]
                state[lost] = at
                slot[lost] = s = at * 4 + w[lost]
                arcs[lost] = a = self.bitmap[s]
                lost = lost[((a >> b[lost]) & one) == 0]
            arc = self.base[slot] + np.bitwise_count(arcs & below[b])
            if t >= run_up:
                out[t - run_up] = got + self.weight[arc]
            state = self.next[arc]
        return out.T.ravel()[:n]


# the automaton in parts --------------------------------------------------------------


def _body(keys: np.ndarray, length: int) -> np.ndarray:
    return keys & ((np.int64(1) << (8 * length)) - 1)


def suffixes(keys: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` symbols of each n-gram, as a key."""
    return _body(keys, length) | (np.int64(length) << 56)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights=n, minlength=len(found))


def _spot(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted ``keys`` hold the asked ones, and whether they do."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Level:
    """The n-grams of one length with their chances, and their contexts with the weights of the failure arcs.

    ``below`` is the level of the next shorter n-grams, None for single symbols.
    A context's count is that of its n-grams, as every context is followed by a symbol.
    """

    def __init__(self, length: int, keys: np.ndarray, n: np.ndarray, below: Level | None, discount: float = DISCOUNT):
        self.length, self.keys = length, keys
        self.states, where = np.unique(self._context(keys), return_inverse=True)
        size = np.bincount(where, weights=n, minlength=len(self.states))
        self.chance = (n - discount) / size[where] if len(keys) else np.empty(0)
        left = 1.0 - np.bincount(where, weights=self.chance, minlength=len(self.states))
        if below is None:
            # equal chances for the symbols never seen; the empty context exists without any n-gram
            self.rest = float(np.log10(max(left[0] if len(left) else 1.0, 1e-12) / max(256 - len(keys), 1)))
        else:
            taken = np.bincount(where, weights=below.chance[_spot(below.keys, suffixes(keys, length - 1))[0]] if len(keys) else None, minlength=len(self.states))
            self.loss = np.log10(np.maximum(left, 1e-12) / np.maximum(1.0 - taken, 1e-12))

    def _context(self, keys: np.ndarray) -> np.ndarray:
        return (_body(keys, self.length) >> 8) | (np.int64(self.length - 1) << 56)

    def read(self, asked: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Adds to ``out`` what the ``rows`` of the asked n-grams pay here; returns those that go on to the level below."""
        some = suffixes(asked[rows], self.length)
        at, seen = _spot(self.keys, some)
        out[rows[seen]] += np.log10(self.chance[at[seen]])
        rows, some = rows[~seen], some[~seen]
        if self.length == 1:
            out[rows] += self.rest
            return rows[:0]
        at, known = _spot(self.states, self._context(some))
        out[rows[known]] += self.loss[at[known]]
        return rows


def levels(keys: np.ndarray, n: np.ndarray, first: int, last: int, below: Level | None) -> list[Level]:
    """Levels ``first`` to ``last`` from counts of the longest n-gram at each position."""
    out: list[Level] = []
    for j in range(first, last + 1):
        some = keys >> 56 >= j
        below = Level(j, *summed(suffixes(keys[some], j), n[some]), below)
        out.append(below)
    return out


def log_chances(asked: np.ndarray, n: np.ndarray, low: list[Level], order: int) -> np.ndarray:
    """log10 of the chance of each asked n-gram's last symbol after the others. ``n`` are counts in the training texts, 0 for an n-gram not in them."""
    seen = n > 0
    model = low + levels(asked[seen], n[seen], len(low) + 1, order, low[-1])
    out, open_ = np.zeros(len(asked)), np.empty(0, np.int64)
    for level in reversed(model):
        open_ = level.read(asked, out, np.concatenate([open_, np.flatnonzero(asked >> 56 == level.length)]))
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds an n-gram: a hash of the CORE symbols before its last one."""
    core = (_body(keys, CORE + 1) >> 8).astype(np.uint64)
    return ((core * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct n-grams by part and key, the parts that occur and where each begins."""
    order = np.argsort(keys)
    part = part_of(keys[order], parts)
    again = np.argsort(part, kind="stable")
    names, begin = np.unique(part[again], return_index=True)
    return order[again], names, np.append(begin, len(keys))


def squeeze(x: np.ndarray) -> bytes:
    """Numbers with their bytes sorted by place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def keys_in(row: bytes) -> np.ndarray:
    """Keys that were sent as compressed differences."""
    return np.cumsum(unsqueeze(row, np.int64))


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest n-grams of CORE symbols at most."""
    for batch in batches:
        for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist()):
            keys, n = keys_in(keys), unsqueeze(n, np.uint32)
            keys, n = keys[n > 0], n[n > 0]
            length = np.minimum(keys >> 56, CORE)
            key, n = summed((keys & ((np.int64(1) << (8 * length)) - 1)) | (length << 56), n)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])


def _answered(low, order: int):
    def run(table: pa.Table) -> pa.Table:
        """One part: counts what all blocks sent and answers each with the logarithms in the order of its keys."""
        keys, n = np.empty(0, np.int64), np.empty(0)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for k, c in zip(table["keys"], table["n"]):
            waiting.append((keys_in(k.as_py()), unsqueeze(c.as_py(), np.uint32)))
            if sum(len(x) for x, _ in waiting) > max(len(keys), CHUNK):
                keys, n = summed(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([n, *(x for _, x in waiting)]))
                waiting = []
        keys, n = summed(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([n, *(x for _, x in waiting)]))
        logs = log_chances(keys, n, low.value, order).astype(np.float32)
        out = [squeeze(logs[np.searchsorted(keys, keys_in(k.as_py()))]) for k in table["keys"]]
        return pa.table([table["block"], table["part"], pa.array(out, pa.binary())], names=["block", "part", "logs"])

    return run


# blocks of documents -----------------------------------------------------------------


def is_held_out(doc_id, of: int = 10) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of == 0


def normal(text: str | None) -> bytes:
    """The tokens of a text as the model reads them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return b" ".join(words) + b" \n" if words else b"\n"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=1)
    ids: list = []
    bodies: list[bytes] = []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal ids, bodies, size, part
        out = pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(b) for b in bodies]], pa.list_(pa.int32())), pa.array([press.compress(b"".join(bodies))])],
            names=["block", "ids", "sizes", "body"],
        )
        ids, bodies, size, part = [], [], 0, part + 1
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                ids.append(doc)
                bodies.append(normal(text))
                size += len(bodies[-1])
            if size >= BLOCK_BYTES:
                yield block()
    if ids:
        yield block()


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list[int], bytes]]:
    for row in range(batch.num_rows):
        body = zstandard.ZstdDecompressor().decompress(batch.column("body")[row].as_py())
        yield batch.column("block")[row].as_py(), batch.column("ids")[row].as_py(), batch.column("sizes")[row].as_py(), body


def _portions(ids: list, sizes: list[int], body: bytes) -> Iterator[tuple[list, list[int], bytes]]:
    """A block's texts in portions of about PORTION bytes."""
    first = begin = at = 0
    for k, n in enumerate(sizes):
        at += n
        if at - begin >= PORTION or k == len(sizes) - 1:
            yield ids[first : k + 1], sizes[first : k + 1], body[begin:at]
            first, begin = k + 1, at


def _split(ids: list, sizes: list[int], body: bytes, fold: int) -> tuple[list[bytes], list[bytes]]:
    """Training texts and held-out texts of a block."""
    sets: tuple[list[bytes], list[bytes]] = ([], [])
    at = 0
    for doc, n in zip(ids, sizes):
        sets[is_held_out(doc, fold)].append(body[at : at + n])
        at += n
    return sets


def _asked(fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, body in _opened(batch):
                seen: Counter = Counter()
                for portion in _portions(ids, sizes, body):
                    train, held = _split(*portion, fold)
                    seen.update(b"".join(train).split())
                    for w in set(b"".join(held).split()):
                        seen.setdefault(w, 0)
                h = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), block)), pa.array(h), pa.array(np.fromiter(seen.values(), np.int64, len(h)))], names=["block", "word", "n"]
                )

    return run


def _counted(fold: int, order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *whole in _opened(batch):
                keys, n = np.empty(0, np.int64), np.empty(0)
                for ids, sizes, body in _portions(*whole):
                    key, at = encoded(np.frombuffer(b"\n" + body, np.uint8), order)
                    train = np.repeat([not is_held_out(d, fold) for d in ids], sizes)
                    more = np.bincount(at, weights=train, minlength=len(key))
                    keys, n = summed(np.concatenate([keys, key]), np.concatenate([n, more]))
                by, names, begin = by_part(keys, parts)
                keys, n = keys[by], n[by].astype(np.uint32)
                cut = [slice(a, b) for a, b in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(names), block)),
                        pa.array(names.astype(np.int64)),
                        pa.array([squeeze(np.diff(keys[c], prepend=np.int64(0))) for c in cut], pa.binary()),
                        pa.array([squeeze(n[c]) for c in cut], pa.binary()),
                    ],
                    names=["block", "part", "keys", "n"],
                )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(order: int, parts_: int, ends: int, total: int, distinct: int, fold: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words_ = right.filter(pc.is_null(right["part"]))
        words_ = words_.select(["word", "c"]).sort_by("word")
        known, of_known = words_["word"].to_numpy(), words_["c"].to_numpy()
        logs = {p: x for p, x in zip(right["part"].to_pylist(), right["logs"].to_pylist()) if p is not None}
        bottom = total + 0.1 * (distinct + 1)
        parts = []
        for batch in left.to_batches():
            portions = [portion for _, *block in _opened(batch) for portion in _portions(*block)]
            read = [encoded(np.frombuffer(b"\n" + body, np.uint8), order) for *_, body in portions]
            keys = np.unique(np.concatenate([k for k, _ in read])) if read else np.empty(0, np.int64)
            by, names_, begin = by_part(keys, parts_)
            answer = np.empty(len(keys))
            for p, a, b in zip(names_.tolist(), begin, begin[1:]):
                answer[by[a:b]] = unsqueeze(logs[p], np.float32)
            for (ids, sizes, body), (key, at) in zip(portions, read):
                words = body.split()
                names = {w: i for i, w in enumerate(set(words))}
                h = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names)).view(np.int64)
                spot, there = _spot(known, h)
                c = np.zeros(len(names))
                c[there] = of_known[spot[there]]
                which = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
                ends_at = np.cumsum(sizes)
                stream = np.frombuffer(b"\n" + body, np.uint8)
                spaces = np.concatenate([[0], np.cumsum(stream[1:] == 32)])  # one after each token
                of_doc = spaces[ends_at]
                n_words = np.diff(of_doc, prepend=0)
                log = np.log10((c + 0.1) / bottom)[which] if len(words) else np.empty(0)
                doc = np.repeat(np.arange(len(ids)), n_words)
                base = np.bincount(doc, weights=log, minlength=len(ids)) + np.log10((ends + 0.1) / bottom)
                n_known = np.bincount(doc, weights=(c > 0)[which] if len(words) else None, minlength=len(ids)) + (ends > 0)
                # tokens in the order of the stream: the words of each text, then its end
                closing = np.flatnonzero((stream[1:] == 32) | (stream[1:] == END))
                spelt = np.add.reduceat(answer[np.searchsorted(keys, key)][at], np.concatenate([[0], closing[:-1] + 1]))
                ending = stream[1:][closing] == END
                seen = np.full(len(closing), float(ends))
                seen[~ending] = c[which] if len(words) else []
                held_back = min(1.0, DISCOUNT * distinct / total) if total else 1.0
                whole = WHOLE * np.maximum(seen - DISCOUNT, 0) / max(total, 1)
                rest = 1 - WHOLE + WHOLE * held_back if total else 1.0
                token = np.log10(whole + rest * 10.0**spelt)
                deep = spelt < -290  # too small a number: the byte's part alone, in logarithms
                token[deep] = np.where(whole[deep] > 0, np.log10(np.maximum(whole[deep], 1e-300)), np.log10(rest) + spelt[deep])
                score = np.add.reduceat(token, np.cumsum(n_words + 1) - (n_words + 1))
                parts.append(
                    pa.table(
                        [
                            pa.array(ids, pa.int64()),
                            pa.array([is_held_out(d, fold) for d in ids]),
                            pa.array((n_words + 1).astype(np.int64)),
                            pa.array(n_known.astype(np.int64)),
                            pa.array(np.full(len(ids), total, np.int64)),
                            pa.array(base),
                            pa.array(score),
                        ],
                        names=[x.split()[0] for x in SCORES.split(", ")],
                    )
                )
        return pa.concat_tables(parts) if parts else pa.table({x.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in SCORES.split(", ")})

    return run


def score(docs: DataFrame, fold: int = 10, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base score and the model's log10 probability.

    Documents whose crc32(id as text) mod ``fold`` is 0 are held out; counts,
    chances and states come from all others, whole. Null and empty texts have
    the end as their only token; a null id counts as the empty string. Repeated
    rows are counted and scored as rows. Without training documents every byte
    is equally likely, and the base score of a token is -log10(1). Other columns
    are ignored.
    """
    spark: SparkSession = docs.sparkSession
    blocks = materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(_blocks, BLOCKS), "blocks")
    asked = blocks.mapInArrow(_asked(fold), "block long, word long, n long")
    # a token has one row per block at most, so one pass by token counts it and answers all its blocks
    by_word = W.partitionBy("word")
    counted = asked.select("block", F.sum("n").over(by_word).alias("c"), "word", (F.row_number().over(by_word.orderBy("block")) == 1).alias("first"))
    answers = materialise(counted.where("c > 0"), "answers")
    held = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(PARTS, -(-held // PART_BYTES))
    ngrams_ = materialise(blocks.mapInArrow(_counted(fold, order, parts), "block long, part long, keys binary, n binary"), "ngrams")
    lowest = ngrams_.mapInArrow(_low_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    low = levels(lowest["key"].to_numpy(), lowest["n"].to_numpy(), 1, min(CORE, order), None)
    ends = int(lowest["n"].to_numpy()[(lowest["key"].to_numpy() & 255) == END].sum())
    got = answers.where("first").agg(F.sum("c"), F.count("*")).first()
    total, distinct = (got[0] or 0) + ends, got[1] + (ends > 0)
    answered = ngrams_.groupBy("part").applyInArrow(_answered(spark.sparkContext.broadcast(low), order), "block long, part long, logs binary")
    none = F.lit(None)
    both = answers.select("block", "word", "c", none.cast("long").alias("part"), none.cast("binary").alias("logs")).unionByName(
        answered.select("block", none.cast("long").alias("word"), none.cast("long").alias("c"), "part", "logs")
    )
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_scored(order, parts, ends, total, distinct, fold), SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: scores of all ``documents``."""
    return score(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
