"""Periodic runs of words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_runs(words):
    """All (start, end, period), by trying every period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            span = words[i : j + q]
            if len(span) >= max(24, 3 * q) and not any(span[p:] == span[: len(span) - p] for p in range(1, q)):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng, most):
    words = []
    while len(words) < most:
        unit = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 30))]
        words += (unit * rng.randint(1, 8))[: rng.randint(1, 150)] if rng.random() < 0.5 else unit
    return words


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(200):
        docs = [periodic_words(rng, rng.randint(24, 200)) for _ in range(rng.randint(1, 4))]
        docs += docs[:1] * rng.randint(0, 1)
        text, want = [], []
        for words in docs:
            want += [(s + len(text), e + len(text), q) for s, e, q in plain_runs(words)]
            text += words + [-1]
        assert [tuple(r) for r in runs.word_runs(np.array(text), 60).tolist()] == want


def test_grammar_derives_its_text_and_leaves_no_pair_twice():
    rng = random.Random(3)
    words = periodic_words(rng, 3000) + [-1] + periodic_words(rng, 500) + [-1]
    g, roots, at = runs.re_pair(np.array(words), 60)

    def derived(symbol):
        todo, out = [symbol], []
        while todo:
            x = todo.pop()
            if x < 60:
                out.append(x)
            else:
                todo += [int(g.right[x - 60]), int(g.left[x - 60])]
        return out

    assert at.tolist() == [0, words.index(-1) + 1]
    assert sum((derived(int(r)) + [-1] for r in roots), []) == words
    pairs = list(zip(g.left.tolist(), g.right.tolist()))
    used = set(g.left.tolist()) | set(g.right.tolist())
    assert len(g.left) < len(words) / 2 and len(set(pairs)) == len(pairs) and used


def test_equal_hashes_of_other_words_are_noticed(monkeypatch):
    monkeypatch.setattr(runs._Hashes, "again", lambda self, start, n, q: np.ones(np.broadcast(start, n, q).shape, dtype=bool))
    words = [1, 2, 3] * 9 + [4, 5, 6, 7] + [8] * 30
    got = [tuple(r) for r in runs.word_runs(np.array(words + [-1]), 60).tolist()]
    assert got == plain_runs(words)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    best = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, block):
    rng = random.Random(block)
    texts = [" ".join(f"w{x}" for x in periodic_words(rng, rng.randint(1, 300))) for _ in range(80)]
    texts += [None, "", " \n", "a", "b " * 23, "b\t" * 24, "é \x1c\x85   " * 9, texts[0], "x y\n" * 500 + "z"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 0), (5, texts[5], "en", "s", 0), (5, texts[5], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("runs", "best", "start", "period", "n_words"):
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(runs, "BLOCK", block)
    got = runs.query(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ).collect()
    want = [plain_row(r[0], r[1]) for r in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert any(r[1] > 1 for r in want) and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want) > 5


def test_operator_keeps_texts_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20 + "c")], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert row.collapsed_text == "a b c" and [tuple(r) for r in row.runs] == [(0, 40, 2)] and row.n_words == 41
    assert runs.periodic_runs(docs.limit(0)).count() == 0
