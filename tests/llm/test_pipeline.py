"""The stages of the pipeline on a small table, each against what its predecessor kept."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from rosterlake.llm import jaccard
from tests.llm.test_llm import DOCS, corpus, cut


@pytest.fixture(scope="module")
def start(spark):
    rows = corpus(200, 9)
    return spark.createDataFrame([*rows, (None, "no id but words of a text", None, None, 5), rows[3]], DOCS)


def test_stages(spark, start):
    docs, kept = start, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        kept.append([tuple(r) for r in docs.collect()])
    language, simhash, suffixed, mixed = kept
    letters = [r for r in start.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert len(language) >= 0.95 * len(letters) and {r[0] for r in language} <= {r.doc_id for r in letters}
    assert all(r[2] is not None for r in language)
    assert set(simhash) <= set(language)
    texts = Counter(r[1] for r in simhash)
    assert set(texts) <= {r[1] for r in language} and max(texts.values()) == 1
    want = dict(zip([r[0] for r in simhash], cut([r[1] for r in simhash])))
    got = {r[0]: r for r in suffixed}
    assert got.keys() == want.keys()
    assert all(len(got[i][1].encode()) <= want[i][0] - want[i][1] <= len(got[i][1].encode()) + 6 for i in want)
    assert set(mixed) <= set(suffixed)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    whole = last.groupby(["doc_id"], dropna=False)["length"].sum().sum()
    assert whole == last.drop_duplicates(["doc_id", "start", "doc_tokens", "sequence_id", "offset"])["length"].sum() and last["length"].min() > 0


@pytest.mark.parametrize("block", [256, 3])
def test_near_copies_are_found(spark, monkeypatch, block):
    """Copies with a five-word similarity of 0.8 to 0.95 go, the first of each group stays; texts at 0.7 stay."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts, gone, stay = [], set(), set()

    def put(words, into):
        into.add(len(texts))
        texts.append(" ".join(words))

    for _ in range(25):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 300)]
        put(words, stay)
        for changes, into in ((2, gone), (4, gone), (6, gone), (11, stay)):  # each changes five shingles of 296
            other = list(words)
            for at in range(10, 10 + 20 * changes, 20):
                other[at] = f"x{rng.integers(1 << 30)}"
            put(other, into)
    # a chain: each near the one before, none near the first but the second
    words = [f"w{x}" for x in rng.integers(0, 1 << 30, 300)]
    put(words, stay)
    for step in range(1, 6):
        words = words[20:] + [f"c{x}" for x in rng.integers(0, 1 << 30, 20)]
        put(words, gone)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == stay


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
