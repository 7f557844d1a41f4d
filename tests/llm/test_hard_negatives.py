"""Hard negatives against whole numbers of any size."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The result by comparing everything with everything, in Python's integers."""
    members = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        ints = [math.floor(256 * float(np.float32(v))) for v in x]
        if sum((abs(256 * float(np.float32(v))) + 1) ** 2 for v in x) < 2.0**61:
            members.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, ints))
    out = []
    for a, (anchor, kind, x) in enumerate(members):
        if anchor % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, own == kind) for b, (i, own, y) in enumerate(members) if b != a and len(y) == len(x)]
        for p, i, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(anchor, i, n, j, -p, -s) for n, (s, j, _) in enumerate(fits[:3], 1)]
    return sorted(out)


def mined(spark, rows, folder):
    df = spark.createDataFrame(rows, KIND)
    for c in ("uid", "id", "anchor", "place", "vec", "score"):
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    got = hn.query(spark, str(folder))
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, d, seed, scale=0.3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * scale + 0.2).astype(np.float32)
    return [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("block", [hn.BLOCK_BYTES, 200])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK_BYTES", block)
    rows = vectors(260, 9, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1050, [nan] * 9, 1), (1051, [inf] + [0.1] * 8, 1), (1052, [None] + [0.1] * 8, 1), (1100, rows[3][1], None), (None, rows[4][1], 2)]
    rows += [(1150, [0.0] * 9, 3), (1151, [0.0] * 9, 3), (1200, [0.5, 0.5], 3), (1201, [0.5, 0.4], 3), (1202, [0.4, 0.4], 1), (1250, [], 1), (1251, [], 1), (1252, [], 2)]
    rows += [(1300, [1e30] * 9, 1), (1350, [-1.9e6] * 9, 1), (1353, [-1.8e6] * 9, 1), (1352, [-1e6] * 9, 2)]
    rows += [rows[50], rows[50], rows[7], rows[8]] + [(2000 + i, rows[100][1], i % 3) for i in range(12)]
    want = plain(rows)
    assert mined(spark, rows, tmp_path) == want
    assert {1150, 1200, 1250, 1350} <= {r[0] for r in want} and len(want) > 50


def test_sql_gives_the_same(spark, tmp_path):
    rows = vectors(300, 16, 2)
    got = mined(spark, rows, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(hn.SQL).fetchall()) == got == plain(rows)


def test_no_rows(spark, tmp_path):
    assert mined(spark, [], tmp_path / "none") == []
    assert mined(spark, [(1, [0.5], 1)], tmp_path / "no-anchor") == []


@pytest.mark.parametrize(("d", "top"), [(1, 2**30), (64, 300), (70, 2**20), (5000, 2**23)])
def test_scores_are_exact(d, top):
    rng = np.random.default_rng(d)
    a, b = (rng.integers(-top, top + 1, (n, d)) for n in (7, 11))
    a[0], b[0], b[1] = top, top, -top
    want = [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
    assert hn.exact_scores(a.astype(float), b.astype(float)).tolist() == want


def test_shares_round_towards_the_window():
    s = np.array([0, 1, 99, 100, 101, -1, -99, -101, 2**60 + 1, -(2**60) - 1])
    assert hn.scaled_share(s, 95, False).tolist() == [x * 95 // 100 for x in s.tolist()]
    assert hn.scaled_share(s, 50, True).tolist() == [-(-x * 50 // 100) for x in s.tolist()]
