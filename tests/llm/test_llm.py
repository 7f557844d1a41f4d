"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rosterlake.llm import embed_dedup, langid, lm_score, mixing, packing, quality, shard, simhash, suffix, urlfilter
from rosterlake.llm.common import components, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n ", "a", "é" * 3, "same text here", "same text here", "\x1c odd <|endoftext|> İ Σ"]


def corpus(n: int = 120, seed: int = 0) -> list[tuple]:
    """Texts of invented words with copies, near copies, edge cases and one long text."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 6))) for _ in range(80)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 160))) + "." for _ in range(n)]
    texts += [texts[0], texts[0], texts[1] + " x", texts[2].replace("a", "b", 1), "long " * 3000 + " ".join(words)]
    texts += [t for t in EDGE]
    return [(i, t, ["en", "de"][i % 2], ["s0", "s1", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows):
    """The documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("h", "g", "a", "key", "fp", "rep", "label", "slot", "score", "spans", "part"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()


def closed(ids, pairs):
    """Smallest id reachable over pairs, for each id."""
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                moved = True
    return label


# shared helpers ----------------------------------------------------------------------


def test_components_and_ranks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 60: 50}
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    out = ranked(df, ["g"], [F.col("id")], 8, "r").toPandas()
    assert all(sorted(x["r"]) == list(range(len(x))) for _, x in out.groupby("g"))


# op1 -----------------------------------------------------------------------------------


def test_embedding_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    vectors = [base[i % 60] + rng.normal(size=24) * 0.12 for i in range(240)]
    vectors += [vectors[0]] * 5 + [2.0 * vectors[1]] + [np.zeros(24), None, np.r_[np.nan, np.ones(23)], np.r_[np.inf, np.ones(23)], vectors[3][:20]]
    ids = [*range(len(vectors) - 1), None]
    data = [(i, None if v is None else [float(x) for x in v], "x") for i, v in zip(ids, vectors)]
    data[10][1][3] = None
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rep string")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    good = {i: np.array(v) for i, v, _ in data if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    links = Counter(x for p in pairs for x in p)
    assert {i: got[i].n_links for i in unit} == {i: links[i] for i in unit} and len(pairs) > 100
    assert {i: got[i].component_id for i in unit} == closed(unit, pairs)
    assert len(got) == len(data)
    for i in (10, 246, 247, 248, 249):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_any_size_link(spark):
    """Vectors whose squares overflow or vanish, beside near twins of usual size."""
    v = [1.0, 2.0, 3.0, -1.0]
    near = [1.01, 2.0, 3.0, -1.0]
    data = [(i, [x * f for x in w]) for i, (w, f) in enumerate([(v, 1.0), (near, 1e200), (v, 1e-200), (near, 5e-324 * 2**60), ([3.0, -2.0, 1.0, 0.0], 1e300)])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4)}


@pytest.mark.parametrize("k", [2, 3, 4])
@pytest.mark.parametrize("d", [64, 128, 384])
def test_recall_at_every_number_of_rotations(d, k):
    """Of random pairs at cosine 0.95, the share that meets in a bucket where one is at home."""
    rng = np.random.default_rng(d + k)
    x = embed_dedup.unit(rng.normal(size=(1500, d)))
    z = rng.normal(size=x.shape)
    z = embed_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * z
    a, b = (embed_dedup.codes(v, embed_dedup.TABLES[k], k, 3, 1234) for v in (x, y))
    met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
    assert met.mean() >= 0.98


def test_crowded_buckets_are_cut(spark, monkeypatch):
    """Many different near copies in one bucket: blocks of pairs find every link once."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=16)
    data = [(i, [float(x) for x in v + rng.normal(size=16) * 0.01]) for i in range(90)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


# op2 -----------------------------------------------------------------------------------


def test_packing_covers_all_tokens(docs, rows, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    size = 256
    out = packing.pack(docs, path, size=size).toPandas()
    tok = Tokenizer.from_file(path)
    for i, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        at = 0
        for p in out[out["doc_id"] == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) // 4
            assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    s = out.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id")["length"].cumsum() - s["length"]) == s["offset"]).all()
    full = out.groupby("sequence_id")["length"].sum()
    assert full.max() <= size and (full < size).sum() <= 1
    assert packing.pack(empty, path).count() == 0


def test_packing_balances_costs():
    rng = np.random.default_rng(0)
    pieces = [packing.Piece(i, n, 0, memoryview(bytes(4 * n))) for i, n in enumerate(rng.integers(1, 60, 300).tolist())]
    sequences, rest = packing.assign(pieces, 128, 1.0, 1 / 128)
    assert all(sum(p.length for p in s) == 128 for s in sequences) and sum(p.length for p in rest) < 128
    cost = [sum(p.length + p.length**2 / 128 for p in s) for s in sequences]
    assert np.std(cost) < 0.15 * np.mean(cost)


# op3 -----------------------------------------------------------------------------------


def plain_model(streams, order):
    """The chance of the last byte of an n-gram after the others, from streams that begin with a line feed."""
    grams: Counter = Counter()
    for y in streams:
        for t in range(1, len(y)):
            for j in range(1, min(order, t + 1) + 1):
                grams[y[t - j + 1 : t + 1]] += 1
    symbols = sum(len(y) - 1 for y in streams)
    after: dict[bytes, list] = {}
    for g in grams:
        after.setdefault(g[:-1], []).append(g)
    memo: dict = {}

    def size(c):
        return symbols if not c else sum(grams[x] for x in after[c])

    def p(g):
        c = g[:-1]
        if g in grams:
            return (grams[g] - 0.75) / size(c)
        if c not in memo:
            own = after.get(c, [])
            left = 1 - sum((grams[x] - 0.75) / size(c) for x in own)
            memo[c] = left / (256 - len(own)) if not c else left / (1 - sum(p(x[1:]) for x in own))
        return memo[c] if not c else memo[c] * p(g[1:])

    return p


def test_scores_equal_a_plain_model(docs, rows, empty, monkeypatch):
    out = {r.doc_id: r for r in lm_score.score(docs).collect()}
    train = [x for i, x, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for x in train for w in [*low(x), None])
    total, kinds = sum(count.values()), len(count)
    order = lm_score.ORDER
    p = plain_model([b"\n" + lm_score.normal(x) for x in train], order)

    for i, x, *_ in rows[:6] + rows[-8:]:
        y, spelt, score = b"\n" + lm_score.normal(x), 0.0, 0.0
        for t in range(1, len(y)):
            spelt += math.log10(p(y[max(0, t - order + 1) : t + 1]))
            if y[t] in (32, 10):
                c = count[None if y[t] == 10 else y[:t].split()[-1]]
                rest = 1 - lm_score.WHOLE + lm_score.WHOLE * min(1, 0.75 * kinds / total)
                score += math.log10(lm_score.WHOLE * max(c - 0.75, 0) / total + rest * 10**spelt)
                spelt = 0.0
        words = [*low(x), None]
        assert out[i].score == pytest.approx(score, abs=1e-3)
        assert out[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words))
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(words), sum(count[w] > 0 for w in words), total)
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert lm_score.score(empty).count() == 0


def test_rare_ngrams_count_in_a_large_corpus(spark):
    """9 MB of training text: a phrase that occurs twice in it still spells a held-out text."""
    ids = [i for i in range(60) if not lm_score.is_held_out(i)][:40]
    held = next(i for i in range(60) if lm_score.is_held_out(i))
    train = [(i, "lorem ipsum dolor " * 12_500) for i in ids] + [(i, "zqxj vkwq") for i in ids[:2]]
    docs = spark.createDataFrame([*train, (held, "zqxjv")], "doc_id long, text string").repartition(3)
    got = lm_score.score(docs).where("held_out").first()
    grams: Counter = Counter()
    for key, n in zip(*lm_score.ngrams(lm_score.stream_of([lm_score.normal(t) for _, t in train]), lm_score.ORDER)):
        for j in range(1, (int(key) >> 56) + 1):
            grams[(int(key) & ((1 << (8 * j)) - 1)) | (j << 56)] += int(n)
    keys = np.array(sorted(grams))
    whole = lm_score.Automaton(keys, np.array([grams[k] for k in keys.tolist()], float), lm_score.ORDER)
    at = whole.positions(np.frombuffer(b"\nzqxjv \n", np.uint8)).astype(float)
    rest = 1 - lm_score.WHOLE + lm_score.WHOLE * 0.75 * 6 / got.train_tokens
    end = lm_score.WHOLE * (42 - 0.75) / got.train_tokens + rest * 10 ** at[-1]
    assert got.score == pytest.approx(math.log10(rest) + at[:-1].sum() + math.log10(end), abs=1e-3)


def test_context_chances_sum_to_one():
    stream = np.frombuffer(b"\nab ac \nab ab \nb \n", np.uint8)
    keys, n = lm_score.ngrams(stream, 3)
    full: Counter = Counter()
    for k, c in zip(keys.tolist(), n.tolist()):
        for j in range(1, (k >> 56) + 1):
            full[(k & ((1 << (8 * j)) - 1)) | (j << 56)] += c
    ks = np.array(sorted(full))
    model = lm_score.Automaton(ks, np.array([full[k] for k in ks.tolist()], float), 3)
    for context in (b"\n", b"\na", b"\nab", b"\nzz"):
        total = sum(10 ** float(model.positions(np.frombuffer(context + bytes([b]), np.uint8))[-1]) for b in range(256))
        assert total == pytest.approx(1, abs=1e-5)


def test_pieces_of_a_stream_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    stream = np.frombuffer(b"\n" + b"".join(bytes(rng.choice(list(b"abc "), rng.integers(0, 30)).tolist()) + b"\n" for _ in range(60)), np.uint8)
    whole = lm_score.ngrams(stream, 4)
    model = lm_score.Automaton(np.array([(1 << 56) | 97]), np.array([5.0]), 4)
    scores = model.positions(stream)
    monkeypatch.setattr(lm_score, "CHUNK", 17)
    assert all((a == b).all() for a, b in zip(whole, lm_score.ngrams(stream, 4)))
    assert np.allclose(scores, model.positions(stream))


# op4 -----------------------------------------------------------------------------------


def test_shards_are_even_and_hold_groups_together(spark, rows, docs, empty):
    extra = [(1000 + i, "hot", "en", "s", 3) for i in range(70)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t, *_ in extra] + [(None, None), (5, "again"), (5, "again")], "doc_id long, text string"))
    out = shard.shard(df, shards=7).toPandas()
    n = df.count()
    assert len(out) == n
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and set(out["law"]) == {"rows"} and out["grown_shard"].isna().all()
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in out.groupby("shard"))
    text = {i: t for i, t, *_ in rows + extra}
    for r in out[out["doc_id"].notna() & (out["doc_id"] != 5)].itertuples():
        b = (text[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 16, zlib.crc32(b))
    hot = out[out["doc_id"] >= 1000]["shard"].nunique()
    assert hot <= math.ceil(70 / (n // 7)) + 1
    assert shard.shard(empty).count() == 0


def test_groups_that_fit_are_not_cut(spark):
    """Groups of 0.6 shards each, as many as there are shards, and small ones beside them: every large one gets a shard of its own, no link is cut."""
    shards = 5
    sizes = [60] * 4 + [15] * 6 + [2] * 20
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"alone {i}" for i in range(100 * shards - len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = shard.shard(df, shards=shards).toPandas()
    out["text"] = [texts[i] for i in out["doc_id"]]
    spread = out[out["text"].str.startswith("group")].groupby("text")["shard"].nunique()
    assert spread.max() == 1
    assert set(out.groupby("shard").size()) == {100}


def plain_grants(wishes, room):
    """Wishes (label, class, bucket, m, g, q) taken in order while they fit, by shard."""
    out = []
    for label, free in room.items():
        at = 0
        for w in sorted((w for w in wishes if w[0] == label), key=lambda w: (-w[1], w[2], -w[3], w[4])):
            at += w[5]
            if at > free:
                break
            out.append((label, w[4]))
    return set(out)


def test_grants_keep_the_quota(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 3)), f"g{i}", int(n), int(n), int(np.log2(n))) for i, n in enumerate(rng.integers(2, 40, 200))]
    wishes = spark.createDataFrame(rows, "label int, g string, q long, m long, class int")
    room = {0: 700, 1: 300, 2: 0}
    bucket = dict(wishes.select("g", F.pmod(F.xxhash64("g", F.lit(5)), F.lit(shard.GRANT_BUCKETS))).collect())
    got = {(r.label, r.g) for r in shard._granted(wishes, spark.createDataFrame(list(room.items()), "label int, room long")).collect()}
    assert got == plain_grants([(lab, c, bucket[g], m, g, q) for lab, g, q, m, c in rows], room)


# op5 -----------------------------------------------------------------------------------


def test_mixing_takes_the_drawn_counts(docs, rows, empty):
    weights = {"s0": 3.0, "s1": 1.0, None: 0.0}
    out = mixing.mix(docs, weights).toPandas()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").encode())
    total = sum(size.values())
    n = Counter(out["doc_id"])
    for i, _, _, s, _ in rows:
        rate = total * weights[s] / 4 / size[s]
        u = int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert n[i] == k
    assert all(sorted(x["copy_no"]) == list(range(len(x))) for _, x in out.groupby("doc_id"))
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(docs, {"s0": -1.0})


def test_tiny_sources_have_large_rates(spark):
    """A source of a few bytes beside large ones is repeated thousands of times, not refused."""
    rows = [(i, "x" * 2_000_000, None, "big", None) for i in range(4)] + [(i, "ab", None, None, None) for i in range(10, 13)]
    n = Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(rows, DOCS)).select("doc_id").collect())
    total, small = 8_000_006, 6
    rate = total * small**0.5 / (small**0.5 + 8_000_000**0.5) / small
    assert rate > 745
    for i in range(10, 13):
        u = int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = 0, math.exp(-rate)
        while c <= u:
            k += 1
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        assert n[i] == k
    for rate in (701.0, 1e7):
        least, cdf = mixing.chances_around_mode(rate)
        chance = np.diff(cdf, prepend=0.0)
        at = least + np.arange(len(cdf))
        assert (chance * at).sum() == pytest.approx(rate, rel=1e-6) and (chance * (at - rate) ** 2).sum() == pytest.approx(rate, rel=1e-4)


# op6 -----------------------------------------------------------------------------------


def test_languages_are_told_apart(spark, empty):
    rng = np.random.default_rng(0)
    parts = {"en": ["the", "ing", "and", "tion", "wh"], "de": ["sch", "ung", "und", "ein", "ß"], "fr": ["eau", "que", "les", "é", "aux"]}
    data = []
    for i in range(600):
        lang = list(parts)[i % 3]
        data.append((i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(40)), lang, "s", 0))
    data += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 34 !!", "en", "s", 0), (1003, "the and " * 50_000, None, "s", 0)]
    df = spark.createDataFrame(data, DOCS)
    net = langid.train(df)
    out = {r.doc_id: r for r in langid.predict(df, net).collect()}
    held = [r for i, *r in data if i < 600 and zlib.crc32(str(i).encode()) % 4 == 2]
    right = [out[i].lang_pred == lang for i, _, lang, *_ in data if i < 600 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean(right) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1000, 1001, 1002))
    assert out[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in out.values())
    blind = langid.predict(df, langid.train(empty))
    assert {r.lang_pred for r in blind.select("lang_pred").distinct().collect()} == {"und"}
    assert langid.predict(empty, net).count() == 0


# op7 -----------------------------------------------------------------------------------


def test_url_ratios_equal_plain_models(spark, monkeypatch):
    """Scores and threshold of labelled and other URLs against models counted in plain Python; blocks do not matter."""
    rng = np.random.default_rng(8)
    part = lambda: "".join(rng.choice(list("abcé-"), rng.integers(1, 9)))
    urls = [f"http://{part()}.com/{part()}" for _ in range(25)] + [f"http://{part()}.net/es/{part()}" for _ in range(25)] + [f"https://{part()}.org/{part()}" for _ in range(20)]
    urls += [None, "", urls[0], urls[-1], "http://x.org/" + "long/" * 20_000]
    df = spark.createDataFrame([(i if i else None, u, 1) for i, u in enumerate(urls)], "page_id long, url string, score int").repartition(3)
    fold = dict(df.select("url", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(2))).collect())
    monkeypatch.setattr(urlfilter, "BLOCK_BYTES", 1)
    got = urlfilter.judge(df).collect()
    assert len(got) == len(urls) and sum(r.page_id is None for r in got) == 1
    line = lambda u: (u or "").split("://")[-1].encode() + b"\n"
    label = lambda u: None if u is None or "://" not in u else "allow" if ".com/" in u else "block" if ".net/es/" in u else None
    models: dict = {}

    def ratio(u, f):
        """By models of the labelled URLs outside fold ``f``; of all where it is None."""
        if f not in models:
            models[f] = [plain_model([b"\n" + line(x) for x in urls if label(x) == v and fold[x] != f], urlfilter.ORDER) for v in ("allow", "block")]
        y = b"\n" + line(u)
        grams = [y[max(0, t - urlfilter.ORDER + 1) : t + 1] for t in range(1, len(y))]
        return sum(math.log10(models[f][0](g)) - math.log10(models[f][1](g)) for g in grams) / len(grams)

    for r in got:
        u = urls[r.page_id or 0]
        assert r.score == pytest.approx(ratio(u, None), abs=1e-4)
        assert r.verdict == (label(u) or ("allow" if r.score >= r.threshold else "block"))
    own = [(label(u), ratio(u, fold[u])) for u in urls if label(u)]

    def loss(at):
        share = lambda v, wrong: np.mean([wrong(s) for w, s in own if w == v])
        return share("allow", lambda s: s < at) + share("block", lambda s: s >= at)

    edges = np.arange(-urlfilter.BINS // 2, urlfilter.BINS // 2) * (2 * urlfilter.RANGE / urlfilter.BINS)
    assert loss(got[0].threshold) == pytest.approx(min(map(loss, edges)), abs=1e-6)


def test_url_rules_and_models(spark):
    urls = [
        (1, "http://A.Com/x?y"), (2, "https://example.com/en/1"), (3, "http://www.example.com/en/#t"), (4, "http://x.net/es/"), (5, "http://x.net/esx"), (6, None),
        (7, "no scheme"), (8, "ftp://com"), (9, "http://notcom/"), (10, "a://b://c/d"),
    ] + [(100 + i, f"http://good{i}.com/page/{i}") for i in range(40)] + [(200 + i, f"http://bad{i}.net/es/spam{i}") for i in range(40)] + [(300, "http://good1.org/page/1"), (301, "http://bad2.org/es/spam1")]
    df = spark.createDataFrame([(i, u, "x") for i, u in urls], "page_id long, url string, host string")
    out = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert len(out) == len(urls)
    want = {1: ("a.com", "/x", "com/"), 2: ("example.com", "/en/1", "example.com/en/"), 3: ("www.example.com", "/en/", "www.example.com/en/"), 4: ("x.net", "/es/", "net/es/"),
            5: ("x.net", "/esx", None), 6: ("", "", None), 7: ("", "", None), 8: ("com", "", None), 9: ("notcom", "/", None), 10: ("b:", "//c/d", None)}
    assert {i: (out[i].host, out[i].path, out[i].rule) for i in want} == want
    assert (out[1].verdict, out[2].verdict, out[3].verdict, out[4].verdict) == ("allow", "block", "allow", "block")
    assert (out[300].verdict, out[301].verdict) == ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0


# op8 -----------------------------------------------------------------------------------


def test_quality_measures(docs, rows, spark, empty):
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, x, *_ in rows:
        x = x or ""
        w = word.findall(x)
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [line for line in x.split("\n") if word.search(line)]
        want = (len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.kept and r.base_failed)
    good = "This is a plain line of words, and one more of them.\n"
    lines = [
        "Home | About | News | Contact | Login", "Wow!!! Buy!!! Now!!! Cheap!!!", "All rights reserved.", "again again again again again",
    ]
    df = spark.createDataFrame([(1, good + good.replace("plain", "second") + "One more line of words stands here to be kept.\n" + "Another line with enough words to keep the text in the set.\n" + "\n".join(lines)), (2, "\n".join(lines * 3))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean(df).collect()}
    assert got[1].lines_removed == 4 and got[1].kept and not got[2].kept
    assert quality.clean(empty).count() == 0


# op9 -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = low(text)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def test_simhash_components(docs, rows, empty):
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: plain_fingerprint(t) for i, t, *_ in rows}
    assert {i: int(r.fingerprint, 16) for i, r in out.items()} == fp
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in out.items()} == closed(fp, pairs)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_every_difference_of_three_bits_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    fps = set(base.tolist())
    for b in base.tolist():
        for k in range(5):
            x = b & ((1 << 64) - 1)
            for bit in rng.choice(64, k, replace=False).tolist():
                x ^= 1 << bit
            fps.add(x - (1 << 64) if x >> 63 else x)
    crowd = int(base[0])
    fps |= {crowd ^ (1 << i) for i in range(30)}
    fps = sorted(fps)
    links = [(r.a, r.b) for r in simhash.linked(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    pairs = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert closed(fps, links) == closed(fps, pairs)


# op10 ----------------------------------------------------------------------------------


def cut(texts):
    data = [(t or "").encode() for t in texts]
    n = suffix.SPAN
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        rest = bytes(x for x, g in zip(b, gone) if not g)
        yield len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest()


@pytest.mark.parametrize("dense", [4096, 1])
def test_repeated_strings_are_cut(spark, monkeypatch, empty, dense):
    monkeypatch.setattr(suffix, "DENSE", dense)
    rng = np.random.default_rng(5)
    letters = "abcdefghé"
    make = lambda n: "".join(rng.choice(list(letters), n))
    shared, other = make(260), make(199)
    texts = [make(500) + shared + make(40), shared + make(300), make(10) + other, other + make(5), make(600)]
    texts += [texts[4][:450] + "X" + texts[4][451:], texts[4][5:330], "z" * 700, make(3) + shared[30:250] + "q" + shared[60:], *EDGE, "abc " * 120]
    texts += [texts[0][100:420] + make(3) for _ in range(6)]
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    for i, want in enumerate(cut(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert suffix.remove_repeats(empty).count() == 0


def test_long_texts_come_in_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 105, suffix.CHUNK * 2 + 777).astype(np.uint8)).decode()
    batch = pa.RecordBatch.from_arrays([pa.array(["short", text, None, "end"])], names=["text"])
    spans = {}
    for data, starts, ends, _, begin in suffix._pieces(iter([batch]), ()):
        for s, e, b in zip(starts, ends, begin):
            assert e - s <= suffix.CHUNK + suffix.SPAN
            spans.setdefault(len(spans), bytes(data[s:e]))
            if e - s >= suffix.SPAN:
                assert text.encode()[b : b + e - s] == bytes(data[s:e])
    assert sum(max(0, len(x) - suffix.SPAN + 1) for x in spans.values()) == len(text) - suffix.SPAN + 1


# all operators -------------------------------------------------------------------------


def test_null_ids_repeated_rows_and_clashing_names(spark):
    """Rows without an id, rows repeated as a whole and columns named like the operators' own: every row is there, none is lost."""
    import public_tokenizers

    text = "some words of a text that is here more than once, in a row and in another " * 4
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (7, text, "en", "s", 1), (7, text, "en", "s", 1), (8, "another text of a few words", None, None, 2), (None, None, None, None, None)]
    df = spark.createDataFrame(rows * 3, DOCS)
    for c in ("a", "b", "row", "spans", "_mix_source", "_mix_u", "given", "u", "least", "cdf", "label", "salt", "key", "g", "m", "h", "part", "r", "lang_pred", "fp", "_salt", "_w", "_lines", "kind", "block"):
        df = df.withColumn(c, F.lit("clash"))
    df = df.repartition(3)
    n = df.count()
    lengths = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).alias("docs")).collect()
    assert sum(r.docs for r in lengths) == n
    assert lm_score.score(df).count() == n
    assert shard.shard(df, shards=3).count() == n
    assert langid.predict(df, langid.train(df)).where("lang_pred <> 'clash'").count() == n
    assert quality.clean(df).count() == n
    assert simhash.near_duplicates(df).select("fingerprint").distinct().count() == 3 and simhash.near_duplicates(df).count() == n
    cut = suffix.remove_repeats(df)
    assert cut.count() == n and cut.where("a = 'clash' and b = 'clash' and spans = 'clash'").count() == n
    assert cut.where("n_removed > 0").count() == 12 and cut.where("n_bytes = 0").count() == 3
    mixed = mixing.mix(df)
    assert mixed.where("_mix_source = 'clash' and u = 'clash' and cdf = 'clash'").count() == mixed.count() > 0
    assert {r.n for r in mixed.groupBy("doc_id", "copy_no").agg(F.count("*").alias("n")).where("doc_id is not null").collect()} <= {3, 6}
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, "http://a.com/"), (1, "http://a.com/"), (1, None)], "page_id long, url string").withColumn("kind", F.lit("x"))
    assert urlfilter.judge(pages).count() == 4
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>").withColumn("vec", F.lit("x"))
    assert sorted((r.vec_id or 0, r.n_links) for r in embed_dedup.near_duplicates(vectors).collect()) == [(0, 0), (1, 1), (1, 1)]


def test_base_of_counted_and_spread_joins(spark, monkeypatch):
    """Frequent keys joined by broadcast, and by salts where there are too many of them, give the rows of a plain join."""
    from rosterlake.llm import common

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    table = common.materialise(rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3"), "table")
    want = sorted(map(tuple, rows.join(table, "k").select("k", "id", "n").collect()))
    got = lambda: sorted(map(tuple, common.counted_join(rows, table, ["k"], "n").select("k", "id", "n").collect()))
    assert got() == want
    monkeypatch.setattr(common, "HOT_KEYS", 0)
    assert got() == want
