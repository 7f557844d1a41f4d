"""Plans and steps that must not grow faster than their input."""

import datetime
import hashlib
import itertools
import math
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators import batch_players, corpus, identity, metrics, rankings, ratings, tournaments, trends
from rosterlake.plans import more
from rosterlake.plans.queries import QUERIES, SQL, Views
from rosterlake.sources import demo, tables
from rosterlake.streaming import ingest

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_roster_view_joins_by_squad(spark):
    """Customers meet the teams of their squad alone, not all teams of their division; the SQL of the other engine has no such mark."""
    join = next(x for x in plan(demo.made(spark, DIR, "v_roster")).splitlines() if "Join" in x)
    assert "pmod" in join
    assert "pmod" not in demo.duck_with() and "spark" not in demo.duck_with()


@F.pandas_udf(T.LongType())
def batch_size(x: pd.Series) -> pd.Series:
    return pd.Series([len(x)] * len(x))


def test_keys_once_per_text(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "José").alias("name")).coalesce(1)
    got = identity.with_keys(rows, "name", key=lambda c: F.coalesce(F.upper(c), F.lit("none")), size=batch_size)
    assert got.count() == 1000 and {r[0] for r in got.select("key").distinct().collect()} == {"JOSÉ", "none"}
    assert got.agg(F.max("size")).first()[0] <= 2


def test_days_of_names_once_per_event(spark):
    """Players of one name at one event give their days once, whatever their number."""
    rows = [("x", "club", 2020, c, e, "2020-01-01", "2020-01-07") for c, e in (("a", 1), ("b", 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "norm string, division string, season int, club string, event_id long, start_date string, end_date string")
    df = df.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    conflicts = identity.date_conflicts(df)
    assert [r[0] for r in conflicts.collect()] == ["x"]
    text = plan(conflicts)
    below = [x.lstrip(" :+-").split()[0] for x in text[text.index("Generate"):].splitlines()[1:4]]
    assert "Aggregate" in below


def test_team_seasons_in_batches(spark):
    """A season read in small batches gives the moves and the last state of one that is folded at once."""
    games = [(1 + i // 12, i, 2000 + i // 60, "club-men", f"{2000 + i // 60}-01-{1 + i % 60 // 4:02d}", "10:00", f"t{i % 5}", f"t{(i + 1 + i % 4) % 5 if (1 + i % 4) % 5 else 0}", 5 + i % 9, 3 + i % 11) for i in range(120)]
    df = spark.createDataFrame(games, "event_id long, game_key long, season int, division string, date string, clock string, home_id string, away_id string, home_score int, away_score int")
    clubs = spark.createDataFrame([(f"t{i}", f"club {i}") for i in range(5)], "event_team_id string, club string")
    rows = ratings.stream(df.withColumn("date", F.col("date").cast("date")), clubs.withColumnRenamed("club", "player_id"), clubs, None)
    rows = rows.withColumn("lane", F.lit(0))
    fold = ratings._elo([ratings.asdict(ratings.EloConfig(involvement_credit=False, stat_transfer_beta=0.0, roster_shrink=0.0))], False)
    out = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    got = ratings.streamed(rows, fold, ratings.STATE, ratings._OUT, ["lane", "season"], group_rows=7)
    want = ratings.replayed(rows, fold, ratings.STATE, ratings._OUT, ["lane", "season"])
    for kind, columns in (("move", ["game_key", "season", "expected", "home_after", "away_after"]), ("state", ["season", "player", "rating", "games"])):
        a, b = (out(df.where(F.col("kind") == kind).select(*columns)) for df in (got, want))
        assert a == b and len(a) == (120 if kind == "move" else 10)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_times_have_their_minutes(spark):
    """The minutes of the day belong to the query and its SQL."""
    got = QUERIES["f_times"](spark, DIR)
    assert set(got.columns) == {"game_key", "clock", "minutes", "inches"} and "AS minutes" in SQL["f_times"]
    assert got.where("minutes <> if(clock = '23:59', 10000, substr(clock, 1, 2) * 60 + substr(clock, 4, 2))").count() == 0


def test_rosters_stay_where_they_are_read(spark, monkeypatch):
    """A club with most of the rows is not sent to one task for its place; beyond the limit the places are joined all the same."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "the one").otherwise(F.concat(F.lit("c"), (F.col("id") % 70).cast("string"))).alias("club"))
    none, games = spark.createDataFrame([], "kind string, subject string"), spark.createDataFrame([], "season int")
    listed = trends.tiers(none, rows, games, 4)["rosters"]
    assert "strategy=broadcast" in plan(listed)
    place = {c: i % 4 for i, c in enumerate(sorted({r.club for r in rows.collect()}))}
    want = sorted((r.id, place[r.club]) for r in rows.collect())
    assert sorted((r.id, r.bucket) for r in listed.collect()) == want
    monkeypatch.setattr(trends, "_FEW", 1)
    assert sorted((r.id, r.bucket) for r in trends.tiers(none, rows, games, 4)["rosters"].collect()) == want


def test_bootstrap_hashes_many_games_at_once(spark):
    """Digests of arrays are those of hashlib, for heads of one block or more; the bounds are those of weights drawn one by one."""
    for head in (b"0|7|", b"0|1234567890123456789|", b"x" * 50, b"x" * 70):
        heads, tails = [head, head[::-1]], [b"0", b"42", b"99999"]
        got = metrics._digests(heads, tails)
        assert [[b"".join(int(x).to_bytes(8, "big") for x in y) for y in z] for z in got] == [[hashlib.md5(h + t).digest() for t in tails] for h in heads]
    games = [(k, 1, 0.1 + 0.8 * (k * 7 % 10) / 10, float(k % 2)) for k in range(95, 125)]
    a = spark.createDataFrame(games, "game_key long, event_id long, expected double, outcome double")
    b = a.withColumn("expected", 0.5 * F.col("expected") + 0.25)
    out = metrics.paired_bootstrap(a, b, draws=9)
    assert "Generate explode(sequence" not in plan(out)
    edges, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        total, p = total + p, p / k
        edges.append(total)
    loss = lambda y, e: -(y * math.log(e) + (1 - y) * math.log(1 - e))
    means = []
    for draw in range(9):
        w = {}
        for k, *_ in games:
            h = hashlib.md5(f"0|{k}|{draw // 2}".encode()).hexdigest()[16 * (draw % 2) :][:13]
            w[k] = sum(int(h, 16) / 2**52 >= e for e in edges)
        means.append(sum(w[k] * (loss(y, e) - loss(y, 0.5 * e + 0.25)) for k, _, e, y in games) / sum(w.values()))
    want = pd.Series(means)
    got = out.first()
    assert [got["mean"], got["low"], got["high"]] == pytest.approx([want.mean(), want.quantile(0.05), want.quantile(0.95)])


def test_a_roster_stands_once(spark):
    """However many games a team plays, its roster is one list in what a replay writes, and rows of a group share it."""
    games = [(1, k, 2020, "club-men", f"2020-01-{1 + k // 9:02d}", "10:00", "Pool A", f"t{k % 4}", f"t{(k + 1 + k // 4 % 3) % 4}", 5 + k % 9, 3 + k % 11) for k in range(90)]
    df = spark.createDataFrame(games, "event_id long, game_key long, season int, division string, date string, clock string, stage string, home_id string, away_id string, home_score int, away_score int")
    df = df.withColumn("date", F.col("date").cast("date"))
    clubs = spark.createDataFrame([(f"t{i}", f"club {i}") for i in range(4)], "event_team_id string, club string")
    rosters = spark.createDataFrame([(f"t{i}", 10 * i + p) for i in range(3) for p in range(6)], "event_team_id string, player_id long")
    rows, lists = ratings.keyed(df, rosters, clubs, None)
    assert dict(rows.dtypes)["home"] == "string" and lists.count() == 4
    fold = ratings._elo([ratings.asdict(ratings.EloConfig())], True)
    out = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.drop("slice").fillna(-1.0).fillna(-1).fillna("").collect())
    for size in ({"group_rows": 30}, {"group_rows": 5, "slice_days": 2}, {"plan": "component"}):
        got = ratings.replayed(rows, fold, ratings.STATE, ratings._OUT, lists=lists, **size)
        want = ratings.replayed(ratings.listed(rows, lists), fold, ratings.STATE, ratings._OUT, **size)
        assert out(got) == out(want) and got.where("kind = 'move'").count() == 90


def test_a_delivery_is_one_batch_of_many_files(spark):
    """No task writes a whole delivery, and yet no batch has a part of one."""
    old, new = (spark.range(400, numPartitions=4).select((F.col("id") % 9).alias("event_id"), F.col("id").alias("game_key"), F.lit(v).cast("long").alias("version")) for v in (1, 2))
    folder = more._delivered(Views(spark, ""), lambda s, f: ingest.start_ingest(s, f"{f}/log", f"{f}/checkpoint", once=True), new.where("event_id = 3"), old)
    assert all(len([x for x in os.listdir(f"{folder}/in/n={n}") if x.endswith(".parquet")]) == 4 for n in range(2))
    assert sorted(x for x in os.listdir(f"{folder}/log") if x.startswith("batch")) == ["batch=0", "batch=1"]
    got = ingest.current_events(spark, f"{folder}/log")
    assert got.count() == 400 and got.where("(version = 2) <> (event_id = 3)").count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_a_step_reads_shares_once_made(spark):
    """The shares of rosters are made once, not in each of the three places where a step reads them."""
    assert "Window" not in plan(QUERIES["r5_one_step"](spark, DIR))


def test_teams_meet_one_to_one(spark, monkeypatch):
    """A season of teams is folded game by game in plain numbers, with the moves and states of the levels' fold; teams of several clubs keep that one."""
    games = [(1 + i // 12, i, 2000 + i // 60, ("club-men", "college", "other", None)[i // 30], f"{2000 + i // 60}-01-{1 + i % 60 // 4:02d}", "10:00", f"t{i % 5}", f"t{(i + 1 + i % 4) % 5}" if i % 11 else f"t{i % 5}", 5 + i % 9, 3 + i % 11) for i in range(120)]
    df = spark.createDataFrame(games, "event_id long, game_key long, season int, division string, date string, clock string, home_id string, away_id string, home_score int, away_score int")
    df = df.withColumn("date", F.col("date").cast("date"))
    clubs = spark.createDataFrame([(f"t{i}", f"club {i}") for i in range(4)], "event_team_id string, club string")
    out = lambda r: [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in t.collect()) for t in (r.moves, r.state)]
    for cfg in (None, ratings.EloConfig(provisional_multiplier=1.0, home_advantage=30.0, k_scale={"college": 0.5}, involvement_credit=False)):
        want = out(ratings.replay_team_elo(df, clubs, cfg, plan="component"))
        with monkeypatch.context() as m:
            m.setattr(ratings, "_elo", None)
            got = ratings.replay_team_elo(df, clubs, cfg)
        assert out(got) == want and len(want[0]) == 120 and len(want[1]) == 10
    twice = clubs.unionByName(spark.createDataFrame([("t0", "second")], clubs.schema))
    assert out(ratings.replay_team_elo(df, twice)) == out(ratings.replay_team_elo(df, twice, plan="component"))


def test_only_last_points_are_repeated(spark):
    """The choices of a cube repeat the last point of a subject's season and division, not all of its points."""
    rows = [("club", f"c{s}", 2020, d, g, f"2020-01-{1 + n:02d}", n, float(n * 7 % 10 + s)) for s in range(3) for d, g in (("a", "1"), ("b", "1"), (None, "")) for n in range(9)]
    df = spark.createDataFrame(rows, "kind string, subject string, season int, division string, gender string, day string, seq long, rating double")
    got = trends._choices(df)
    text = plan(got)
    assert "Aggregate" in text[text.rindex("Generate"):]
    assert {tuple(r) for r in got.collect()} == {("club", d, g, f"c{s}", 2020, 6.0 + s) for s in range(3) for d in ("all", "a", "b", "") for g in (("all",) if d == "" else ("all", "1"))}


def schedule(parts: list[str]) -> str:
    span = lambda kind, inner: f'<span data-type="{kind}">{inner}</span>'
    sides = "".join(span(f"game-team-{s}", f'<a href="/t?EventTeamId={n}">A &amp; B</a>') + span(f"game-score-{s}", n) for n, s in enumerate(("home", "away"), 7))
    block = f'<h4 class="col_title"> Semis</h4><div class="bracket_game" id="b2"><div>{sides}</div><span class="date">7/12/2024 9:00</span></div>'
    return f'text<h3>Pool A</h3><table><tr data-game="1"><td>{span("game-date", "7/12")}{parts[0]}{sides}</td></tr></table>{parts[1]}{block}{parts[2]}<a href="/g?EventGameId=5">x</a>'


def test_plain_pages_need_no_parser(monkeypatch):
    """Pages of plain tags are cut at them; whatever else stands in a page, the games are those of the parser."""
    odd = ["", "<br/>", "<!-- <tr> -->", "<BR>", "&amp;", "&", "<", "x < y > z", "<script>a<b</script>", "<title>x<h3>y</title>", "</ p>", "<p >", "</div>", "<tr data-game='3'>", '<a href="/x?a=1&EventGameId=4">', "&lt", '<td a="1"b="2">', "<!doctype html>"]
    monkeypatch.setattr(tables, "_PIECE", 60)
    for i in range(3):
        for x in odd:
            page = schedule(["" if i != n else x for n in range(3)])
            for html in (page, page[:-9], page + x):
                want, got = tables._Schedule(2024), tables._Schedule(2024)
                want.feed(html)
                want.close()
                got.read(html)
                assert (got.games, got.teams) == (want.games, want.teams)
    monkeypatch.setattr(tables._Schedule, "feed", None)
    plain = tables._Schedule(2024)
    plain.read(schedule(["", "", ""]))
    assert [g[:4] for g in plain.games] == [("pool-1", "1", "Pool A", "2024-07-12"), ("bracket-b2", "b2", "Semis", "2024-07-12")]


def plain_pools(games):
    """``pools_of`` as it is told, over all sets of teams."""
    open_, found = list(games), []
    while open_:
        first = {}
        for g in open_:
            first.setdefault(frozenset(g[3:5]), g)
        a, b = sorted(open_[0][3:5])
        teams = sorted({t for p in first for t in p} - {a, b})
        all_met = [c for n in range(len(teams) + 1) for x in itertools.combinations(teams, n) for c in [tuple(sorted((a, b, *x)))] if all(frozenset(p) in first for p in itertools.combinations(c, 2))]
        largest = [c for c in all_met if len(c) > 2 and not any(set(c) < set(d) for d in all_met)]
        part = [open_[0]]
        if largest:
            days = lambda c: len({first[frozenset(p)][2] for p in itertools.combinations(c, 2)})
            best = min(largest, key=lambda c: (days(c), -len(c), c))
            part = [first[frozenset(p)] for p in itertools.combinations(best, 2)]
            found.append((best, sorted(part)))
        open_ = [g for g in open_ if g not in part]
    found.sort(key=lambda f: f[1][0])
    return [(n, g[1], any(set(c) & set(d) for d, _ in found[: n - 1])) for n, (c, part) in enumerate(found, 1) for g in part]


def test_pools_of_many_games(spark):
    """Pools are those of all sets tried, and their groups get no more than who met whom and when."""
    draw = random.Random(3)
    for n, m in ((3, 6), (5, 30), (6, 40), (7, 60)):
        games = [(i, 100 + i, f"d{draw.randrange(3)}", *draw.sample([f"t{x}" for x in range(n)], 2)) for i in range(m)]
        assert tournaments.pools_of(games) == plain_pools(games)
    fix = spark.createDataFrame([(1, g[1], "Pool A", g[2], g[3], g[4], 3, 2, True, g[0]) for g in games], "event_id long, game_key long, stage string, date string, home_id string, away_id string, home_score int, away_score int, done boolean, ord long")
    got = tournaments.recover_pools(fix)
    group = plan(got)
    assert "Project [event_id" in group[group.index("FlatMapGroupsInPandas"):] and "home_score" not in group.splitlines()[1]
    assert [tuple(r) for r in got.orderBy("pool", "game_key").collect()] == [(1, n, k, later) for n, k, later in tournaments.pools_of(games)]


def test_labels_are_read_once_per_text(spark):
    """Stages are told apart in a table of texts, not by patterns in each game; a game that is not done crowns nobody, be it published or not."""
    games = [(1, 1, "Finals", True), (1, 2, "Semi Finals", True), (1, 3, None, True), (2, 4, "Finals", False), (2, 5, "Semi Finals", True)]
    rows = [(e, k, s, "2020-01-01", f"h{k}", f"a{k}", 9, 2, d, k) for e, k, s, d in games]
    fix = spark.createDataFrame(rows, "event_id long, game_key long, stage string, date string, home_id string, away_id string, home_score int, away_score int, done boolean, ord long")
    got = tournaments.labelled(fix)
    assert "RLIKE" not in plan(got).upper() and sorted((r.game_key, r.kind, r.round) for r in got.collect()) == [(1, "champ", 0), (2, "champ", 1), (3, None, None), (4, "champ", 0), (5, "champ", 1)]
    published = spark.createDataFrame([(2, 4, 1, 1, 1, "Finals"), (2, 5, 1, 0, 1, "Semi Finals")], "event_id long, game_key long, bracket long, round int, place int, stage string")
    assert [tuple(r) for r in tournaments.decomposed_champions(fix).collect()] == [(1, "h1")]
    assert sorted(tuple(r) for r in tournaments.decomposed_champions(fix, published).collect()) == [(1, "h1"), (2, "h5")]


def test_pools_are_found_among_all_sets():
    """Thirty teams in ten groups of three, who met all but their own group's: 59,049 sets of ten, of which each pool is the first of the fewest days."""
    teams = [f"t{x:02d}" for x in range(30)]
    pairs = [(x, y) for x, y in itertools.combinations(range(30), 2) if x // 3 != y // 3]
    games = [(i, i, "d1", teams[x], teams[y]) for i, (x, y) in enumerate(pairs)]
    first = [g[1] for g in games if int(g[3][1:]) % 3 == int(g[4][1:]) % 3 == 0]
    assert [k for n, k, _ in tournaments.pools_of(games) if n == 1] == first and len(first) == 45
    apart = {0, 4, 8, 9, 13, 17, 18, 22, 26, 27}  # met on one day, all others on two
    games = [(i, i, "d1" if {x, y} <= apart else f"d{2 + i % 2}", teams[x], teams[y]) for i, (x, y) in enumerate(sorted(pairs, key=lambda p: p != (0, 4)))]
    assert [k for n, k, _ in tournaments.pools_of(games) if n == 1] == [g[1] for g in games if g[2] == "d1"]


def test_twins_are_replayed_once(spark):
    """Players of the same rosters are one entry of a replay's lists, and all of them have the results of a replay with each of them."""
    games = [(1 + k // 18, k, 2020, "club-men", f"2020-01-{1 + k // 9:02d}", "10:00", "Pool A", f"t{k % 4}", f"t{(k + 1 + k // 4 % 3) % 4}", 5 + k % 9, 3 + k % 11) for k in range(90)]
    df = spark.createDataFrame(games, "event_id long, game_key long, season int, division string, date string, clock string, stage string, home_id string, away_id string, home_score int, away_score int")
    df = df.withColumn("date", F.col("date").cast("date"))
    clubs = spark.createDataFrame([(f"t{i}", f"club {i}") for i in range(4)], "event_team_id string, club string")
    rosters = spark.createDataFrame([(f"t{i}", 10 * i + p) for i in range(3) for p in range(7)] + [("t0", 1), ("t1", 2), ("t2", None)], "event_team_id string, player_id long")
    stats = spark.createDataFrame([("t0", "2020-01-03", p, 1.0 + p, float(p), 1) for p in (3, 4)] + [("t1", "2020-01-05", p, 1.0, 2.0, 2) for p in (12, 77)], "event_team_id string, end_date string, player_id long, usage double, quality double, event_id long")
    stats = stats.withColumn("end_date", F.col("end_date").cast("date"))
    out = lambda df: sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    lists = {r.squad: sorted(zip(r.players, r.counts)) for r in ratings.prepared(df, rosters, clubs, stats).lists.collect()}
    assert lists["roster:t2"] == [("20", 7)] and lists["roster:t1"] == [("10", 6), ("12", 1), ("2", 1)] and lists["roster:t0"] == [("0", 3), ("1", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 1)]
    for cfg in (ratings.EloConfig(), ratings.EloConfig(tau=math.inf, context_init=True, low_info_anchor=0.1, inactivity_decay=0.3, inactivity_grace_days=0)):
        rows = ratings.stream(df, rosters, clubs, stats)
        plain = ratings.replayed(rows, ratings._elo([ratings.asdict(cfg)], True), ratings.STATE, ratings._OUT)
        got = ratings.replay_player_elo(df, rosters, clubs, stats, cfg, points=True)
        assert out(got.moves) == out(plain.where("kind = 'move'").select(got.moves.columns)) and got.moves.count() == 90
        assert out(got.state.drop("clock")) == out(plain.where("kind = 'state'").select(got.state.columns).drop("clock"))
        points = plain.where("kind = 'point' and not (subject_kind = 'player' and subject like 'ghost:%')").groupBy("subject_kind", "subject", "point_event").agg(F.max_by(F.struct("point_rating", "n", "point_club"), "slice").alias("x"))
        assert out(got.points) == out(points.select("subject_kind", "subject", "point_event", "x.*"))
    fold = ratings._glicko(ratings.GlickoConfig())
    rows = ratings.stream(df, rosters, clubs, stats).withColumn("period", F.concat_ws(":", "late", "event_id", "game_key", "day")).withColumns({"game_day": F.col("day"), "start": F.col("day")})
    plain = ratings.replayed(rows, fold, ratings.GLICKO_STATE, ratings._GLICKO, day="start")
    got = ratings.replay_glicko2(df, rosters, clubs, stats, period="game")
    assert out(got.moves) == out(plain.where("kind = 'move'").select(got.moves.columns))
    assert out(got.state.select("player", "rating", "games")) == out(plain.where("kind = 'state' and last_day is not null").select("player", "rating", "games"))


def test_teams_carried_over_meet_one_to_one(spark, monkeypatch):
    """Clubs that keep their ratings are folded game by game in plain numbers, with the moves and states of the levels' fold."""
    games = [(1 + i // 12, i, 2000 + i // 60, ("club-men", "college", "other", None)[i // 30], f"{2000 + i // 60}-01-{1 + i % 60 // 4:02d}", "10:00", f"t{i % 5}", f"t{(i + 1 + i % 4) % 5}" if i % 11 else f"t{i % 5}", 5 + i % 9, 3 + i % 11) for i in range(120)]
    df = spark.createDataFrame(games, "event_id long, game_key long, season int, division string, date string, clock string, home_id string, away_id string, home_score int, away_score int")
    df = df.withColumn("date", F.col("date").cast("date"))
    clubs = spark.createDataFrame([(f"t{i}", f"club {i}") for i in range(4)], "event_team_id string, club string")
    out = lambda r: [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in t.drop("day").collect()) for t in (r.moves, r.state)]
    want = out(ratings.replay_team_elo(df, clubs, kind="carry", plan="component"))
    monkeypatch.setattr(ratings, "_elo", None)
    assert out(ratings.replay_team_elo(df, clubs, kind="carry")) == want and len(want[0]) == 120 and len(want[1]) == 6


def test_lineups_are_counted_once(spark):
    """The sizes of professional rosters need no row for each player of each game."""
    games = spark.createDataFrame([(g, 2000 + g % 2, f"2000-01-0{1 + g}", g % 3, (g + 1) % 3, 5, None if g == 4 else 3, "Live" if g == 5 else "Final") for g in range(9)], "game_id long, year int, date string, home_team_id long, away_team_id long, home_score int, away_score int, status string")
    games = games.withColumn("date", F.col("date").cast("date"))
    lineups = spark.createDataFrame([(t, y, p, p % 4) for t in range(3) for y in (2000, 2001) for p in range(3 + 9 * t + y % 2)], "team_id long, year int, pro_id long, points_played long")
    links = spark.createDataFrame([(p, 100 + p) for p in range(30) if p % 5], "pro_id long, player_id long")
    played = games.select("game_id", "year", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).join(lineups, ["team_id", "year"])
    want = corpus.load_pro_games(games, played, links)[1].groupBy("event_team_id").agg(F.count("*").alias("n"))
    got = corpus.pro_roster_sizes(games, lineups, links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3
    text = plan(got)
    assert text.index("Join") < text.index("count(1)")


def test_best_rosters_are_read_where_they_are(spark):
    """Only the rows of best rosters are made distinct, and no roster is sent away to be asked for."""
    rosters = spark.createDataFrame([(f"t{t}", t, 2000 + t % 3, p) for t in range(6) for p in (1, 1, 2, t)], "event_team_id string, event_id long, season int, player_id long")
    clubs = spark.createDataFrame([(f"t{t}", f"c{t % 2}", "club-men") for t in range(6)], "event_team_id string, club string, division string")
    best = spark.createDataFrame([("club-men", "c0", "t4"), ("club-men", "c1", "t3")], "division string, club string, event_team_id string")
    got = rankings.season_roster(rosters, clubs, best)
    assert "LeftSemi" in plan(got)
    latest = {(r.club, r.player_id, r.n_events) for r in got.where("season = 2002").collect()}
    assert latest == {("c0", 1, 1), ("c0", 2, 1), ("c0", 4, None), ("c1", 1, 1), ("c1", 2, 1), ("c1", 3, None)} and got.where("season = 2001").count() == 5


def test_twins_are_rated_once(spark):
    """Players of the same rosters are one entry of a batch rating, with the shares and credits of each of them."""
    clubs = spark.createDataFrame([(f"t{i}", f"c{i}") for i in range(2)], "event_team_id string, club string")
    rosters = spark.createDataFrame([("t0", p) for p in (1, 2, 3, 3, 4)] + [("t1", p) for p in (5, 6, 7)], "event_team_id string, player_id long")
    stats = spark.createDataFrame([("t0", "2020-01-01", 4, 3.0, 1.0)], "event_team_id string, end_date string, player_id long, usage double, quality double").withColumn("end_date", F.col("end_date").cast("date"))
    games = spark.createDataFrame([(0, "t0", "t1", 2020)], "lane int, home_id string, away_id string, season int")
    cutoffs = [datetime.date(2020, 2, 1)]
    whole = batch_players.entries_of(games, rosters, clubs, stats, cutoffs)
    who = ratings.twins(rosters, spark.createDataFrame([("4",)], "player string"))
    once = batch_players.entries_of(games, rosters, clubs, stats, cutoffs, who)
    assert sorted(r.player for r in once.collect()) == ["1", "3", "4", "5"] and whole.count() == 8
    twin = who.select("player", "twin")
    share = {r[0]: r[1] for r in whole.join(twin, "player").groupBy("twin").agg(F.sum("share")).collect()}
    credit = {r[0]: r[1] for r in whole.groupBy("player").agg(F.sum("credit")).collect()}
    for r in once.collect():
        assert r.share == pytest.approx(share[r.player]) and r.credit == pytest.approx(credit[r.player])
