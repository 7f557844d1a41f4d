"""Rating engines against published values, plain folds and each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import ratings

GAMES = "event_id long, game_key long, season int, division string, date date, clock string, stage string, home_id string, away_id string, home_score int, away_score int"


def history(spark, seed: int, n: int = 60):
    """Random games of eight teams over two seasons, rosters of three to five of twenty players, and stat lines."""
    import datetime

    rng = random.Random(seed)
    games, rosters, clubs, stats = [], [], [], []
    for k in range(n):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=k * 11)
        event = k // 4
        h, a = rng.sample(range(8), 2)
        games.append((event, k, day.year, "club-men", day, f"{rng.randrange(8, 18):02d}:15", "Pool A", f"{event}:{h}", f"{event}:{a}", rng.randrange(16), rng.randrange(16)))
        for t in (h, a):
            key = f"{event}:{t}"
            if key not in {c[0] for c in clubs}:
                clubs.append((key, f"club {t}"))
                for p in rng.sample(range(20), rng.randrange(0, 6)):
                    rosters.append((key, p))
                    stats.append((key, day, p, rng.random() * 2, float(rng.randrange(-3, 8))))
    return (
        spark.createDataFrame(games, GAMES),
        spark.createDataFrame(rosters, "event_team_id string, player_id long"),
        spark.createDataFrame(clubs, "event_team_id string, club string"),
        spark.createDataFrame(stats, "event_team_id string, end_date date, player_id long, usage double, quality double"),
    )


def plain(games, rosters, clubs, stats, cfg):
    """The replay as one loop over dictionaries."""
    rows = sorted((r.date, r.clock, r.event_id, r.game_key, r) for r in games.collect())
    squad, club, lines = {}, {r.event_team_id: r.club for r in clubs.collect()}, {}
    for r in rosters.collect():
        squad.setdefault(r.event_team_id, []).append(str(r.player_id))
    for r in stats.collect():
        lines.setdefault((r.end_date, r.event_team_id), []).append((str(r.player_id), r.usage, r.quality))
    todo = sorted(lines.items())
    state, out, season = {}, {}, None

    def debut(ids, start):
        for p in ids:
            state.setdefault(p, {"r": start, "g": 0, "u": 0.0, "n": 0, "b": start})

    def team(ids):
        top = max(state[p]["r"] for p in ids)
        w = [math.exp((state[p]["r"] - top) / cfg.tau) for p in ids]
        return sum(x * state[p]["r"] for x, p in zip(w, ids)) / sum(w)

    for day, _, _, key, g in rows:
        while todo and todo[0][0][0] < day:
            entries = todo.pop(0)[1]
            debut([p for p, _, _ in entries], cfg.base_rating)
            for p, u, _ in entries:
                state[p]["u"] += u
                state[p]["n"] += 1
            if len(entries) > 1:
                mean = sum(q for _, _, q in entries) / len(entries)
                t = [min(max(cfg.stat_transfer_beta * (q - mean), -cfg.stat_transfer_clamp), cfg.stat_transfer_clamp) for _, _, q in entries]
                for (p, _, _), x in zip(entries, t):
                    state[p]["r"] += x - sum(t) / len(t)
        if season is not None and g.season > season:
            for s in state.values():
                s["r"] = s["b"] + (1 - cfg.offseason_regression) ** (g.season - season) * (s["r"] - s["b"])
        season = g.season if season is None else max(season, g.season)
        teams = [sorted(squad.get(t) or [f"ghost:{club[t]}:{g.season}"]) for t in (g.home_id, g.away_id)]
        for ids in teams:
            debut(ids, 1500.0)
        ra, rb = team(teams[0]), team(teams[1])
        e = 1 / (1 + 10 ** ((rb - ra) / 260.0))
        won = 1.0 if g.home_score > g.away_score else 0.0 if g.home_score < g.away_score else 0.5
        m = math.log1p(abs(g.home_score - g.away_score)) / math.log1p(7) if g.home_score != g.away_score else 1.0
        out[key] = e
        for ids, sign, before in ((teams[0], 1, ra), (teams[1], -1, rb)):
            u = [min(max((cfg.involvement_shrink + state[p]["u"]) / (cfg.involvement_shrink + state[p]["n"]), 0.25), 3.0) for p in ids]
            for p, x in zip(ids, u):
                s = state[p]
                credit = x / (sum(u) / len(u)) if len(ids) > 1 else 1.0
                s["r"] += sign * cfg.k * m * (won - e) * credit * (1 + 50 / (10 + s["g"]))
                if len(ids) > 1:
                    s["r"] += cfg.roster_shrink * (before - s["r"])
                s["g"] += 1
                s["b"] = 1500.0
    return out, {p: s["r"] for p, s in state.items()}


PLANS = [("component", {}), ("slice", {}), ("slice", {"group_rows": 15}), ("slice", {"group_rows": 5, "slice_days": 100})]


@pytest.mark.parametrize("plan, size", PLANS)
def test_replay_equals_a_plain_fold(spark, plan, size):
    """In one group by components, in one slice, in slices of days, and in slices cut into components."""
    tables = history(spark, 3)
    cfg = ratings.EloConfig(offseason_regression=0.2)
    moves, state, _ = ratings.replay_player_elo(*tables, cfg, plan=plan, **size)
    want, final = plain(*tables, cfg)
    got = {r.game_key: r.expected for r in moves.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    rated = {r.player: r.rating for r in state.collect()}
    assert rated.keys() == final.keys()
    assert max(abs(rated[p] - final[p]) for p in final) < 1e-6


def test_glicko_gives_the_published_example():
    rating, rd, sigma = ratings.glicko_update(1500, 200, 0.06, [(1400, 30, 1, 1), (1550, 100, 0, 1), (1700, 300, 0, 1)])
    assert (round(rating, 2), round(rd, 2), round(sigma, 6)) == (1464.05, 151.52, 0.059996) or (round(rating, 2), round(rd, 2), round(sigma, 6)) == (1464.06, 151.52, 0.059996)


def test_stat_transfer_moves_nothing_in_sum():
    pool = ratings.Pool(ratings.EloConfig())
    pool.stats(["a", "b", "c"], [1.0, 0.5, 1.5], [9.0, -4.0, 1.0], 2020)
    assert abs(pool.table()["rating"].sum() - 3 * 1500) < 1e-9


def test_inactivity_decay_halves_the_distance_in_a_year():
    pool = ratings.Pool(ratings.EloConfig(inactivity_decay=0.5, inactivity_grace_days=0))
    i = pool.numbers(["a"], 1250.0, 2020)
    pool.rating[i], pool.day[i] = 1650.0, 0
    pool._rest(i, 365)
    assert abs(pool.rating[i][0] - 1450) < 0.2


def test_batch_ratings_balance(spark):
    games, _, clubs, _ = history(spark, 5)
    out = ratings.rate_teams_batch(games, clubs).toPandas()
    assert len(out) and np.isfinite(out["rating"]).all()


def test_unknown_names_are_refused(spark):
    games, rosters, clubs, _ = history(spark, 5, 4)
    with pytest.raises(ValueError, match="plan"):
        ratings.replay_player_elo(games, rosters, clubs, plan="x")
    with pytest.raises(ValueError, match="kind"):
        ratings.replay_team_elo(games, clubs, kind="x")


def test_leave_one_out_equals_two_replays(spark):
    games, rosters, clubs, _ = history(spark, 8, 24)
    cfg = ratings.EloConfig()
    got = ratings.leave_one_out(games, rosters, clubs, spark.createDataFrame([("3",)], "player string"), cfg).first()
    sizes = rosters.groupBy("event_team_id").count()
    less = rosters.join(sizes, "event_team_id").where("player_id <> 3 or count = 1").select("event_team_id", "player_id")
    mine = {r.event_team_id for r in rosters.where("player_id = 3").collect()}
    loss = []
    for r in (rosters, less):
        p = {x.game_key: x.expected for x in ratings.replay_player_elo(games, r, clubs, None, cfg).moves.collect()}
        part = [g for g in games.collect() if g.home_id in mine or g.away_id in mine]
        won = [1.0 if g.home_score > g.away_score else 0.0 if g.home_score < g.away_score else 0.5 for g in part]
        loss.append(np.mean([-(o * math.log(p[g.game_key]) + (1 - o) * math.log(1 - p[g.game_key])) for o, g in zip(won, part)]))
    assert abs(got["loo"] - (loss[1] - loss[0])) < 1e-9


@pytest.mark.parametrize("size", [{}, {"group_rows": 6}])
def test_trajectories_book_the_last_rating_of_an_event(spark, size):
    """Players' last points are their ratings at the end, as every stat line is booked to its event; slices do not matter."""
    games, rosters, clubs, stats = history(spark, 4, 40)
    stats = stats.withColumn("event_id", F.split_part("event_team_id", F.lit(":"), F.lit(1)).cast("long"))
    replay = ratings.replay_player_elo(games, rosters, clubs, stats, ratings.EloConfig(), points=True, **size)
    final = {r.player: r.rating for r in replay.state.collect() if not r.player.startswith("ghost:")}
    points = replay.points.collect()
    assert len({(p.kind, p.subject, p.event_id) for p in points}) == len(points)
    last: dict = {}
    for p in sorted((p for p in points if p.kind == "player"), key=lambda p: p.event_id):
        last[p.subject] = p.rating
    played = {p for p in final if p in last}
    assert played and max(abs(last[p] - final[p]) for p in played) < 1e-9
    assert all(p.n >= 1 for p in points if p.kind == "club")


@pytest.mark.parametrize("period", ["game", "day", "tournament"])
def test_glicko_slices_give_the_same(spark, period):
    tables = history(spark, 6, 40)
    whole = ratings.replay_glicko2(*tables, period=period)
    cut = ratings.replay_glicko2(*tables, period=period, group_rows=7)
    by = lambda df, k, v: {r[k]: r[v] for r in df.collect()}
    assert by(whole.moves, "game_key", "expected") == pytest.approx(by(cut.moves, "game_key", "expected"))
    assert by(whole.state, "player", "rating") == pytest.approx(by(cut.state, "player", "rating"))
    assert by(whole.state, "player", "rd") == pytest.approx(by(cut.state, "player", "rd"))


def test_a_sweep_is_as_many_replays(spark):
    games, rosters, clubs, stats = history(spark, 7, 24)
    configs = [ratings.EloConfig(), ratings.EloConfig(k=20.0, context_init=True), ratings.EloConfig(provisional_shape="linear", use_mov=False)]
    got = {(r.config, r.game_key): r.expected for r in ratings.sweep_predictions(games, rosters, clubs, stats, configs).collect()}
    for i, cfg in enumerate(configs):
        own = {r.game_key: r.expected for r in ratings.replay_player_elo(games, rosters, clubs, stats, cfg).moves.collect()}
        assert {k: got[i, k] for k in own} == pytest.approx(own)


def test_descent_finds_the_better_value(spark):
    games, rosters, clubs, _ = history(spark, 9, 24)
    axes = [("k", [1.0, 300.0]), ("home_advantage", [0.0])]
    best, moves = ratings.descend(games, rosters, clubs, None, axes, (2020, 2030), passes=2)
    loss = {r.config: r.log_loss for r in ratings.sweep(games, rosters, clubs, None, [ratings.EloConfig(), best]).collect()}
    assert loss[1] <= loss[0] and all(axis == "k" for axis, _, _ in moves)


def test_walk_forward_uses_earlier_days_only(spark):
    games, _, clubs, _ = history(spark, 5)
    one = ratings.walk_forward(games, clubs).toPandas().set_index("game_key")["diff"]
    cut = ratings.walk_forward(games.where("game_key < 20"), clubs).toPandas().set_index("game_key")["diff"]
    first = games.groupBy("season").agg(F.min("date").alias("date")).join(games, ["season", "date"]).select("game_key").toPandas()["game_key"]
    assert all(one[k] == 0 for k in first if k in one.index)
    assert set(cut.index) <= set(one.index)


def odd_rows(seed, n=150):
    """Rows of a slice: players on both sides, listed twice, alone; stat lines with and without events; seasons going on."""
    import pandas as pd

    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        late = int(rng.random() < 0.25)
        squad = lambda least: np.array([f"p{i}" for i in rng.integers(0, 25, rng.integers(least, 6))], dtype=object)
        home, away = squad(1), squad(0 if late else 1)
        if not late and rng.random() < 0.1:
            away = np.array([f"ghost:{k}"], dtype=object)
        x = dict(event_id=0 if late else k // 5, game_key=k, day=k // 3, home=home, away=away, late=late, clock_time=f"{rng.integers(10, 14)}", clock=2000 + k // 40)
        x |= dict(home_score=None, away_score=None, division=None, away_club=None) if late else dict(home_score=int(rng.integers(0, 16)), away_score=int(rng.integers(0, 16)), division=str(rng.choice(["club-men", "college", "other"])), away_club=f"c{rng.integers(0, 4)}")
        x |= dict(home_club=f"c{rng.integers(0, 4)}" if rng.random() < 0.9 else None, stat_event=int(rng.integers(0, n // 5)) if late and rng.random() < 0.7 else None)
        x |= dict(usage=rng.random(len(home)) * 2 if late else np.empty(0), quality=rng.integers(-3, 8, len(home)).astype(float) if late else np.empty(0))
        rows.append(x)
    return pd.DataFrame(rows)


def one_by_one(cfg, rows):
    """State, moves and points of the rows, game by game."""
    pool, moves, points = ratings.Pool(cfg), {}, {}
    for r in rows.sort_values(["day", "late", "clock_time", "event_id", "game_key"]).itertuples():
        def book(event, club, ids, listed):
            if club is not None and len(listed):
                points["club", club, event] = (pool.team(list(listed), r.clock), club)
            for p in ids:
                if not p.startswith("ghost:"):
                    old = points.get(("player", p, event))
                    points["player", p, event] = (float(pool.rating[pool.at[p]]), club if not r.late or old is None else old[1])

        if r.late:
            pool.stats(list(r.home), list(r.usage), list(r.quality), r.clock)
            if r.stat_event == r.stat_event:
                book(int(r.stat_event), r.home_club, r.home, r.away)
        else:
            moves[r.game_key] = pool.game(list(r.home), list(r.away), int(r.home_score), int(r.away_score), r.division, r.clock, r.day)
            book(r.event_id, r.home_club, r.home, r.home)
            book(r.event_id, r.away_club, r.away, r.away)
    return pool, moves, points


@pytest.mark.parametrize("options", [{}, {"context_init": True, "low_info_anchor": 0.1, "stat_transfer_beta": 1.0}, {"tau": math.inf, "inactivity_decay": 0.4, "inactivity_grace_days": 3, "involvement_credit": True}, {"provisional_shape": "linear", "use_mov": False, "roster_shrink": 0.0, "k_scale": {"college": 0.5}}])
def test_levels_give_what_single_games_give(options):
    from dataclasses import asdict

    import pandas as pd

    cfg = ratings.EloConfig(**options)
    for seed in range(4):
        rows = odd_rows(seed)
        pool, moves, points = one_by_one(cfg, rows)
        out = ratings._elo([asdict(cfg)], True)((0,), rows, pd.DataFrame(columns=ratings._names(ratings.STATE)))
        state = {r.player: r for r in out[out["kind"] == "state"].itertuples()}
        assert set(state) == set(pool.at)
        for p, i in pool.at.items():
            for name in ("rating", "games", "base", "used", "seen", "clock", "day"):
                assert getattr(state[p], name) == pytest.approx(getattr(pool, name)[i], abs=1e-9), (p, name)
        got = {r.game_key: (r.expected, r.home_before, r.away_before, r.home_after, r.away_after) for r in out[out["kind"] == "move"].itertuples()}
        assert set(got) == set(moves)
        assert all(got[k] == pytest.approx(moves[k], abs=1e-9) for k in moves)
        found = {(r.subject_kind, r.subject, r.point_event): (r.point_rating, r.point_club) for r in out[out["kind"] == "point"].itertuples()}
        assert set(found) == set(points)
        for k, (rating, club) in points.items():
            assert found[k][0] == pytest.approx(rating, abs=1e-9) and (found[k][1] if isinstance(found[k][1], str) else None) == club


def test_levels_are_as_low_as_they_can_be():
    sides = lambda lists: ratings.Sides(np.array(sum(lists, [])), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    assert ratings.levels([sides([[0], [2, 3], [0], [4]]), sides([[1], [4], [3], []])], 5).tolist() == [1, 1, 2, 2]


def glicko_by_periods(cfg, rows):
    """State and chances, one period after the other, player by player."""
    state, chances = {}, {}
    fresh = lambda base: dict(r=base, rd=cfg.initial_rd, v=cfg.initial_volatility, n=0, last=None, used=0.0, seen=0)
    for _, g in rows.sort_values(["day", "late", "clock_time", "event_id", "game_key"]).groupby("period", sort=False):
        if g["late"].iloc[0]:
            for line in g.itertuples():
                for p, u in zip(line.home, line.usage):
                    x = state.setdefault(p, fresh(cfg.base_rating))
                    x["used"], x["seen"] = x["used"] + u, x["seen"] + 1
            continue
        day, end = g["game_day"].min(), g["game_day"].max()
        base, now, results = cfg.division_bases.get(g["division"].iloc[0], cfg.base_rating), {}, {}
        for p in sorted({p for side in ("home", "away") for t in g[side] for p in t}):
            x = state.setdefault(p, fresh(base))
            gone = 1 if x["last"] is None else max(1, (day - x["last"]) / cfg.rating_period_days)
            now[p] = (x["r"], math.sqrt((x["rd"] / ratings.SCALE) ** 2 + x["v"] ** 2 * (gone - 1)), x["v"])

        def team(t):
            w = [math.exp((now[p][0] - max(now[q][0] for q in t)) / cfg.team_weight_tau) for p in t]
            rd = math.sqrt(sum((a / sum(w)) ** 2 * (now[p][1] ** 2 + now[p][2] ** 2) for a, p in zip(w, t)))
            return sum(a * now[p][0] for a, p in zip(w, t)) / sum(w), ratings.SCALE * rd

        def credit(t):
            u = [min(3.0, max(0.25, (1 + state[p]["used"]) / (1 + state[p]["seen"]))) for p in t]
            return [x * len(u) / sum(u) for x in u]

        for x in g.itertuples():
            h, a = team(x.home), team(x.away)
            phi = math.hypot(h[1], a[1]) / ratings.SCALE
            chances[x.game_key] = 1 / (1 + math.exp(-(h[0] - a[0]) / ratings.SCALE / math.sqrt(1 + 3 * phi**2 / math.pi**2)))
            won = (np.sign(x.home_score - x.away_score) + 1) / 2
            for t, rival, score in ((x.home, a, won), (x.away, h, 1 - won)):
                for p, c in zip(t, credit(t)):
                    results.setdefault(p, []).append((*rival, score, c))
        for p, r in results.items():
            x = state[p]
            x["r"], x["rd"], x["v"] = ratings.glicko_update(now[p][0], now[p][1] * ratings.SCALE, now[p][2], r)
            x["n"], x["last"] = x["n"] + len(r), end
    return state, chances


@pytest.mark.parametrize("period", ["game_key", "event_id"])
def test_glicko_levels_give_what_single_periods_give(period):
    import pandas as pd

    cfg = ratings.GlickoConfig()
    for seed in range(3):
        rows = odd_rows(seed, 80)
        rows["game_day"] = rows["day"]
        rows["period"] = [f"stat:{r.game_key}" if r.late else str(getattr(r, period)) for r in rows.itertuples()]
        state, chances = glicko_by_periods(cfg, rows)
        out = ratings._glicko(cfg)((), rows, pd.DataFrame(columns=ratings._names(ratings.GLICKO_STATE)))
        got = {r.player: r for r in out[out["kind"] == "state"].itertuples()}
        assert set(got) == set(state)
        for p, x in state.items():
            assert (got[p].rating, got[p].rd, got[p].volatility, got[p].used) == pytest.approx((x["r"], x["rd"], x["v"], x["used"]), abs=1e-6)
            assert (got[p].games, got[p].seen) == (x["n"], x["seen"]) and (x["last"] is None) == (got[p].last_day != got[p].last_day or got[p].last_day is pd.NA)
        moves = {r.game_key: r.expected for r in out[out["kind"] == "move"].itertuples()}
        assert moves == pytest.approx(chances, abs=1e-9)


def test_doubling_stops_where_plain_iteration_stops():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 12):
        for case in range(8):
            step = rng.random((n, n)) * (rng.random((n, n)) < (0.3 if case % 2 else 1.0))
            total = step.sum(1, keepdims=True)
            step = np.divide(step, total, out=np.zeros_like(step), where=total > 0)
            if case == 3 and n > 1:
                step[:2] = 0
                step[0, 1] = step[1, 0] = 1.0  # a pair that swings for ever
            lift, x = rng.normal(size=n), rng.normal(size=n) * 100
            lift -= lift.mean() * (case % 3 > 0)
            want, most = x, [2000, 31, 32, 33, 34, 100][case % 6]
            for _ in range(most):
                new = step @ want + lift
                moved, want = np.abs(new - want).max(), new
                if moved < 1e-3:
                    break
            assert ratings.settled(step, lift, x, 1e-3, most) == pytest.approx(want, rel=1e-9, abs=1e-7)


def test_a_descent_tries_each_configuration_once(spark, tmp_path, monkeypatch):
    corpus = history(spark, 3, 24)
    tried = []
    plain = ratings.sweep_predictions
    monkeypatch.setattr(ratings, "sweep_predictions", lambda *a, **k: (tried.extend((c.k, c.tau) for c in a[4]), plain(*a, **k))[1])
    args = (*corpus[:3], None, [("k", [24.0, 96.0]), ("tau", [100.0])], (2020, 2021))
    found, moves = ratings.descend(*args, passes=2, store=str(tmp_path / "trials"))
    assert len(tried) == len(set(tried))
    n = len(tried)
    again, same = ratings.descend(*args, passes=2, store=str(tmp_path / "trials"))
    assert len(tried) == n and (again, same) == (found, moves)
    grid = {(k, t): ratings.EloConfig(k=k, tau=t) for k in (24.0, 48.0, 96.0) for t in (100.0, 500.0)}
    losses = {r["config"]: r["loss"] for r in ratings.scores(plain(*corpus[:3], None, list(grid.values())), ["config", "division"]).groupBy("config").agg((F.sum(F.col("n") * F.col("log_loss")) / F.sum("n")).alias("loss")).collect()}
    assert losses[list(grid).index((found.k, found.tau))] <= losses[list(grid).index((48.0, 500.0))]
