"""Batch ratings of players against a dense solve and one-by-one decisions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import batch_players as bp
from tests.test_ratings import history


def dense(games, rosters, clubs, stats, cutoff, prior=2.0):
    """Ratings and the games left out, by solving the linear system."""
    squad, club, used = {}, {r.event_team_id: r.club for r in clubs.collect()}, {}
    for r in rosters.collect():
        squad.setdefault(r.event_team_id, []).append(str(r.player_id))
    for r in stats.collect():
        if r.end_date < cutoff:
            used.setdefault(str(r.player_id), []).append(r.usage)
    live = [g for g in games.collect() if 0 < (cutoff - g.date).days <= 730]
    first = {}
    for g in live:
        for t in (g.home_id, g.away_id):
            first[t] = min(first.get(t, g.season), g.season)
    teams = {t: squad.get(t) or [f"ghost:{club[t]}:{s}"] for t, s in first.items()}
    players = sorted({p for ps in teams.values() for p in ps})
    use = {p: min(3.0, max(0.25, (4 + sum(used.get(p, []))) / (4 + len(used.get(p, []))))) for p in players}
    share = {t: [use[p] / sum(use[q] for q in ps) for p in ps] for t, ps in teams.items()}

    def weight(g):
        w, l = max(g.home_score, g.away_score), min(g.home_score, g.away_score)
        return np.sqrt(min(1, (w + max(l, (w - 1) // 2)) / 19)) * 0.5 ** ((cutoff - g.date).days / 126)

    def x(g):
        w, l = max(g.home_score, g.away_score), min(g.home_score, g.away_score)
        return 0.0 if w == l else np.sign(g.home_score - g.away_score) * (125 + 475 * np.sin(min(1, 2 * (1 - l / max(w - 1, 1))) * 0.4 * np.pi) / np.sin(0.4 * np.pi))

    out, n, at = set(), len(players), {p: i for i, p in enumerate(players)}
    for _ in range(bp.ROUNDS):
        a, b, d = np.zeros((n, n)), np.full(n, prior * 1000.0), np.full(n, prior)
        for g in live:
            if g.game_key in out:
                continue
            for t, rival, s in ((g.home_id, g.away_id, x(g)), (g.away_id, g.home_id, -x(g))):
                for p, v in zip(teams[t], share[t]):
                    c = v * len(teams[t]) * weight(g)
                    d[at[p]] += c
                    b[at[p]] += c * s
                    for q, u in zip(teams[rival], share[rival]):
                        a[at[p], at[q]] += c * u
        r = np.linalg.solve(np.diag(d) - a, b)
        strong = {t: sum(v * r[at[p]] for p, v in zip(ps, share[t])) for t, ps in teams.items()}
        counted, now, far = {}, set(), []
        for g in live:
            for t in (g.home_id, g.away_id):
                counted[club[t]] = counted.get(club[t], 0) + 1
            s = np.sign(g.home_score - g.away_score)
            ahead = s * (strong[g.home_id] - strong[g.away_id])
            if s and ahead > bp.BLOWOUT_GAP and max(g.home_score, g.away_score) > 2 * min(g.home_score, g.away_score) + 1:
                far.append((-ahead, g.game_key, club[g.home_id if s > 0 else g.away_id], club[g.away_id if s > 0 else g.home_id]))
        for _, key, top, low in sorted(far):
            if counted[top] - 1 >= bp.MIN_KEPT:
                now.add(key)
                counted[top] -= 1
                counted[low] -= 1
        if now == out:
            break
        out = now
    return {p: r[at[p]] for p in players if d[at[p]] > prior}, out, strong


@pytest.mark.parametrize("gap", [120.0])
def test_ratings_equal_a_dense_solve(spark, monkeypatch, gap):
    monkeypatch.setattr(bp, "BLOWOUT_GAP", gap)
    monkeypatch.setattr(bp, "ROUNDS", 2)
    monkeypatch.setattr(bp.blowouts, "__defaults__", (gap, bp.MIN_KEPT))
    corpus = history(spark, 5, 90)
    cutoffs = [datetime.date(2021, 3, 1), datetime.date(2022, 6, 1), datetime.date(2019, 1, 1)]
    rated, strong = bp.rate_players_batch(*corpus, cutoffs, tolerance=1e-3)
    got, teams = rated.collect(), strong.collect()
    dropped = 0
    for c in cutoffs[:2]:
        want, out, strengths = dense(*corpus, c)
        dropped += len(out)
        mine = {r.player: r.rating for r in got if r.cutoff == c}
        assert set(mine) == set(want)
        assert max(abs(mine[p] - want[p]) for p in want) < 0.05
        mine = {r.event_team_id: r.strength for r in teams if r.cutoff == c}
        assert set(mine) == set(strengths) and max(abs(mine[t] - strengths[t]) for t in mine) < 0.05
    assert not [r for r in got if r.cutoff == cutoffs[2]]
    assert gap > 500 or dropped


def test_a_warm_start_gives_the_same_and_games_of_the_day_are_predicted(spark):
    corpus = history(spark, 8, 24)
    day = corpus[0].agg(F.max("date")).first()[0]
    rated, _ = bp.rate_players_batch(*corpus, [day], tolerance=1e-2)
    again, _ = bp.rate_players_batch(*corpus, [day], tolerance=1e-2, start=rated.withColumn("rating", F.col("rating") + 3))
    a, b = ({r.player: r.rating for r in x.collect()} for x in (rated, again))
    assert set(a) == set(b) and max(abs(a[p] - b[p]) for p in a) < 0.5
    ahead = bp.walk_forward_players(*corpus, [day], tolerance=1e-2).collect()
    assert len(ahead) == corpus[0].where(F.col("date") == day).count()
    game = corpus[0].where(F.col("date") == day).first()
    squads = {}
    for r in corpus[1].collect():
        squads.setdefault(r.event_team_id, []).append(a.get(str(r.player_id), 1000.0))
    for r in ahead:
        if r.game_key == game.game_key and len(squads.get(game.home_id, [])) == 1 == len(squads.get(game.away_id, [])):
            assert abs(r.diff - squads[game.home_id][0] + squads[game.away_id][0]) < 0.5


def test_blowouts_are_settled_as_one_by_one(spark):
    rng = np.random.default_rng(2)
    teams = [f"t{i}" for i in range(12)]
    rows = [(i % 2, i, 1, *rng.choice(12, 2, replace=bool(i % 3)).tolist(), 15, int(rng.integers(0, 5)), int(rng.integers(-1, 2))) for i in range(400)]
    games = spark.createDataFrame([(l, k, e, teams[h], teams[a], m, n, s) for l, k, e, h, a, m, n, s in rows], "lane int, game_key long, event_id long, home_id string, away_id string, most int, least int, sign int")
    power = {(l, t): float(rng.integers(0, 12)) * 100 for l in (0, 1) for t in teams}
    strength = spark.createDataFrame([(l, t, s) for (l, t), s in power.items()], "lane int, team string, strength double")
    clubs = spark.createDataFrame([(l, t, f"c{int(t[1:]) % 7}") for l, t in power], "lane int, team string, club string")
    club = {t: f"c{int(t[1:]) % 7}" for t in teams}
    for kept in (5, 40, 60):
        want = set()
        for lane in (0, 1):
            own = [(k, teams[h], teams[a], m, n, s) for l, k, _, h, a, m, n, s in rows if l == lane]
            counted = {}
            for _, h, a, *_ in own:
                counted[club[h]] = counted.get(club[h], 0) + 1
                counted[club[a]] = counted.get(club[a], 0) + 1
            far = [(-s * (power[lane, h] - power[lane, a]), k, club[h if s > 0 else a], club[a if s > 0 else h]) for k, h, a, m, n, s in own if s and s * (power[lane, h] - power[lane, a]) > 300 and m > 2 * n + 1]
            for _, k, top, low in sorted(far):
                if counted[top] - 1 >= kept:
                    want.add((lane, k))
                    counted[top] -= 1
                    counted[low] -= 1
        got = {(r.lane, r.game_key) for r in bp.blowouts(games, clubs, strength, 300.0, kept).collect()}
        assert got == want and want


def test_no_games(spark):
    corpus = [x.limit(0) for x in history(spark, 1, 4)]
    rated, strong = bp.rate_players_batch(*corpus, [datetime.date(2021, 1, 1)])
    assert rated.count() == 0 == strong.count()
