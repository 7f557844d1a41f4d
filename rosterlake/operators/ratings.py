"""Ratings: player and team Elo, Glicko-2, batch team ratings, and the search over configurations.

Replays are folds over a total order, cut into slices of time; the players' state
is carried from slice to slice in a table. Where the history is small, a slice
takes as many days as have GROUP_ROWS rows together and is one group, so a group
never holds more (or one day). Where a week has more rows than that, a slice is a
week and is cut into the connected components of the players who meet in it, as
two games without a common player commute (plan ``slice``). Plan ``component`` is
one slice of all days. Regression between seasons depends on a player and the
global season alone and is applied when the player is touched next. Replays of
several configurations, or without single players, are lanes of one replay.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake import vocab
from rosterlake.functions.measures import outcome
from rosterlake.operators.graph import components, written
from rosterlake.operators.metrics import scores


@dataclass
class EloConfig:
    """The published options by their published names, with their published values (fixed values)."""

    base_rating: float = 1500.0
    division_bases: dict = field(default_factory=lambda: dict(vocab.DIVISION_BASES))
    k_scale: dict = field(default_factory=dict)
    context_init: bool = False
    rookie_discount: float = 50.0
    k: float = 48.0
    scale: float = 400.0
    home_advantage: float = 0.0
    division_scale: dict = field(default_factory=lambda: dict(vocab.DIVISION_SCALE))
    tau: float = 500.0
    mov_norm: float = 7.0
    use_mov: bool = True
    provisional_games: int = 10
    provisional_multiplier: float = 6.0
    provisional_shape: str = "hyperbolic"
    offseason_regression: float = 0.0
    inactivity_decay: float = 0.0
    inactivity_grace_days: int = 90
    involvement_credit: bool = True
    involvement_shrink: float = 1.0
    involvement_clamp: tuple = (0.25, 3.0)
    stat_transfer_beta: float = 12.0
    stat_transfer_clamp: float = 90.0
    low_info_anchor: float = 0.0
    roster_shrink: float = 0.025


class Pool:
    """The state of some players in arrays, advanced by games and stat lines."""

    def __init__(self, cfg: EloConfig):
        self.cfg, self.at = cfg, {}
        self.rating, self.games, self.base = np.zeros(64), np.zeros(64), np.zeros(64)
        self.used, self.seen, self.clock, self.day = np.zeros(64), np.zeros(64), np.zeros(64, int), np.full(64, -1)

    def numbers(self, ids: list, start: float, clock: int) -> np.ndarray:
        """Indices of players; new ones start at ``start``. Regression up to ``clock`` is applied."""
        for p in ids:
            if p not in self.at:
                n = self.at[p] = len(self.at)
                if n == len(self.rating):
                    for name in ("rating", "games", "base", "used", "seen", "clock", "day"):
                        setattr(self, name, np.concatenate([getattr(self, name), np.full(n, -1) if name == "day" else np.zeros_like(getattr(self, name))]))
                self.rating[n] = self.base[n] = start
                self.clock[n], self.day[n] = clock, -1
        i = np.array([self.at[p] for p in ids], int)
        late = clock - self.clock[i]
        if self.cfg.offseason_regression and (late > 0).any():
            keep = (1 - self.cfg.offseason_regression) ** np.maximum(late, 0)
            self.rating[i] = self.base[i] + keep * (self.rating[i] - self.base[i])
        self.clock[i] = np.maximum(self.clock[i], clock)
        return i

    def _debut(self, ids: list, start: float) -> float:
        """The rating a player begins with: the division's base, or where that is asked for the mean of the team-mates known."""
        if not self.cfg.context_init:
            return start
        known = [self.rating[self.at[p]] for p in ids if p in self.at]
        return sum(known) / len(known) - self.cfg.rookie_discount if known else start

    def _provisional(self, games: np.ndarray) -> np.ndarray | float:
        n, m = self.cfg.provisional_games, self.cfg.provisional_multiplier
        if m <= 1 or n <= 0:
            return 1.0
        shapes: dict[str, Callable] = {
            "cliff": lambda g: np.where(g < n, m, 1.0), "linear": lambda g: np.maximum(1.0, m - (m - 1) * g / n),
            "exponential": lambda g: 1 + (m - 1) * np.exp(-g / n), "hyperbolic": lambda g: 1 + (m - 1) * n / (n + g),
        }
        if self.cfg.provisional_shape not in shapes:
            raise ValueError(f"unknown shape {self.cfg.provisional_shape!r}")
        return shapes[self.cfg.provisional_shape](games)

    def team(self, ids: list, clock: int) -> float:
        """The rating of a team now; players who are not known count as the base. Nothing changes."""
        known = self.numbers([p for p in ids if p in self.at], 0.0, clock)
        r = np.concatenate([self.rating[known], np.full(len(ids) - len(known), self.cfg.base_rating)])
        w = np.ones(len(r)) if math.isinf(self.cfg.tau) else np.exp((r - r.max()) / self.cfg.tau)
        return float(w @ r / w.sum())

    def _rest(self, i: np.ndarray, day: int) -> None:
        c = self.cfg
        idle = np.where(self.day[i] >= 0, np.maximum(0, day - self.day[i] - c.inactivity_grace_days), 0)
        self.rating[i] = self.base[i] + (1 - c.inactivity_decay) ** (idle / 365.25) * (self.rating[i] - self.base[i])
        self.day[i] = day

    def _shares(self, i: np.ndarray) -> np.ndarray:
        if math.isinf(self.cfg.tau):
            return np.full(len(i), 1 / len(i))
        w = np.exp((self.rating[i] - self.rating[i].max()) / self.cfg.tau)
        return w / w.sum()

    def game(self, home: list, away: list, hs: int, as_: int, division: str, clock: int, day: int) -> tuple[float, float, float, float, float]:
        """Chance of the home team; both teams' ratings before and after."""
        c = self.cfg
        start = c.division_bases.get(division, c.base_rating)
        sides = [self.numbers(x, self._debut(x, start), clock) for x in (home, away)]
        if c.inactivity_decay:
            for i in sides:
                self._rest(i, day)
        shares = [self._shares(i) for i in sides]
        before = [float(s @ self.rating[i]) for s, i in zip(shares, sides)]
        chance = 1 / (1 + 10 ** ((before[1] - before[0] - c.home_advantage) / c.division_scale.get(division, c.scale)))
        won = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
        mov = math.log1p(abs(hs - as_)) / math.log1p(c.mov_norm) if hs != as_ and c.use_mov else 1.0
        delta = c.k * c.k_scale.get(division, 1.0) * mov * (won - chance)
        for i, s, sign, team in zip(sides, shares, (1, -1), before):
            credit = np.ones(len(i))
            if c.involvement_credit and len(i) > 1:
                u = np.clip((c.involvement_shrink + self.used[i]) / (c.involvement_shrink + self.seen[i]), *c.involvement_clamp)
                credit = u / u.mean()
            now = credit * self._provisional(self.games[i])
            np.add.at(self.rating, i, sign * delta * now)
            if c.roster_shrink and len(i) > 1:
                self.rating[i] += c.roster_shrink * (team - self.rating[i])
            if c.low_info_anchor:
                low = np.maximum(0, 1 - s * len(i))
                self.rating[i] += c.low_info_anchor * low * (start - self.rating[i])
            np.add.at(self.games, i, 1)
            self.base[i] = start
        after = [float(self._shares(i) @ self.rating[i]) for i in sides]
        return chance, *before, *after

    def stats(self, ids: list, usage: list, quality: list, clock: int) -> None:
        c = self.cfg
        i = self.numbers(ids, c.base_rating, clock)
        np.add.at(self.used, i, usage)
        np.add.at(self.seen, i, 1)
        if c.stat_transfer_beta and len(i) > 1:
            q = np.asarray(quality, float)
            t = np.clip(c.stat_transfer_beta * (q - q.mean()), -c.stat_transfer_clamp, c.stat_transfer_clamp)
            np.add.at(self.rating, i, t - t.mean())

    def load(self, rows: pd.DataFrame) -> None:
        for r in rows.itertuples():
            n = self.numbers([r.player], r.base, r.clock)[0]
            self.rating[n], self.games[n], self.used[n], self.seen[n], self.clock[n], self.day[n] = r.rating, r.games, r.used, r.seen, r.clock, r.day

    def table(self, clock: int | None = None) -> pd.DataFrame:
        n = len(self.at)
        if clock is not None and n:
            self.numbers(list(self.at), 0.0, clock)
        cols = {c: getattr(self, c)[:n] for c in ("rating", "games", "base", "used", "seen", "clock", "day")}
        return pd.DataFrame({"player": list(self.at), **cols})


STATE = "player string, rating double, games double, base double, used double, seen double, clock long, day long"
MOVES = "game_key long, event_id long, expected double, home_before double, away_before double, home_after double, away_after double"
POINTS = "subject_kind string, subject string, point_event long, point_rating double, n long, point_club string"
GROUP_ROWS = 50_000
SLICE_DAYS = 7
_LOG = 8


def _names(kinds: str) -> list[str]:
    return [c.split()[0] for c in kinds.split(", ")]


class Replay(NamedTuple):
    """``moves``: chance of the home team and both ratings before and after, per game; ``state``: the players at the end; ``points``: trajectories, or None."""

    moves: DataFrame
    state: DataFrame
    points: DataFrame | None = None


_OUT = f"kind string, {STATE}, {MOVES}, {POINTS}"


class Sides:
    """Rosters of several rows, one after the other: players' numbers and the row each belongs to.

    ``counts`` has for each entry the number of players it stands for, who all
    have the same ratings; without it an entry is one player. Sums over a roster
    count each of them.
    """

    def __init__(self, numbers: np.ndarray, ends: np.ndarray, counts: np.ndarray | None = None):
        self.i, self.start, self.n, self.counts = numbers, ends[:-1], np.diff(ends), counts

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def of(self, which: np.ndarray) -> Sides:
        """Rows that have these rosters, which stay in place however many rows share one; only for ``at`` and ``levels``."""
        out = Sides(self.i, np.zeros(1, dtype=np.int64), self.counts)
        out.start, out.n = self.start[which], self.n[which]
        return out

    @cached_property
    def size(self) -> np.ndarray:
        """The number of players of each row."""
        return self.n if self.counts is None else np.bincount(self.row, self.counts, len(self.n)).astype(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values if self.counts is None else values * self.counts, len(self.n))

    def tops(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, self.start)

    def at(self, rows: np.ndarray) -> Sides:
        n = self.n[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.start[rows] - ends[:-1], n) + np.arange(ends[-1])
        return Sides(self.i[at], ends, None if self.counts is None else self.counts[at])


def mixed(home: Sides, away: Sides, players: int) -> np.ndarray:
    """Whether a player stands on both rosters of a row."""
    last, out = np.full(players, -1, dtype=np.int64), np.empty(len(home.n), dtype=bool)
    (h, h_start, h_end), (a, a_start, a_end) = ((x.i, x.start.tolist(), (x.start + x.n).tolist()) for x in (home, away))
    for row in range(len(out)):
        last[h[h_start[row] : h_end[row]]] = row
        out[row] = (last[a[a_start[row] : a_end[row]]] == row).any()
    return out


def levels(sides: list[Sides], players: int) -> np.ndarray:
    """The level of each row: one more than the highest level of the earlier rows that share a player with it."""
    last, out = np.zeros(players, dtype=np.int64), np.empty(len(sides[0].n), dtype=np.int64)
    cuts = [(x.i, x.start.tolist(), (x.start + x.n).tolist()) for x in sides]
    for row in range(len(out)):
        mine = [i[start[row] : end[row]] for i, start, end in cuts]
        out[row] = level = 1 + max(int(last[i].max()) for i in mine if len(i))
        for i in mine:
            last[i] = level
    return out


class LevelPool(Pool):
    """A pool whose players' numbers are given, advanced by all rows of a level at once; these have no player in common."""

    def __init__(self, cfg: EloConfig, ids: np.ndarray):
        super().__init__(cfg)
        n = len(ids)
        self.at = dict(zip(ids, range(n)))
        self.known = np.zeros(n, dtype=bool)
        self.rating, self.games, self.base = np.zeros(n), np.zeros(n), np.zeros(n)
        self.used, self.seen, self.clock, self.day = np.zeros(n), np.zeros(n), np.zeros(n, int), np.full(n, -1)

    def load(self, rows: pd.DataFrame) -> None:
        i = np.array([self.at[p] for p in rows["player"]], dtype=int)
        for name in ("rating", "games", "base", "used", "seen", "clock", "day"):
            getattr(self, name)[i] = rows[name].to_numpy()
        self.known[i] = True

    def meet(self, s: Sides, start: np.ndarray, clock: np.ndarray, context: bool) -> None:
        """Players of rows with these season clocks; new ones begin at their row's ``start`` or near the team-mates known."""
        known = self.known[s.i]
        if not known.all():
            if context:
                n = s.sums(known)
                mean = s.sums(np.where(known, self.rating[s.i], 0)) / np.maximum(n, 1)
                start = np.where(n > 0, mean - self.cfg.rookie_discount, start)
            new = s.i[~known]
            self.rating[new] = self.base[new] = start[s.row][~known]
            self.clock[new], self.day[new], self.known[new] = clock[s.row][~known], -1, True
        self._season(s.i, clock[s.row])

    def _season(self, i: np.ndarray, clock: np.ndarray) -> None:
        late = clock - self.clock[i]
        if self.cfg.offseason_regression and (late > 0).any():
            keep = (1 - self.cfg.offseason_regression) ** np.maximum(late, 0)
            self.rating[i] = self.base[i] + keep * (self.rating[i] - self.base[i])
        self.clock[i] = np.maximum(self.clock[i], clock)

    def shares(self, s: Sides, rating: np.ndarray) -> np.ndarray:
        if math.isinf(self.cfg.tau):
            return 1 / s.size[s.row]
        w = np.exp((rating - s.tops(rating)[s.row]) / self.cfg.tau)
        return w / s.sums(w)[s.row]

    def strength(self, s: Sides, clock: np.ndarray) -> np.ndarray:
        """Ratings of the teams now; players who are not known count as the base."""
        known = self.known[s.i]
        self._season(s.i[known], clock[s.row][known])
        rating = np.where(known, self.rating[s.i], self.cfg.base_rating)
        return s.sums(self.shares(s, rating) * rating)

    def play(self, home: Sides, away: Sides | None, hs: np.ndarray, as_: np.ndarray, start: np.ndarray, scale: np.ndarray, k: np.ndarray, clock: np.ndarray, day: np.ndarray) -> list[np.ndarray]:
        """Chances of the home teams; both teams' ratings before and after.

        Games whose teams have no player in common go faster with the rosters of
        all home teams and then all away teams as ``home``, and none as ``away``.
        """
        c, n = self.cfg, len(hs)
        sides = (home,) if away is None else (home, away)
        whole = lambda h, a: (np.concatenate([h, a]),) if away is None else (h, a)
        halves = lambda x: [x[0][:n], x[0][n:]] if away is None else x
        starts, clocks = whole(start, start), whole(clock, clock)
        for s, first, now in zip(sides, starts, clocks):
            self.meet(s, first, now, c.context_init)
        if c.inactivity_decay:
            for s, today in zip(sides, whole(day, day)):
                self._rest(s.i, today[s.row])
        shares = [self.shares(s, self.rating[s.i]) for s in sides]
        before = halves([s.sums(w * self.rating[s.i]) for s, w in zip(sides, shares)])
        chance = 1 / (1 + 10 ** ((before[1] - before[0] - c.home_advantage) / scale))
        margin = np.abs(hs - as_)
        mov = np.where((margin > 0) & c.use_mov, np.log1p(margin) / math.log1p(c.mov_norm), 1.0)
        delta = k * mov * ((np.sign(hs - as_) + 1) / 2 - chance)
        for s, w, change, team, first in zip(sides, shares, whole(delta, -delta), whole(*before), starts):
            many = (s.size > 1)[s.row]
            credit = 1.0
            if c.involvement_credit:
                u = np.clip((c.involvement_shrink + self.used[s.i]) / (c.involvement_shrink + self.seen[s.i]), *c.involvement_clamp)
                credit = np.where(many, u * (s.size / s.sums(u))[s.row], 1.0)
            np.add.at(self.rating, s.i, change[s.row] * credit * self._provisional(self.games[s.i]))
            if c.roster_shrink:
                now = self.rating[s.i]
                self.rating[s.i] = np.where(many, now + c.roster_shrink * (team[s.row] - now), now)
            if c.low_info_anchor:
                now = self.rating[s.i]
                self.rating[s.i] = now + c.low_info_anchor * np.maximum(0, 1 - w * s.size[s.row]) * (first[s.row] - now)
            np.add.at(self.games, s.i, 1)
            self.base[s.i] = first[s.row]
        return [chance, *before, *halves([s.sums(self.shares(s, self.rating[s.i]) * self.rating[s.i]) for s in sides])]

    def book_stats(self, s: Sides, usage: np.ndarray, quality: np.ndarray, clock: np.ndarray) -> None:
        c = self.cfg
        self.meet(s, np.full(len(s.n), c.base_rating), clock, False)
        np.add.at(self.used, s.i, usage)
        np.add.at(self.seen, s.i, 1)
        if c.stat_transfer_beta:
            t = np.clip(c.stat_transfer_beta * (quality - (s.sums(quality) / s.size)[s.row]), -c.stat_transfer_clamp, c.stat_transfer_clamp)
            np.add.at(self.rating, s.i, np.where((s.size > 1)[s.row], t - (s.sums(t) / s.size)[s.row], 0.0))


def _whole(ids: np.ndarray) -> np.ndarray | pd.Series:
    """Players as a column that stays exact beside rows that have none."""
    return ids if ids.dtype == object else pd.array(ids, dtype="Int64").astype(object)


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists in one array, and where each list ends."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return (np.concatenate(lists.to_numpy()) if ends[-1] else np.empty(0, dtype=object)), ends


def _rosters(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, list[np.ndarray]]:
    """The players of the different lists in ``home`` and ``away``, where each list ends, the players' counts if there are any, and for each side the number of each row's list; one object is one list."""
    lists = np.concatenate([rows["home"].to_numpy(), rows["away"].to_numpy()])
    _, first, number = np.unique(np.fromiter(map(id, lists), np.int64, len(lists)), return_index=True, return_inverse=True)
    players, ends = _flat(pd.Series(lists[first]))
    counts = None
    if "home_counts" in rows.columns:
        counts = _flat(pd.Series(np.concatenate([rows["home_counts"].to_numpy(), rows["away_counts"].to_numpy()])[first]))[0].astype(float)
    return players, ends, counts, np.split(number, 2)


def _elo(configs: list[dict], points: bool):
    """The fold of one group, level by level; a lane's first value is the number of its configuration."""

    def run(lane: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        cfg = EloConfig(**configs[lane[0] if lane else 0])
        rows = rows.sort_values(["day", "late", "clock_time", "event_id", "game_key"])
        players, ends, counts, lists = _rosters(rows)
        numbers, ids = pd.factorize(players)
        squads = Sides(numbers, ends, counts)
        home, away = (squads.of(x) for x in lists)
        both, n_rows = squads.of(np.concatenate(lists)), len(rows)
        pool = LevelPool(cfg, ids)
        pool.load(state)
        values = {c: rows[c].fillna(0).to_numpy(dtype=np.int64) for c in ("late", "clock", "day", "home_score", "away_score", "event_id", "game_key")}
        divisions, kinds = pd.factorize(rows["division"])  # -1 for stat lines
        pick = lambda table, rest: np.array([*(table.get(d, rest) for d in kinds), rest], dtype=float)[divisions]
        start, scale, k = pick(cfg.division_bases, cfg.base_rating), pick(cfg.division_scale, cfg.scale), cfg.k * pick(cfg.k_scale, 1.0)
        (usage, s_ends), (quality, _) = _flat(rows["usage"]), _flat(rows["quality"])
        usage, quality = usage.astype(float), quality.astype(float)
        clubs, club_names = pd.factorize(pd.concat([rows["home_club"], rows["away_club"]]))
        if points:
            event = rows["stat_event"].fillna(-1).to_numpy(dtype=np.int64)
            seen = _Seen(squads, lists, np.where(values["late"] > 0, event, values["event_id"]))
        level, tied = levels([home, away], len(ids)), mixed(home, away, len(ids))
        order = np.argsort(level, kind="stable")
        cuts = np.flatnonzero(np.diff(level[order], prepend=0, append=np.iinfo(np.int64).max))
        moves, club_points = np.empty((len(rows), 5)), []
        for a, b in zip(cuts, cuts[1:]):
            late = values["late"][order[a:b]] > 0
            g, s = order[a:b][~late], order[a:b][late]
            for apart, g in ((True, g[~tied[g]]), (False, g[tied[g]])):
                if not len(g):
                    continue
                two = np.concatenate([g, g + n_rows])
                sides = (both.at(two), None) if apart else (home.at(g), away.at(g))
                moves[g] = np.stack(pool.play(*sides, values["home_score"][g], values["away_score"][g], start[g], scale[g], k[g], values["clock"][g], values["day"][g]), 1)
                if points:
                    x = sides[0] if apart else both.at(two)
                    seen.game(two, pool.rating[x.i], clubs[two][x.row])
                    club_points.append((clubs[two], np.tile(values["event_id"][g], 2), np.concatenate([2 * g, 2 * g + 1]), x.size, moves[g, 3:].T.ravel()))
            if len(s):
                x, i = home.at(s), np.repeat(s_ends[s] - np.concatenate([[0], np.cumsum(home.n[s])])[:-1], home.n[s]) + np.arange(home.n[s].sum())
                pool.book_stats(x, usage[i], quality[i], values["clock"][s])
                if points and (event[s] >= 0).any():
                    s = s[event[s] >= 0]
                    x = home.at(s)
                    seen.lines(s, pool.rating[x.i], clubs[s][x.row])
                    s = s[away.n[s] > 0]
                    x = away.at(s)
                    club_points.append((clubs[s], event[s], 2 * s, x.size, pool.strength(x, values["clock"][s]) if len(s) else np.empty(0)))
        at = np.flatnonzero(pool.known)
        columns = {"rating": pool.rating, "games": pool.games, "base": pool.base, "used": pool.used, "seen": pool.seen, "clock": pool.clock, "day": pool.day}
        out = [pd.DataFrame({"kind": "state", "player": _whole(ids[at]), **{c: v[at] for c, v in columns.items()}})]
        g = np.flatnonzero(values["late"] == 0)
        out.append(pd.DataFrame({"kind": "move", "game_key": values["game_key"][g], "event_id": values["event_id"][g], **{c: moves[g, i] for i, c in enumerate(_names(MOVES)[2:])}}))
        if points:
            out += _trajectories(seen, club_points, ids, club_names)
        types = {"long": "Int64", "string": "object"}
        full = pd.concat(out, ignore_index=True).reindex(columns=_names(_OUT))
        return full.astype({c.split()[0]: types[c.split()[1]] for c in _OUT.split(", ") if c.split()[1] in types})

    return run


class _Seen:
    """The last rating of each player at each event of a group, and the club there.

    A pair of player and event has one place, whatever the number of its games.
    Rows that share a player come in their order, so what is written last stays.
    """

    def __init__(self, squads: Sides, lists: list[np.ndarray], events: np.ndarray):
        where, self.events = pd.factorize(events)
        n = max(len(self.events), 1)
        units, first = np.unique(np.concatenate(lists) * n + np.tile(where, len(lists)), return_inverse=True)
        flat = squads.of(units // n).at(np.arange(len(units)))
        pairs, self.pairs = pd.factorize(flat.i * n + (units % n)[flat.row])
        self.places = Sides(pairs, np.concatenate([[0], np.cumsum(flat.n)])).of(first)
        n = len(self.pairs)
        self.rating, self.club, self.played, self.booked = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)

    def game(self, rows: np.ndarray, rating: np.ndarray, club: np.ndarray) -> None:
        """Rows by their home rosters, then by their away rosters."""
        at = self.places.at(rows).i
        self.rating[at], self.club[at], self.played[at] = rating, club, True

    def lines(self, rows: np.ndarray, rating: np.ndarray, club: np.ndarray) -> None:
        at = self.places.at(rows).i
        fresh = ~(self.played[at] | self.booked[at])
        self.club[at[fresh]] = club[fresh]
        self.rating[at], self.booked[at] = rating, True

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Players, events, clubs and ratings of the pairs that were met."""
        met = np.flatnonzero(self.played | self.booked)
        n = max(len(self.events), 1)
        return self.pairs[met] // n, self.events[self.pairs[met] % n], self.club[met], self.rating[met]


def _trajectories(seen: _Seen, club_points: list, ids: np.ndarray, clubs: np.ndarray) -> list[pd.DataFrame]:
    """The last rating of a player or club at an event; a player's club is that of the last game there, else of the first stat line."""
    out = []
    who, event, club, rating = seen.table()
    if len(who):
        if ids.dtype == object:  # of numbers the names are not known here
            own = ~pd.Series(ids).str.startswith("ghost:").to_numpy()[who]
            who, event, club, rating = who[own], event[own], club[own], rating[own]
        names = np.append(np.asarray(clubs, dtype=object), None)[club]  # -1 for no club
        out.append(pd.DataFrame({"kind": "point", "subject_kind": "player", "subject": ids.astype(str).astype(object)[who], "point_event": event, "point_rating": rating, "point_club": names}))
    if club_points:
        club, event, at, n, rating = (np.concatenate(v) for v in zip(*club_points))
        t = pd.DataFrame({"club": club, "point_event": event, "at": at, "n": n, "point_rating": rating}).sort_values("at", kind="stable")
        t = t[t["club"] >= 0].drop_duplicates(["club", "point_event"], keep="last")
        names = np.asarray(clubs, dtype=object)[t["club"]]
        out.append(pd.DataFrame({"kind": "point", "subject_kind": "club", "subject": names, "point_event": t["point_event"], "point_rating": t["point_rating"], "n": t["n"], "point_club": names}))
    return out


#: Rows of a counted table of players that a broadcast may have.
_FEW = 2_000_000


def twins(rosters: DataFrame, *alone: DataFrame) -> DataFrame:
    """The players of rosters with the first by name of those who stand on the same rosters, as often on each, and their number: (player_id, player, twin, size).

    Such players have the same ratings throughout, so a replay needs one of them.
    Those of ``alone`` (player), as they have stat lines of their own, are nobody's
    twins. The rosters of a player are told by the sums of 128 bits of their hashes.
    """
    rows = rosters.where("event_team_id is not null and player_id is not null")
    marks = [F.xxhash64("event_team_id"), F.xxhash64(F.lit("twin"), "event_team_id")]
    halves = [F.sum(x) for m in marks for x in (m.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(m, 32))]
    same = rows.groupBy("player_id").agg(F.count("*").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).withColumn("player", F.col("player_id").cast("string"))
    own = F.lit("")
    if alone:
        single = reduce(DataFrame.unionByName, [a.select("player") for a in alone]).distinct().withColumn("single", F.lit(True))
        same, own = same.join(single, "player", "left"), F.when(F.col("single"), F.concat(F.lit("="), "player")).otherwise("")
    key = ["own", "n", *[f"h{i}" for i in range(len(halves))]]
    same = written(same.withColumn("own", own).select("player_id", "player", *key), "marks")
    groups = written(same.groupBy(*key).agg(F.min("player").alias("twin"), F.count("*").alias("size")), "twins")
    groups = F.broadcast(groups) if groups.count() <= _FEW // 10 else groups
    return written(same.join(groups, key).select("player_id", "player", "twin", "size"), "twins")


class Stream(NamedTuple):
    """What replays of the same games read: ``rows`` with keys of rosters, ``lists`` (squad, players, counts), and who stands for whom in them, see ``twins``."""

    rows: DataFrame
    lists: DataFrame
    twins: DataFrame


def prepared(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None, *alone: DataFrame) -> Stream:
    """Games, stat lines and rosters as a replay takes them, written; ``alone`` (player) have no twins, nor has who has stat lines."""
    if stats is not None:
        alone = (*alone, stats.where("player_id is not null").select(F.col("player_id").cast("string").alias("player")))
    who = twins(rosters, *alone)
    rows, lists = keyed(games, rosters, clubs, stats, who)
    return Stream(written(rows, "stream"), written(lists, "lists"), who)


def everyone(rows: DataFrame, who: DataFrame, player: str = "player") -> DataFrame:
    """Rows of players, those of a twin for all for whom it stands."""
    members = who.select(F.col("twin").alias(player), F.col("player").alias("_member"))
    return rows.join(members, player, "left").withColumn(player, F.coalesce("_member", player)).select(*rows.columns)


def stream(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Games with their rosters, and stat lines of a team-event as one late row of its last day, in one table; see ``keyed``."""
    return listed(*keyed(games, rosters, clubs, stats))


def _clocked(rows: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of games with their ``day`` and the latest season so far as ``clock_now``, and the seasons by day."""
    seasons = games.select(F.datediff("date", F.lit("1970-01-01")).cast("long").alias("day"), "season").groupBy("day").agg(F.max("season").alias("m"))  # a row per day
    days = seasons.select("day", F.max("m").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.max("m").over(W.orderBy("day")).alias("upto"))
    w = W.partitionBy("day").orderBy("clock", "event_id", "game_key")
    out = rows.withColumn("day", F.datediff("date", F.lit("1970-01-01")).cast("long")).withColumn("own", F.max("season").over(w))
    return out.join(F.broadcast(days), "day").withColumn("clock_now", F.greatest("own", F.coalesce("before", "own")).cast("long")), days


def listed(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows with the players of ``home`` and ``away`` instead of their keys."""
    columns = rows.columns
    for side in ("home", "away"):
        rows = rows.join(lists.select(F.col("squad").alias(side), F.col("players").alias("_players")), side, "left")
        rows = rows.withColumn(side, F.coalesce("_players", F.array().cast("array<string>"))).drop("_players")
    return rows.select(*columns)


def keyed(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None, who: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Games and stat lines with keys of rosters as ``home`` and ``away``, and the rosters (squad, players).

    With ``who``, as from ``twins``, a roster has each of its twins once, or as
    often as the players stand on it, and ``counts``, the players of each.

    A roster stands once, not in each of its games. A team without one plays as
    one ghost of its club and season. Stat lines of a team-event are one late row
    of its last day; those without a later game are dropped. ``clock`` is the
    latest season so far. A stat row has the players of its lines as ``home`` and
    the roster of its team as ``away``, null without one; stats may name the
    ``event_id`` that earned them.
    """
    key = lambda kind, *c: F.concat(F.lit(f"{kind}:"), *c)
    listed_, of = rosters.where("event_team_id is not null"), ["players"]
    if who is None:
        sides = listed_.groupBy("event_team_id").agg(F.sort_array(F.collect_list(F.col("player_id").cast("string"))).alias("players"))
    else:
        of.append("counts")
        known = who.select("player_id", "twin", "size")
        known = F.broadcast(known) if known.count() <= _FEW else known
        entries = listed_.join(known, "player_id", "left").groupBy("event_team_id", "twin", "size").agg(F.count("*").alias("n"))
        entry = F.when(F.col("twin").isNotNull(), F.struct("twin", "size", (F.col("n") / F.col("size")).cast("int").alias("times")))
        sides = entries.groupBy("event_team_id").agg(F.sort_array(F.collect_list(entry)).alias("x"))
        each = lambda c: F.flatten(F.transform("x", lambda e: F.array_repeat(e[c], e["times"])))
        sides = sides.select("event_team_id", each("twin").alias("players"), each("size").alias("counts"))
    sides = written(sides.select(key("roster", "event_team_id").alias("squad"), *of, "event_team_id"), "rosters")
    lists = [sides.select("squad", *of)]
    ones = lambda players: [F.array_repeat(F.lit(1).cast("long"), F.size(players)).alias("counts")] if who is not None else []
    out = games
    for side in ("home", "away"):
        club = clubs.select(F.col("event_team_id").alias(f"{side}_id"), F.col("club").alias(f"{side}_club"))
        ids = sides.select(F.col("event_team_id").alias(f"{side}_id"), F.col("squad").alias(side))
        ghost = F.concat(F.lit("ghost:"), F.coalesce(f"{side}_club", F.lit("?")), F.lit(":"), F.col("season"))
        out = out.join(ids, f"{side}_id", "left").join(club, f"{side}_id", "left").withColumn(side, F.coalesce(side, ghost))
    out = written(out, "sides")
    ghosts = out.select(F.explode(F.array("home", "away")).alias("squad")).where(F.col("squad").startswith("ghost:")).distinct()
    lists.append(ghosts.select("squad", F.array("squad").alias("players"), *ones(F.array("squad"))))
    out, days = _clocked(out, games)
    none = F.array().cast("array<double>")
    cols = ["event_id", "game_key", "day", "home", "away", "home_score", "away_score", "division", "season", "home_club", "away_club"]
    extra = [F.lit(0).alias("late"), F.col("clock").alias("clock_time"), F.col("clock_now").alias("clock"), none.alias("usage"), none.alias("quality"), F.lit(None).cast("long").alias("stat_event")]
    out = out.select(*cols, *extra)
    if stats is None:
        return out, lists[0].unionByName(lists[1])
    stats = stats if "event_id" in stats.columns else stats.withColumn("event_id", F.lit(None).cast("long"))
    lines = F.sort_array(F.collect_list(F.struct(F.col("player_id").cast("string").alias("p"), "usage", F.col("quality").cast("double").alias("quality"))))
    s = stats.groupBy("event_team_id", "end_date").agg(lines.alias("x"), F.max("event_id").alias("stat_event")).withColumn("day", F.datediff("end_date", F.lit("1970-01-01")).cast("long"))
    # the season clock of a stat row is that of the last game day up to it: both sides are merged in one order of days
    marks = days.select("day", "upto").unionByName(s.select("day", F.lit(None).cast("int").alias("upto")).distinct()).groupBy("day").agg(F.max("upto").alias("upto"))
    marks = marks.select("day", F.last("upto", ignorenulls=True).over(W.orderBy("day")).alias("upto"))  # a row per day
    ends = days.agg(F.max("day").alias("last_day"), F.min(F.struct("day", "upto"))["upto"].alias("first_season"))
    s = s.crossJoin(F.broadcast(ends)).where("day < last_day").join(F.broadcast(marks), "day")  # one row; a row per day
    s = written(s.withColumn("lines", key("lines", "event_team_id", F.lit(":"), F.col("day").cast("string"))), "lines")
    lists.append(s.select(F.col("lines").alias("squad"), F.col("x.p").alias("players"), *ones(F.col("x.p"))))
    s = s.join(sides.drop(*of), "event_team_id", "left").join(clubs.select("event_team_id", F.col("club").alias("home_club")), "event_team_id", "left")
    rows = out.unionByName(
        s.select(
            F.lit(0).cast("long").alias("event_id"), F.xxhash64("event_team_id").alias("game_key"), "day", F.col("lines").alias("home"), F.col("squad").alias("away"),
            F.lit(None).cast("int").alias("home_score"), F.lit(None).cast("int").alias("away_score"), F.lit(None).cast("string").alias("division"), F.lit(None).cast("int").alias("season"),
            "home_club", F.lit(None).cast("string").alias("away_club"), F.lit(1).alias("late"), F.lit("").alias("clock_time"), F.coalesce("upto", "first_season").cast("long").alias("clock"),
            "x.usage", "x.quality", "stat_event",
        )
    )
    return rows, reduce(DataFrame.unionByName, lists)


def _cut(rows: DataFrame) -> DataFrame:
    """Rows with the component of their players."""
    everyone = F.concat("home", "away")
    edges = rows.select(F.get(everyone, 0).alias("a"), F.explode(everyone).alias("b")).distinct()
    comp = components(edges)
    return rows.withColumn("node", F.get(everyone, 0)).join(comp, "node").drop("node")


def _cut_keyed(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The same for rows with keys of rosters: a roster is a node beside its players."""
    node = lambda c: F.xxhash64(F.lit("squad"), c)
    edges = lists.select(node("squad").alias("a"), F.explode("players").alias("b")).unionByName(rows.select(node("home").alias("a"), node(F.coalesce("away", "home")).alias("b")))
    return rows.withColumn("node", node("home")).join(components(edges.distinct()), "node").drop("node")


def slices(days: list[tuple[int, int]], group_rows: int, slice_days: int, plan: str) -> tuple[list[tuple[int, int]], bool]:
    """First and last day of each slice from the rows per day, in order, and whether slices are to be cut into components."""
    if plan == "component":
        return [(days[0][0], days[-1][0])], True
    if plan != "slice":
        raise ValueError(f"unknown plan {plan!r}")
    first, last = days[0][0], days[-1][0]
    if sum(n for _, n in days) * slice_days > group_rows * max(last - first + 1, slice_days):
        return [(d, d + slice_days - 1) for d in range(first, last + 1, slice_days)], True
    out: list[tuple[int, int]] = []
    held = 0
    for day, n in days:
        if not out or held + n > group_rows:
            out.append((day, day))
            held = 0
        out[-1] = (out[-1][0], day)
        held += n
    return out, False


def replayed(rows: DataFrame, fold: Callable, state: str, out: str, lanes: list[str] | None = None, plan: str = "slice", group_rows: int = GROUP_ROWS, slice_days: int = SLICE_DAYS, day: str = "day", lists: DataFrame | None = None) -> DataFrame:
    """All rows that ``fold(lane, rows, state)`` returns for the groups of each slice, with the slice's number, and the last state.

    ``rows`` have ``home``, ``away`` and the columns ``lanes``; ``out`` has the
    columns of ``state`` and a ``kind``, ``state`` for the players' new state.
    In the result a player (of a lane) has one such row, the last one. A slice
    reads and writes the states of its own players only; every _LOG slices the
    states written are reduced to the last one of each player. With ``lists``
    (squad, players) the rows have keys of these as ``home`` and ``away``; a
    group then gets each roster once, as one more row, and its rows share it.
    Lists may have ``counts``, which the rows then get as ``home_counts`` and
    ``away_counts``.
    """
    lanes = lanes or []
    if plan not in ("component", "slice"):
        raise ValueError(f"unknown plan {plan!r}")
    spark = rows.sparkSession
    counts = [(r[0], r[1]) for r in rows.groupBy(day).count().orderBy(day).collect()]  # a row per day
    if lists is None:
        rows, names = numbered(rows, day)
    else:
        rows, lists, names = numbered_lists(rows, lists, day)
    if names is not None:
        state, out = (x.replace("player string", "player long") for x in (state, out))
    lane_kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in lanes)
    kinds = lane_kinds + out
    if not counts:
        return spark.createDataFrame([], kinds.replace("player long", "player string") + ", slice int")
    cuts, search = slices(counts, group_rows, slice_days, plan)
    fields = [*lanes, *_names(state)]
    log = [spark.createDataFrame([], lane_kinds + state + ", slice int")]

    def current(parts: list[DataFrame]) -> DataFrame:
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        last = union.groupBy(*lanes, "player").agg(F.max_by(F.struct(*fields, "slice"), "slice").alias("x"))
        return last.select("x.*")

    def run(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if "players" in part.columns:
            part = _shared(part)
        found = fold(key[:-1], part, known)
        for i, c in enumerate(lanes):
            found[c] = key[i]
        return found[_names(kinds)]

    done = []
    for k, (lo, hi) in enumerate(cuts):
        part = rows if len(cuts) == 1 else rows.where(F.col(day).between(lo, hi))
        mine = None if lists is None else lists.where((F.col("first") <= hi) & (F.col("last") >= lo))
        part = written(_cut(part) if mine is None else _cut_keyed(part, mine), "cut") if search else part.withColumn("component", F.lit(""))
        used = squads(part, *lanes, "component")
        if mine is not None:
            of = [c for c in ("players", "counts") if c in mine.columns]
            used = used.join(mine.select("squad", *of), "squad")
            part = part.withColumns({c: F.lit(None).cast(mine.schema[c].dataType) for c in of}).unionByName(_as_rows(used, part, of))
            used = used.select(*lanes, "component", F.col("players").alias("squad"))
        members = used.select(*lanes, "component", F.explode("squad").alias("player")).distinct()
        key = [*lanes, "component"]
        known = current(log).join(members, [*lanes, "player"]).select(*[F.col(c).alias(f"of_{c}") for c in key], *_names(state))
        found = part.groupBy(*key).cogroup(known.groupBy(*[f"of_{c}" for c in key])).applyInPandas(run, kinds)
        found = written(found.withColumn("slice", F.lit(k)), "slice")
        done.append(found.where("kind <> 'state'"))
        log.append(found.where("kind = 'state'").select(*fields, "slice"))
        if len(log) > _LOG:
            log = [written(current(log), "state")]
    final = current(log).withColumn("kind", F.lit("state"))
    union = final.select(*[F.col(c) if c in final.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in kinds.split(", "))], "slice")
    for part in done:
        union = union.unionByName(part)
    return union if names is None else named(union, names)


def streamed(rows: DataFrame, fold: Callable, state: str, out: str, lanes: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """As ``replayed`` for lanes of few players: a task reads a lane's rows in order, ``group_rows`` at a time, and keeps the state of its players alone."""
    order = ["day", "late", "clock_time", "event_id", "game_key"]
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in lanes) + out
    n_lanes = rows.select(*lanes).distinct().count()
    fields = _names(state)
    types = {c: {"long": "Int64", "string": "object"}[t] for c, t in (x.split(" ") for x in out.split(", ")) if t in ("long", "string")}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, known, held, size = None, None, [], 0

        def played() -> pd.DataFrame:
            nonlocal known, held, size
            rows = pd.concat(held, ignore_index=True)
            here = known["player"].isin(rows["home"].explode()) | known["player"].isin(rows["away"].explode())
            found = fold(lane, rows, known[here])
            new = found.loc[found["kind"] == "state", fields]
            known, held, size = pd.concat([known[~known["player"].isin(new["player"])], new], ignore_index=True), [], 0
            return labelled(found[found["kind"] != "state"])

        def labelled(found: pd.DataFrame) -> pd.DataFrame:
            return found.assign(**dict(zip(lanes, lane)))[_names(kinds)].astype(types)

        def last() -> Iterator[pd.DataFrame]:
            if held:
                yield played()
            if lane is not None:
                yield labelled(known.assign(kind="state").reindex(columns=_names(out)))

        for part in parts:
            for key, group in part.groupby(lanes, sort=False):
                if key != lane:
                    yield from last()
                    lane, known, held, size = key, pd.DataFrame(columns=fields), [], 0
                held.append(group)
                size += len(group)
                if size >= group_rows:
                    yield played()
        yield from last()

    dealt = rows.repartitionByRange(max(2 * n_lanes, 1), *lanes).sortWithinPartitions(*lanes, *order)
    return written(dealt.mapInPandas(run, kinds), "streamed")


_DUELS = f"kind string, {STATE}, {MOVES}"


class Duels:
    """Players who meet one to one, advanced game by game in plain numbers: of few players hardly two games have none in common, so arrays would be nearly empty."""

    def __init__(self, cfg: EloConfig):
        self.cfg, self.at, self.bonus = cfg, {}, []
        self.rating, self.games, self.base, self.clock = [], [], [], []

    def numbers(self, names: pa.Array) -> list[int]:
        """The players' numbers; new ones have no rating before their first game."""
        coded = names.dictionary_encode()
        for name in coded.dictionary.to_pylist():
            if name not in self.at:
                self.at[name] = len(self.at)
                for values, first in ((self.rating, None), (self.games, 0), (self.base, 0.0), (self.clock, 0)):
                    values.append(first)
        return np.array([self.at[n] for n in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()].tolist()

    def _factors(self, n: int) -> list[float]:
        """The provisional factors of a player's first games, as far as the next ``n`` rows can need them."""
        need = max(self.games, default=0) + 2 * n
        if need > len(self.bonus):
            self.bonus = (Pool(self.cfg)._provisional(np.arange(2.0 * need)) * np.ones(2 * need)).tolist()
        return self.bonus

    def play(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """The moves of games in order."""
        c = self.cfg
        home, away = self.numbers(rows["home"]), self.numbers(rows["away"])
        divisions = rows["division"].to_pylist()
        hs, as_ = (rows[x].fill_null(0).to_numpy().astype(np.int64) for x in ("home_score", "away_score"))
        margin = np.abs(hs - as_)
        mov = np.where((margin > 0) & c.use_mov, np.log1p(margin) / math.log1p(c.mov_norm), 1.0)
        k = c.k * np.array([c.k_scale.get(d, 1.0) for d in divisions], dtype=float)
        start, scale = ([float(table.get(d, rest)) for d in divisions] for table, rest in ((c.division_bases, c.base_rating), (c.division_scale, c.scale)))
        rating, games, base, clock, bonus = self.rating, self.games, self.base, self.clock, self._factors(rows.num_rows)
        moves = []
        for h, a, begin, over, weight, won, now in zip(home, away, start, scale, (k * mov).tolist(), ((np.sign(hs - as_) + 1) / 2).tolist(), rows["clock"].to_pylist()):
            for i in (h, a):
                if rating[i] is None:
                    rating[i], clock[i] = begin, now
                elif now > clock[i]:
                    clock[i] = now
            one, two = rating[h], rating[a]
            gap = (two - one - c.home_advantage) / over
            chance = 1 / (1 + 10**gap) if gap < 308 else 0.0
            delta = weight * (won - chance)
            rating[h] += delta * bonus[games[h]]
            games[h] += 1
            rating[a] -= delta * bonus[games[a]]
            games[a] += 1
            base[h] = base[a] = begin
            moves.append((chance, one, two, rating[h], rating[a]))
        values = np.array(moves).T
        return _filled({"kind": ["move"] * rows.num_rows, "game_key": rows["game_key"], "event_id": rows["event_id"], **dict(zip(_names(MOVES)[2:], values))}, rows.num_rows)

    def table(self) -> pa.RecordBatch:
        """The players at the end."""
        n = len(self.at)
        known = {"rating": self.rating, "games": np.array(self.games, dtype=float), "base": self.base, "used": np.zeros(n), "seen": np.zeros(n), "clock": self.clock, "day": np.full(n, -1)}
        return _filled({"kind": ["state"] * n, "player": list(self.at), **known}, n)


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of moves or states; what it does not have is null."""
    types = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    fields = {name: types[kind] for name, kind in (x.split() for x in _DUELS.split(", "))}
    arrays = [pa.nulls(n, t) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in fields.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def dueled(games: DataFrame, clubs: DataFrame, cfg: EloConfig, carry: bool = False) -> DataFrame:
    """The team replay of seasons that begin anew: a task reads a season's games in order and keeps the state of its clubs alone.

    With ``carry`` all games are one season. A team without a club plays as one
    ghost of its season.
    """
    out = games if carry else games.where("season is not null")
    for side in ("home", "away"):
        club = clubs.select(F.col("event_team_id").alias(f"{side}_id"), F.col("club").alias(side))
        name = F.coalesce(side, F.concat_ws(":", F.lit("ghost:?"), F.col("season")))
        out = out.join(club, f"{side}_id", "left").withColumn(side, name if carry else F.concat_ws("#", name, F.col("season")))
    order = ["day", "clock_time", "event_id", "game_key"]
    rows = _clocked(out, games)[0].withColumn("clock_time", F.col("clock"))
    lane = F.lit(0).alias("season") if carry else F.col("season")
    rows = written(rows.select(lane, *order, F.coalesce("clock_now", F.lit(0)).cast("long").alias("clock"), "home", "away", F.col("home_score").cast("long"), F.col("away_score").cast("long"), "division"), "stream")
    n_seasons = rows.select("season").distinct().count()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        season, pool = None, None
        for part in parts:
            seasons = part["season"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(seasons)) + 1).tolist(), len(seasons)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if seasons[a] != season:
                    if pool:
                        yield pool.table()
                    season, pool = seasons[a], Duels(cfg)
                yield pool.play(part.slice(a, b - a))
        if pool:
            yield pool.table()

    dealt = rows.repartitionByRange(max(2 * n_seasons, 1), "season").sortWithinPartitions("season", *order)
    return written(dealt.mapInArrow(run, _DUELS), "dueled")


def squads(rows: DataFrame, *by: str) -> DataFrame:
    """The different lists of players of rows, as ``squad``."""
    return rows.select(*by, F.explode(F.array("home", "away")).alias("squad")).distinct()


def numbered(rows: DataFrame, day: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose players are 64-bit hashes, which reach Python workers many times faster than strings, and the table of names.

    Should two players ever share a hash, rows keep their strings and there is no table.
    """
    names = written(squads(rows).select(F.explode("squad").alias("name")).distinct().select("name", F.xxhash64("name").alias("number")), "names")
    count = names.agg(F.count("*"), F.countDistinct("number")).first()
    if count[0] != count[1]:
        return rows, None
    hashed = rows.withColumns({c: F.transform(c, lambda p: F.xxhash64(p)) for c in ("home", "away")})
    return written(hashed.repartitionByRange(F.col(day)), "numbered"), names  # a slice reads its own files


def numbered_lists(rows: DataFrame, lists: DataFrame, day: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The same for rows with keys of ``lists``, which get the first and the last day of their rows; a slice reads its own files of both."""
    lists = written(lists, "lists")
    names = written(lists.select(F.explode("players").alias("name")).distinct().select("name", F.xxhash64("name").alias("number")), "names")
    count = names.agg(F.count("*"), F.countDistinct("number")).first()
    if count[0] != count[1]:
        names = None
    spans = rows.select(F.explode(F.array("home", "away")).alias("squad"), F.col(day).alias("d")).groupBy("squad").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    more = [c for c in ("counts",) if c in lists.columns]
    players = F.col("players") if names is None else F.transform("players", lambda p: F.xxhash64(p))
    hashed = lists.join(spans, "squad").select("squad", "first", "last", players.alias("players"), *more)
    return written(rows.repartitionByRange(F.col(day)), "numbered"), written(hashed.repartitionByRange("first"), "squads"), names


def _as_rows(used: DataFrame, part: DataFrame, of: list[str]) -> DataFrame:
    """Rosters as rows of a group: the key as ``home``, and numbers that are not null, so that those of the other rows stay whole."""
    own = {"home": F.col("squad")} | {c: F.col(c) for c in used.columns}
    fill = lambda f: F.lit(0 if f.dataType.typeName() in ("long", "integer") else None).cast(f.dataType)
    return used.select(*[own.get(f.name, fill(f)).alias(f.name) for f in part.schema], *of)


def _shared(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a group with their rosters, one object for all rows of a roster."""
    roster = part["players"].notna()
    of = [("players", "")] + [(c, f"_{c}") for c in ("counts",) if c in part.columns]
    lists = {c: dict(zip(part.loc[roster, "home"], part.loc[roster, c])) for c, _ in of}
    part, none = part[~roster].drop(columns=[c for c, _ in of]), np.empty(0, dtype=np.int64)
    for side in ("home", "away"):
        keys = part[side].tolist()
        for c, name in of:
            values = np.empty(len(part), dtype=object)
            for row, key in enumerate(keys):
                values[row] = lists[c].get(key, none)
            part[side + name] = values
    return part


def named(out: DataFrame, names: DataFrame) -> DataFrame:
    """Players' numbers as their names again, in states and in players' trajectories."""
    if "subject" in out.columns:
        who = F.when(F.col("subject_kind") == "player", F.col("subject").try_cast("long")).otherwise(F.col("player"))
    else:
        who = F.col("player")
    rows = out.withColumn("number", who).join(names, "number", "left")
    if "subject" in out.columns:
        rows = rows.withColumn("subject", F.when(F.col("subject_kind") == "player", F.col("name")).otherwise(F.col("subject")))
    return rows.withColumn("player", F.when(F.col("player").isNotNull(), F.col("name"))).select(*out.columns)


def replay_player_elo(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None = None, cfg: EloConfig | None = None, plan: str = "slice", points: bool = False, group_rows: int = GROUP_ROWS, slice_days: int = SLICE_DAYS) -> Replay:
    """For each game the chance of the home team and both ratings before and after; the players' last state; with ``points`` the trajectories.

    games as from ``load_games``; rosters (event_team_id, player_id); clubs
    (event_team_id, club); stats as from ``load_stat_events``. A player listed
    twice on a roster counts twice. A trajectory has the rating of a club or a
    player after its last game of an event, stat lines booked to the event that
    earned them; stat lines without an event move no trajectory. Empty tables
    give empty results.
    """
    cfg = cfg or EloConfig()
    rows, lists, who = prepared(games, rosters, clubs, stats)
    out = replayed(rows, _elo([asdict(cfg)], points), STATE, _OUT, None, plan, group_rows, slice_days, lists=lists)
    last = rows.agg(F.max("clock")).first()[0]
    state = out.where("kind = 'state'").select(*_names(STATE))
    if last is not None:
        late = F.greatest(F.lit(last) - F.col("clock"), F.lit(0))
        state = state.withColumn("rating", F.col("base") + F.pow(F.lit(1 - cfg.offseason_regression), late) * (F.col("rating") - F.col("base"))).withColumn("clock", F.lit(last).cast("long"))
    found = None
    if points:
        found = out.where("kind = 'point' and not (subject_kind = 'player' and subject like 'ghost:%')").groupBy("subject_kind", "subject", "point_event").agg(F.max_by(F.struct("point_rating", "n", "point_club"), "slice").alias("x"))
        found = found.select(F.col("subject_kind").alias("kind"), "subject", F.col("point_event").alias("event_id"), F.col("x.point_rating").alias("rating"), F.col("x.n").alias("n"), F.col("x.point_club").alias("club"))
        found = found.where("kind <> 'player'").unionByName(everyone(found.where("kind = 'player'"), who, "subject"))
    return Replay(out.where("kind = 'move'").select(*_names(MOVES)), everyone(state, who), found)


def replay_team_elo(games: DataFrame, clubs: DataFrame, cfg: EloConfig | None = None, kind: str = "reset", plan: str = "slice") -> Replay:
    """Elo of teams as one-player rosters: a club of a season (``reset``) or a club throughout (``carry``) (R2).

    Clubs of different seasons never meet under ``reset``, so seasons are lanes;
    under ``carry`` there is one. The clubs' state fits a task, so each lane is
    one pass over its games in order, in plain numbers where a team is one club
    and nothing happens between games.
    """
    if kind not in ("reset", "carry"):
        raise ValueError(f"unknown kind {kind!r}")
    cfg = cfg or EloConfig(involvement_credit=False, stat_transfer_beta=0.0, roster_shrink=0.0)
    ids = clubs.select("event_team_id", F.col("club").alias("player_id"))
    cfg = replace(cfg, offseason_regression=0.0) if kind == "reset" else cfg
    several = clubs.where("event_team_id is not null").groupBy("event_team_id").agg(F.count("*").alias("n"), F.count("club").alias("named")).where("n > 1 or named < 1")
    if plan == "slice" and not cfg.inactivity_decay and not cfg.offseason_regression and not several.limit(1).count():
        out = dueled(games, clubs, cfg, kind == "carry")
        state = out.where("kind = 'state'").select(*_names(STATE))
        if kind == "carry":
            last = F.broadcast(state.agg(F.max("clock").alias("last")))  # one row
            state = state.crossJoin(last).withColumn("clock", F.col("last")).drop("last")
        return Replay(out.where("kind = 'move'").select(*_names(MOVES)), state)
    if kind == "carry":
        return replay_player_elo(games, ids, clubs, None, cfg, plan)
    rows = stream(games, ids, clubs, None)
    marked = lambda c: F.transform(c, lambda p: F.concat_ws("#", p, F.col("season")))
    rows = written(rows.withColumns({"home": marked("home"), "away": marked("away"), "lane": F.lit(0)}), "stream")
    if plan == "slice":
        out = streamed(rows, _elo([asdict(cfg)], False), STATE, _OUT, ["lane", "season"])
    else:
        out = replayed(rows, _elo([asdict(cfg)], False), STATE, _OUT, ["lane", "season"], plan)
    return Replay(out.where("kind = 'move'").select(*_names(MOVES)), out.where("kind = 'state'").select(*_names(STATE)))


# Glicko-2 ----------------------------------------------------------------------------

SCALE, CENTRE = 173.7178, 1500.0


def new_volatility(phi: np.ndarray, sigma: np.ndarray, v: np.ndarray, delta: np.ndarray, tau: float = 0.5, close: float = 1e-6) -> np.ndarray:
    """The volatility that solves the published equation, for arrays of players, by bisection of its bracket."""
    a = np.log(sigma**2)

    def f(x: np.ndarray) -> np.ndarray:
        e = np.exp(x)
        return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / tau**2

    gap = delta**2 - phi**2 - v
    high = np.where(gap > 0, np.log(np.maximum(gap, 1e-300)), a)
    low = np.where(gap > 0, a, a - tau)  # the solution lies between low and high
    while (down := (gap <= 0) & (f(low) < 0)).any():
        low = np.where(down, low - tau, low)
    lo, hi = np.minimum(low, high), np.maximum(low, high)
    sign = np.sign(f(lo))
    while (hi - lo).max(initial=0) > close / 100:
        mid = (lo + hi) / 2
        same = np.sign(f(mid)) == sign
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
    return np.exp((lo + hi) / 4)


def _updated(rating: np.ndarray, rd: np.ndarray, sigma: np.ndarray, results: np.ndarray, tau: float = 0.5, close: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Players after a period; a row of results is (player's number, rival's rating and deviation, score, weight)."""
    i = results[:, 0].astype(int)
    mu, phi = (rating - CENTRE) / SCALE, rd / SCALE
    g = 1 / np.sqrt(1 + 3 * (results[:, 2] / SCALE) ** 2 / np.pi**2)
    e = 1 / (1 + np.exp(-g * (mu[i] - (results[:, 1] - CENTRE) / SCALE)))
    info = np.bincount(i, results[:, 4] * g * g * e * (1 - e), len(rating))
    rest = np.bincount(i, results[:, 4] * g * (results[:, 3] - e), len(rating))
    info = np.maximum(info, 1e-12)
    s = new_volatility(phi, sigma, 1 / info, rest / info, tau, close)
    phi = 1 / np.sqrt(1 / (phi * phi + s * s) + info)
    return CENTRE + SCALE * (mu + phi * phi * rest), SCALE * phi, s


def glicko_update(rating: float, rd: float, sigma: float, rivals: list[tuple[float, float, float, float]]) -> tuple[float, float, float]:
    """One player after a period of (rating, rd, score, weight) results."""
    out = _updated(np.array([rating]), np.array([rd]), np.array([sigma]), np.array([(0, *r) for r in rivals], float))
    return tuple(float(x[0]) for x in out)


@dataclass
class GlickoConfig:
    """The published options by their published names, with their published values (fixed values)."""

    base_rating: float = 1500.0
    division_bases: dict = field(default_factory=lambda: dict(vocab.DIVISION_BASES))
    initial_rd: float = 350.0
    initial_volatility: float = 0.06
    tau: float = 0.5
    convergence: float = 1e-6
    rating_period_days: float = 30.0
    team_weight_tau: float = 500.0
    involvement_credit: bool = True
    involvement_shrink: float = 1.0
    involvement_clamp: tuple = (0.25, 3.0)


GLICKO_STATE = "player string, rating double, rd double, volatility double, games long, last_day long, used double, seen double"
PREDICTED = "game_key long, event_id long, expected double"
_GLICKO = f"kind string, {GLICKO_STATE}, {PREDICTED}"


def _glicko(cfg: GlickoConfig):
    """The fold of one group: rating periods without a common player are one step."""

    def run(lane: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["day", "late", "clock_time", "event_id", "game_key"])
        rows = rows.iloc[np.argsort(pd.factorize(rows["period"])[0], kind="stable")]
        period = pd.factorize(rows["period"])[0]
        first = np.flatnonzero(np.diff(period, prepend=-1))
        players, ends, counts, lists = _rosters(rows)
        numbers, ids = pd.factorize(players)
        squads, every, n = Sides(numbers, ends, counts), np.arange(len(rows)), len(ids)
        home, away = (squads.of(x).at(every) for x in lists)
        rating, rd, sigma = np.full(n, cfg.base_rating), np.full(n, cfg.initial_rd), np.full(n, cfg.initial_volatility)
        games, last, used, seen = np.zeros(n), np.full(n, np.nan), np.zeros(n), np.zeros(n)
        met = np.zeros(n, dtype=bool)
        at = pd.Index(ids).get_indexer(known["player"])
        for to, name in ((rating, "rating"), (rd, "rd"), (sigma, "volatility"), (games, "games"), (last, "last_day"), (used, "used"), (seen, "seen")):
            to[at] = known[name].astype(float)
        met[at] = True
        game_day = rows["game_day"].fillna(0).to_numpy(dtype=np.int64)
        opens, closes = (f.reduceat(game_day, first)[period] for f in (np.minimum, np.maximum)) if len(rows) else (game_day, game_day)
        base = np.array([cfg.division_bases.get(d, cfg.base_rating) for d in rows["division"].iloc[first]])[period] if len(rows) else np.empty(0)
        late = rows["late"].to_numpy() > 0
        usage, won = _flat(rows["usage"])[0].astype(float), (np.sign(rows["home_score"].fillna(0) - rows["away_score"].fillna(0)).to_numpy(dtype=float) + 1) / 2
        s_ends = np.concatenate([[0], np.cumsum(np.where(late, home.n, 0))])
        ends = np.append(first, len(rows))
        whole = [Sides(x.i, np.append(x.start, len(x.i))[ends]) for x in (home, away)]
        level = levels(whole, n)[period] if len(rows) else period
        order = np.argsort(level, kind="stable")
        cuts = np.flatnonzero(np.diff(level[order], prepend=0, append=np.iinfo(np.int64).max))
        chance = np.empty(len(rows))
        for a, b in zip(cuts, cuts[1:]):
            g, lines = order[a:b][~late[order[a:b]]], order[a:b][late[order[a:b]]]
            if len(lines):
                x = home.at(lines)
                np.add.at(used, x.i, usage[np.repeat(s_ends[lines] - np.cumsum(x.n) + x.n, x.n) + np.arange(len(x.i))])
                np.add.at(seen, x.i, 1)
                met[x.i] = True
            if not len(g):
                continue
            sides = home.at(g), away.at(g)
            for x in sides:
                fresh = ~met[x.i]
                rating[x.i[fresh]] = base[g][x.row][fresh]
            for x in sides:
                met[x.i] = True
            opening, credit = [], []
            phi = np.zeros(n)
            for x in sides:
                idle = np.maximum(1, np.maximum(0, opens[g][x.row] - last[x.i]) / cfg.rating_period_days)
                phi[x.i] = np.sqrt((rd[x.i] / SCALE) ** 2 + sigma[x.i] ** 2 * (np.where(np.isnan(last[x.i]), 1.0, idle) - 1))
            for x in sides:
                w = np.exp((rating[x.i] - x.tops(rating[x.i])[x.row]) / cfg.team_weight_tau)
                w /= x.sums(w)[x.row]
                opening.append((x.sums(w * rating[x.i]), SCALE * np.sqrt(x.sums((w * np.hypot(phi[x.i], sigma[x.i])) ** 2))))
                u = np.clip((cfg.involvement_shrink + used[x.i]) / (cfg.involvement_shrink + seen[x.i]), *cfg.involvement_clamp) if cfg.involvement_credit else np.ones(len(x.i))
                credit.append(u * (x.size / x.sums(u))[x.row])
            both = np.hypot(opening[0][1], opening[1][1]) / SCALE
            chance[g] = 1 / (1 + np.exp(-(opening[0][0] - opening[1][0]) / SCALE / np.sqrt(1 + 3 * both * both / math.pi**2)))
            results = [
                np.stack([x.i, rival[0][x.row], rival[1][x.row], score[x.row], c], 1)
                for x, rival, score, c in zip(sides, opening[::-1], (won[g], 1 - won[g]), credit)
            ]
            flat = np.concatenate(results)
            who, flat[:, 0] = np.unique(flat[:, 0].astype(int), return_inverse=True)
            rating[who], rd[who], sigma[who] = _updated(rating[who], phi[who] * SCALE, sigma[who], flat, cfg.tau, cfg.convergence)
            games[who] += np.bincount(flat[:, 0].astype(int))
            for x in sides:
                last[x.i] = closes[g][x.row]
        i, m = np.flatnonzero(met), np.flatnonzero(~late)
        state = pd.DataFrame({"kind": "state", "player": _whole(ids[i]), "rating": rating[i], "rd": rd[i], "volatility": sigma[i], "games": games[i], "last_day": last[i], "used": used[i], "seen": seen[i]})
        moves = pd.DataFrame({"kind": "move", "game_key": rows["game_key"].to_numpy()[m], "event_id": rows["event_id"].to_numpy()[m], "expected": chance[m]})
        types = {"long": "Int64", "string": "object"}
        full = pd.concat([state, moves], ignore_index=True).reindex(columns=_names(_GLICKO))
        return full.astype({c.split()[0]: types[c.split()[1]] for c in _GLICKO.split(", ") if c.split()[1] in types})

    return run


def replay_glicko2(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None = None, cfg: GlickoConfig | None = None, period: str = "day", plan: str = "slice", group_rows: int = GROUP_ROWS, slice_days: int = SLICE_DAYS) -> Replay:
    """Predictions and last state of Glicko-2 with rating periods of a game, an event's day or a tournament.

    All games of a period are predicted from its opening values; then each
    player is updated once, results weighted by the player's usage. A period
    stands where its first game stands; stat lines count from the first period
    that starts after their day. Deviations grow with the days since the last
    period, and up to the last game of all at the end.
    """
    keys = {"game": ["event_id", "game_key"], "day": ["event_id", "day"], "tournament": ["event_id"]}
    if period not in keys:
        raise ValueError(f"unknown period {period!r}")
    cfg = cfg or GlickoConfig()
    rows, lists, who = prepared(games, rosters, clubs, stats)
    name = F.when(F.col("late") == 1, F.concat_ws(":", F.lit("stat"), "game_key", "day")).otherwise(F.concat_ws(":", *keys[period]))
    rows = rows.withColumn("period", name)
    first = W.partitionBy("period")  # the games of one event at most
    rows = written(rows.withColumn("game_day", F.col("day")).withColumn("start", F.min("day").over(first)), "glicko")
    out = replayed(rows, _glicko(cfg), GLICKO_STATE, _GLICKO, None, plan, group_rows, slice_days, "start", lists)
    last_day = rows.where("late = 0").agg(F.max("day")).first()[0]
    idle = F.greatest(F.lit(last_day) - F.col("last_day"), F.lit(0)) / cfg.rating_period_days
    state = out.where("kind = 'state' and last_day is not null")
    state = state.withColumn("rd", SCALE * F.sqrt(F.pow(F.col("rd") / SCALE, 2) + F.col("volatility") * F.col("volatility") * idle))
    return Replay(out.where("kind = 'move'").select(*_names(PREDICTED)), everyone(state.select("player", "rating", "rd", "volatility", "games"), who))


# batch ratings -----------------------------------------------------------------------


def settled(step: np.ndarray, lift: np.ndarray, x: np.ndarray, tolerance: float, most: int = 2000, plain: int = 32) -> np.ndarray:
    """What iterating x -> step x + lift gives once a move is below ``tolerance``, after ``most`` moves at the latest.

    Moves never grow, as rows of ``step`` sum to one at most. So after some
    plain moves the number of those still needed is found by doubling: powers of
    the map take 2, 4, 8 and more moves at once. Pairs that have met nobody else
    swing for ever and need all ``most`` of them.
    """
    for k in range(min(plain, most)):
        new = step @ x + lift
        moved, x = np.abs(new - x).max(initial=0), new
        if moved < tolerance:
            return x
    left = most - plain
    if left <= 0:
        return x
    powers = [(step, lift)]
    while 2 ** len(powers) < left:
        p, q = powers[-1]
        powers.append((p @ p, p @ q + q))
    move = step @ x + lift - x  # the move to come
    if np.abs(move).max(initial=0) < tolerance:
        return x + move
    done = 0
    for j in range(len(powers) - 1, -1, -1):
        p, q = powers[j]
        later = p @ move
        if done + 2**j <= left - 2 and np.abs(later).max(initial=0) >= tolerance:
            x, move, done = p @ x + q, later, done + 2**j
    for _ in range(min(2, left - done)):
        x = step @ x + lift
    return x


class _Season:
    """The games of one division and season, prepared for the batch rating."""

    def __init__(self, pdf: pd.DataFrame, base: float):
        pdf = pdf.sort_values(["date", "clock", "event_id", "game_key"])
        self.teams, ids = np.unique(pdf[["home_club", "away_club"]].to_numpy().ravel(), return_inverse=True)
        self.h, self.a = ids.reshape(-1, 2).T
        hs, as_ = pdf["home_score"].to_numpy(), pdf["away_score"].to_numpy()
        self.w, self.l, self.sign = np.maximum(hs, as_), np.minimum(hs, as_), np.sign(hs - as_)
        day = pd.to_datetime(pdf["date"])
        week = (day - day.min()).dt.days.to_numpy() // 7
        share = np.minimum(1, 2 * (1 - self.l / np.maximum(self.w - 1, 1)))
        x = np.where(self.w == self.l, 0, 125 + 475 * np.sin(share * 0.4 * np.pi) / np.sin(0.4 * np.pi))
        self.x = x * self.sign
        self.weight = np.sqrt(np.minimum(1, (self.w + np.maximum(self.l, (self.w - 1) // 2)) / 19)) * 2.0 ** (week / max(week.max(), 1))
        self.days, self.base, self.keys = day.to_numpy(), base, pdf["game_key"].to_numpy()

    def rate(self, n: int, rating: np.ndarray, tolerance: float) -> np.ndarray:
        """Ratings from the first ``n`` games, from ``rating`` on: the set of blowouts left out and the ratings are found in turn."""
        h, a, x, size = self.h[:n], self.a[:n], self.x[:n], len(self.teams)
        out = np.zeros(n, bool)
        for _ in range(10):
            use = np.where(out, 0, self.weight[:n])
            total = np.bincount(h, use, size) + np.bincount(a, use, size)
            share = np.divide(use, total[h], out=np.zeros(n), where=total[h] > 0), np.divide(use, total[a], out=np.zeros(n), where=total[a] > 0)
            step, lift = np.zeros((size, size)), np.where(total > 0, 0.0, self.base)
            for t, rival, w, sign in ((h, a, share[0], 1), (a, h, share[1], -1)):
                np.add.at(step, (t, rival), w)
                np.add.at(lift, t, sign * w * x)
            rating = settled(step, lift, rating, tolerance)
            gap = (rating[h] - rating[a]) * self.sign[:n]
            top = np.where(self.sign[:n] > 0, h, a)
            low = np.where(self.sign[:n] > 0, a, h)
            kept, now = np.bincount(np.r_[h, a], minlength=size), np.zeros(n, bool)
            far = np.flatnonzero((self.sign[:n] != 0) & (gap > 600) & (self.w[:n] > 2 * self.l[:n] + 1))
            for g in far[np.lexsort((-far, -gap[far]))]:
                if kept[top[g]] > 5:
                    now[g] = True
                    kept[top[g]] -= 1
                    kept[low[g]] -= 1
            if (now == out).all():
                break
            out = now
        return rating


def _by_season(games: DataFrame, clubs: DataFrame) -> DataFrame:
    rows = games
    for side in ("home", "away"):
        rows = rows.join(clubs.select(F.col("event_team_id").alias(f"{side}_id"), F.col("club").alias(f"{side}_club")), f"{side}_id")
    cols = ["division", "season", "date", "clock", "event_id", "game_key", "home_club", "away_club", "home_score", "away_score"]
    return rows.where("home_club <> away_club").select(*cols)


def rate_teams_batch(games: DataFrame, clubs: DataFrame, base: float = 1000.0, tolerance: float = 0.05) -> DataFrame:
    """Team ratings of each (division, season) at which every team equals the weighted mean of opponent rating plus score difference.

    Blowouts between teams far apart are left out, the largest gap first, while
    the winner keeps five results. A group is one division's season.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        season = _Season(pdf, base)
        rating = season.rate(len(season.h), np.full(len(season.teams), base), tolerance)
        return pd.DataFrame({"division": pdf["division"].iloc[0], "season": pdf["season"].iloc[0], "club": season.teams, "rating": rating})

    return _by_season(games, clubs).groupBy("division", "season").applyInPandas(run, "division string, season int, club string, rating double")


def walk_forward(games: DataFrame, clubs: DataFrame, base: float = 1000.0, tolerance: float = 0.05) -> DataFrame:
    """Rating difference before each game from the games of strictly earlier days of its season, each day's ratings beginning with the last day's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        season, out = _Season(pdf, base), np.zeros(len(pdf))
        rating, at = np.full(len(season.teams), base), 0
        while at < len(out):
            end = int(np.searchsorted(season.days, season.days[at], side="right"))
            out[at:end] = rating[season.h[at:end]] - rating[season.a[at:end]]
            rating, at = season.rate(end, rating, tolerance), end
        return pd.DataFrame({"division": pdf["division"].iloc[0], "season": pdf["season"].iloc[0], "game_key": season.keys, "diff": out, "outcome": (season.sign + 1) / 2})

    return _by_season(games, clubs).groupBy("division", "season").applyInPandas(run, "division string, season int, game_key long, diff double, outcome double")


def fit_scale(diffs: DataFrame) -> DataFrame:
    """The logistic scale with the least log-loss of (diff, outcome), by a coarse and then a fine grid; one row."""
    spark = diffs.sparkSession

    def best(grid: DataFrame) -> DataFrame:
        p = 1 / (1 + F.pow(F.lit(10.0), -F.col("diff") / F.col("s")))
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        loss = -(F.col("outcome") * F.log(p) + (1 - F.col("outcome")) * F.log(1 - p))
        return diffs.crossJoin(F.broadcast(grid)).groupBy("s").agg(F.avg(loss).alias("loss")).agg(F.min(F.struct(F.round("loss", 12).alias("loss"), "s")).alias("b")).select("b.s", "b.loss")  # at most 59 rows of grid

    coarse = best(spark.range(50, 1501, 25).select(F.col("id").cast("double").alias("s"))).first()
    if coarse is None or coarse["s"] is None:
        return spark.createDataFrame([], "scale double, loss double")
    fine = [max(30.0, coarse["s"] + d) for d in range(-24, 25, 5)] + [coarse["s"]]
    return best(spark.createDataFrame([(x,) for x in sorted(set(fine))], "s double")).select(F.col("s").alias("scale"), "loss")


def _outcomes(games: DataFrame) -> DataFrame:
    cols = ["game_key", "event_id", "season", "division", "date"]
    return games.select(*cols, outcome(F.col("home_score"), F.col("away_score")).alias("outcome"))


def sweep_predictions(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None, configs: list[EloConfig], plan: str = "slice", ready: Stream | None = None) -> DataFrame:
    """Predictions (config, game_key, event_id, season, division, date, expected, outcome) of each configuration, the lanes of one replay; ``ready`` is the corpus as from ``prepared``."""
    rows, lists, _ = ready or prepared(games, rosters, clubs, stats)
    grid = rows.sparkSession.createDataFrame([(i,) for i in range(len(configs))], "config int")
    rows = written(rows.crossJoin(F.broadcast(grid)), "sweep")  # one row per configuration
    out = replayed(rows, _elo([asdict(c) for c in configs], False), STATE, _OUT, ["config"], plan, GROUP_ROWS * max(1, len(configs)), lists=lists)
    moves = out.where("kind = 'move'").select("config", "game_key", "event_id", "expected")
    return written(moves.join(_outcomes(games), ["game_key", "event_id"]), "predicted")


def sweep(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None, configs: list[EloConfig], plan: str = "slice") -> DataFrame:
    """Log-loss, accuracy and Brier score of each configuration."""
    return scores(sweep_predictions(games, rosters, clubs, stats, configs, plan), ["config"])


def descend(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None, axes: list[tuple[str, list]], seasons: tuple[int, int], cfg: EloConfig | None = None, passes: int = 3, prune_eps: float = 3e-4, store: str | None = None) -> tuple[EloConfig, list[tuple[str, object, float]]]:
    """The configuration that coordinate descent finds, and its moves (axis, value, gain).

    Each axis takes the value with the least log-loss, weighted by games over
    divisions, in the given seasons, while that gains something; moves whose
    reversal costs no more than ``prune_eps`` are taken back, the smallest gain
    first. All values of an axis are lanes of one replay. A configuration is
    replayed once: its loss is kept under the hash of its options and of
    ``seasons``, and with ``store``, a folder for the same tables, a descent that was
    broken off finds there what it has tried.
    """
    start = cfg or EloConfig()
    spark = games.sparkSession
    known: dict[str, float] = {}
    ready: list[Stream] = []
    if store is not None:
        try:
            known = {r["trial"]: r["loss"] for r in spark.read.schema("trial string, loss double").parquet(store).collect()}  # a row per configuration
        except AnalysisException:  # nothing has been tried
            pass

    def trial(c: EloConfig) -> str:
        return hashlib.sha256(json.dumps([asdict(c), seasons], sort_keys=True, default=list).encode()).hexdigest()

    def losses(configs: list[EloConfig]) -> list[float]:
        new = {trial(c): c for c in configs if trial(c) not in known}
        if new:
            tried = dict(zip(new, replayed_losses(list(new.values()))))
            known.update(tried)
            if store is not None:
                spark.createDataFrame(list(tried.items()), "trial string, loss double").coalesce(1).write.mode("append").parquet(store)
        return [known[trial(c)] for c in configs]

    def replayed_losses(configs: list[EloConfig]) -> list[float]:
        if not ready:
            ready.append(prepared(games, rosters, clubs, stats))
        pred = sweep_predictions(games, rosters, clubs, stats, configs, ready=ready[0]).where(F.col("season").between(*seasons))
        per = scores(pred, ["config", "division"]).groupBy("config").agg((F.sum(F.col("n") * F.col("log_loss")) / F.sum("n")).alias("loss"))
        found = {r["config"]: r["loss"] for r in per.collect()}  # one row per configuration
        return [found.get(i, math.inf) for i in range(len(configs))]

    moved: dict[str, object] = {}
    history: list[tuple[str, object, float]] = []
    for _ in range(passes):
        gained = False
        for axis, values in axes:
            now = replace(start, **moved)
            here, *tried = losses([now, *(replace(now, **{axis: v}) for v in values)])
            best = min(range(len(values)), key=tried.__getitem__)
            if here - tried[best] > 1e-6:
                moved[axis] = values[best]
                history.append((axis, values[best], here - tried[best]))
                gained = True
        if not gained:
            break
    full = losses([replace(start, **moved)])[0] if moved else 0.0
    for axis, _, _ in sorted(history, key=lambda m: m[2]):
        if axis in moved:
            less = {k: v for k, v in moved.items() if k != axis}
            loss = losses([replace(start, **less)])[0]
            if loss - full <= prune_eps:
                moved, full = less, loss
    return replace(start, **moved), history


def decay_grid(games: DataFrame, rosters: DataFrame, clubs: DataFrame, regression: list[float], decay: list[float], grace: list[int]) -> DataFrame:
    """Scores of all combinations of the three kinds of decay."""
    grid = [(r, d, g) for r in regression for d in decay for g in grace]
    out = sweep(games, rosters, clubs, None, [EloConfig(offseason_regression=r, inactivity_decay=d, inactivity_grace_days=g) for r, d, g in grid])
    names = games.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(grid)], "config int, regression double, decay double, grace int")
    return out.join(F.broadcast(names), "config").drop("config")  # one row per combination


def period_comparison(games: DataFrame, rosters: DataFrame, clubs: DataFrame) -> DataFrame:
    """Glicko-2's scores by the length of its rating period."""
    parts = [replay_glicko2(games, rosters, clubs, period=p).moves.withColumn("period", F.lit(p)) for p in ("game", "day", "tournament")]
    return scores(parts[0].unionByName(parts[1]).unionByName(parts[2]).join(_outcomes(games), ["game_key", "event_id"]), ["period"])


class Corpus(NamedTuple):
    """What a replay needs."""

    games: DataFrame
    rosters: DataFrame
    clubs: DataFrame
    stats: DataFrame | None


def compare_models(corpus: Corpus, pro_stats: DataFrame | None = None, pro: Corpus | None = None, seasons: tuple[int, int] = (2024, 2025), divisions: tuple[str, ...] = ("club-men",)) -> DataFrame:
    """Scores of nine variants of the model on some seasons and divisions, and of their early season and college games.

    The variants are the published model, plain means without and with usage
    credit, stat transfer and both, both with the stat lines and then the games
    of professional teams too, and team Elo by season and throughout. ``slice``
    is 'all', 'through July' (months up to 7) or 'college'.
    """
    plain = EloConfig(tau=math.inf, involvement_credit=False, stat_transfer_beta=0.0)
    both = replace(plain, involvement_credit=True, stat_transfer_beta=1.0)
    kinds = {
        "player (weighted)": EloConfig(), "player (plain mean)": plain, "plain + inv credit": replace(plain, involvement_credit=True),
        "plain + stat transfer": replace(plain, stat_transfer_beta=1.0), "plain + both": both,
    }
    pred = sweep_predictions(*corpus, list(kinds.values()))
    label = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("config") + 1)
    parts = [pred.withColumn("model", label)]

    def one(c: Corpus, cfg: EloConfig, name: str) -> None:
        parts.append(sweep_predictions(*c, [cfg]).withColumn("model", F.lit(name)))

    if pro_stats is not None:
        lines = corpus.stats.unionByName(pro_stats, allowMissingColumns=True) if corpus.stats is not None else pro_stats
        one(corpus._replace(stats=lines), both, "plain + both + pro")
        if pro is not None:
            one(Corpus(corpus.games.unionByName(pro.games), corpus.rosters.unionByName(pro.rosters), corpus.clubs.unionByName(pro.clubs), lines), both, "plain + both + pro + games")
    for kind, name in (("reset", "team reset"), ("carry", "team carryover")):
        moves = replay_team_elo(corpus.games, corpus.clubs, kind=kind).moves.select("game_key", "event_id", "expected")
        parts.append(moves.join(_outcomes(corpus.games), ["game_key", "event_id"]).withColumn("model", F.lit(name)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    scored = union.where(F.col("season").between(*seasons))
    club = scored.where(F.col("division").isin(*divisions))
    player = ~F.col("model").startswith("team")
    sliced = club.withColumn("slice", F.lit("all")).unionByName(club.where((F.month("date") <= 7) & player).withColumn("slice", F.lit("through July")))
    sliced = sliced.unionByName(scored.where((F.col("division") == "college") & player).withColumn("slice", F.lit("college")))
    return scores(sliced, ["model", "slice"])


def leave_one_out(games: DataFrame, rosters: DataFrame, clubs: DataFrame, targets: DataFrame, cfg: EloConfig | None = None, plan: str = "slice") -> DataFrame:
    """How the mean log-loss of a player's games changes without the player (R8). targets: (player).

    The replay without a target is a lane; a roster of the target alone stays.
    """
    targets = written(targets.select("player").distinct(), "targets")
    rows, lists, _ = prepared(games, rosters, clubs, None, targets)
    settings = [asdict(cfg or EloConfig())]
    theirs = lists.select("squad", F.explode("players").alias("player")).join(targets, "player").distinct()
    mine = rows.select("game_key", "event_id", F.explode(F.array("home", "away")).alias("squad"))
    mine = written(mine.join(theirs, "squad").select("game_key", "event_id", "player").distinct(), "mine")
    whole = replayed(rows, _elo(settings, False), STATE, _OUT, None, plan, lists=lists).where("kind = 'move'")
    entry = F.filter(F.arrays_zip("players", "counts"), lambda e: e["players"] != F.col("target"))
    name = F.concat_ws("|", F.length("squad").cast("string"), "squad", "target")
    left = lists.join(theirs.withColumnRenamed("player", "target"), "squad").select("squad", "target", name.alias("name"), entry.alias("x")).where("size(x) > 0")
    left = written(left.select("squad", "target", "name", F.col("x.players").alias("players"), F.col("x.counts").alias("counts")), "left")
    less = rows.crossJoin(targets.select(F.col("player").alias("target"), F.lit(0).alias("lane")))  # every target replays the whole history
    for side in ("home", "away"):
        less = less.join(left.select(F.col("squad").alias(side), "target", F.col("name").alias("_name")), [side, "target"], "left").withColumn(side, F.coalesce("_name", side)).drop("_name")
    lists = lists.unionByName(left.select(F.col("name").alias("squad"), "players", "counts"))
    without = replayed(written(less, "without"), _elo(settings, False), STATE, _OUT, ["lane", "target"], plan, 20 * GROUP_ROWS, lists=lists).where("kind = 'move'")
    key = ["player", "game_key", "event_id"]
    both = mine.join(whole.select("game_key", "event_id", F.col("expected").alias("full")), ["game_key", "event_id"])
    both = both.join(without.select(F.col("target").alias("player"), "game_key", "event_id", F.col("expected").alias("less")), key)
    both = both.join(_outcomes(games), ["game_key", "event_id"])
    loss = lambda c: -(F.col("outcome") * F.log(F.greatest(c, F.lit(1e-12))) + (1 - F.col("outcome")) * F.log(F.greatest(1 - F.col(c), F.lit(1e-12))))
    return both.groupBy("player").agg(F.avg(loss("less") - loss("full")).alias("loo"), F.count("*").alias("n_games"))
