"""Batch ratings of players: the fixed point of a sparse linear map, solved by joins.

A player's rating is the weighted mean of the game ratings that the player's
team-events earned, and of a prior; a team-event's strength is the weighted mean
of its players. Ratings, strengths and earnings are tables; one step of the map
is a join and a sum for each of them:

    strength(t) = sum over players p of t:      share(t, p) * rating(p)
    earned(t)   = sum over games g of t:        w(g) * (strength(rival) + x(g, t))
    rating(p)   = (prior * 1000 + sum over t: credit(t, p) * earned(t)) / (prior + sum over t: credit(t, p) * w(t))

With a positive prior the map contracts. Steps are combined by Anderson mixing
of the last few (a least-squares problem of a few numbers per cutoff), so some
tens of steps do where plain iteration takes hundreds. Cutoffs are lanes of one
solve. Blowouts that may be left out are decided in parallel rounds that give
what deciding them one by one, largest gap first, would give.
"""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.functions.measures import game_x, half_life, score_weight
from rosterlake.operators.graph import written
from rosterlake.operators.ratings import _FEW as FEW
from rosterlake.operators.ratings import everyone, twins

#: The mean, the gap of a blowout, results that its winner keeps, pseudo-events of usage and its bounds.
BASE = 1000.0
BLOWOUT_GAP = 600.0
MIN_KEPT = 5
SHRINK = 4.0
CLAMP = (0.25, 3.0)
#: Steps that are mixed, and steps at most in one solve.
MEMORY = 5
STEPS = 400
ROUNDS = 6


def window_games(games: DataFrame, cutoffs: list[datetime.date], half: float = 126.0, window: int = 730) -> DataFrame:
    """Rows (lane, game_key, event_id, home, away, ...) of the games of the last ``window`` days before each cutoff, with their weight ``w``.

    A lane is a cutoff's number. Games without a date are in none.
    """
    lanes = F.explode(F.array(*[F.struct(F.lit(i).alias("lane"), F.lit(c).cast("date").alias("cutoff")) for i, c in enumerate(cutoffs)]))
    h, a = F.col("home_score"), F.col("away_score")
    age = F.datediff("cutoff", "date")
    rows = games.select("*", lanes.alias("c")).select("*", "c.lane", "c.cutoff").where((age > 0) & (age <= window))
    most, least = F.greatest(h, a), F.least(h, a)
    return rows.select(
        "lane", "game_key", "event_id", "season", "home_id", "away_id", most.alias("most"), least.alias("least"), F.signum(h - a).cast("int").alias("sign"),
        (F.signum(h - a) * game_x(most, least)).alias("x"), (score_weight(most, least) * half_life(age, half)).alias("w"),
    )


def entries_of(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None, cutoffs: list[datetime.date], who: DataFrame | None = None) -> DataFrame:
    """Rows (lane, team, club, player, share, credit) of the team-events of ``window_games``.

    With ``who``, as from ``twins``, one player stands for all on the same
    rosters: the share is that of all of them, the credit that of each.

    Shares of a team-event sum to 1, credits to its number of players. Both
    follow the players' usage in stat lines of days before the cutoff, pulled
    towards 1 by four events. A team-event without a roster has one ghost of its
    club and first season; one without a club is its own.
    """
    teams = games.select("lane", F.col("home_id").alias("team"), "season").unionByName(games.select("lane", F.col("away_id").alias("team"), "season"))
    teams = teams.groupBy("lane", "team").agg(F.min("season").alias("season"))
    teams = teams.join(clubs.select(F.col("event_team_id").alias("team"), "club"), "team", "left").withColumn("club", F.coalesce("club", "team"))
    listed = rosters.where(F.col("player_id").isNotNull())
    one = F.lit(1).cast("long")
    if who is None:
        listed = listed.select(F.col("event_team_id").alias("team"), F.col("player_id").cast("string").alias("player"), one.alias("n"), one.alias("times"))
    else:
        known = who.select("player_id", "twin", "size")
        known = F.broadcast(known) if known.count() <= FEW else known
        listed = listed.join(known, "player_id").groupBy(F.col("event_team_id").alias("team"), F.col("twin").alias("player"), "size").agg(F.count("*").alias("n"))
        listed = listed.select("team", "player", "n", (F.col("n") / F.col("size")).alias("times"))
    ghost = F.concat(F.lit("ghost:"), "club", F.lit(":"), F.col("season").cast("string"))
    rows = teams.join(listed, "team", "left").select("lane", "team", "club", F.coalesce("player", ghost).alias("player"), F.coalesce("n", one).alias("n"), F.coalesce("times", one).alias("times"))
    usage = F.lit(1.0)
    if stats is not None:
        lines = stats.select(F.col("player_id").cast("string").alias("player"), "end_date", "usage")
        lanes = F.explode(F.array(*[F.struct(F.lit(i).alias("lane"), F.lit(c).cast("date").alias("cutoff")) for i, c in enumerate(cutoffs)]))
        used = lines.select("*", lanes.alias("c")).where("end_date < c.cutoff").groupBy(F.col("c.lane").alias("lane"), "player").agg(F.sum("usage").alias("sum"), F.count("*").alias("lines"))
        rows = rows.join(used, ["lane", "player"], "left")
        usage = (SHRINK + F.coalesce("sum", F.lit(0.0))) / (SHRINK + F.coalesce("lines", F.lit(0)))
    rows = rows.withColumn("use", F.least(F.greatest(usage, F.lit(CLAMP[0])), F.lit(CLAMP[1])))
    own = W.partitionBy("lane", "team")  # a roster
    share = F.col("use") / F.sum(F.col("use") * F.col("n")).over(own)
    return rows.select("lane", "team", "club", "player", (share * F.col("n")).alias("share"), (share * F.col("times") * F.sum("n").over(own)).alias("credit"))


def sides_of(games: DataFrame) -> DataFrame:
    """Rows (lane, team, rival, w, x): a game from both sides, x the difference that the score suggests for ``team``."""
    home = games.select("lane", F.col("home_id").alias("team"), F.col("away_id").alias("rival"), "w", "x")
    return home.unionByName(games.select("lane", F.col("away_id").alias("team"), F.col("home_id").alias("rival"), "w", (-F.col("x")).alias("x")))


def strengths(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """(lane, team, strength) at the ratings (lane, player, rating); players without one count as the mean."""
    rated = entries.join(ratings.select("lane", "player", "rating"), ["lane", "player"], "left")
    return rated.groupBy("lane", "team").agg(F.sum(F.col("share") * F.coalesce("rating", F.lit(BASE))).alias("strength"))


def step(entries: DataFrame, sides: DataFrame, ratings: DataFrame, prior: float = 2.0) -> DataFrame:
    """One step of the map: (lane, player, rating, evidence) from (lane, player, rating)."""
    t = strengths(entries, ratings).withColumnRenamed("team", "rival")
    earned = sides.join(t, ["lane", "rival"]).groupBy("lane", "team").agg(F.sum(F.col("w") * (F.col("strength") + F.col("x"))).alias("earned"), F.sum("w").alias("w"))
    sums = entries.join(earned, ["lane", "team"]).groupBy("lane", "player").agg(F.sum(F.col("credit") * F.col("earned")).alias("n"), F.sum(F.col("credit") * F.col("w")).alias("evidence"))
    return sums.select("lane", "player", ((prior * BASE + F.col("n")) / (prior + F.col("evidence"))).alias("rating"), "evidence")


def solve(entries: DataFrame, sides: DataFrame, start: DataFrame, prior: float = 2.0, tolerance: float = 0.01, memory: int = MEMORY, steps: int = STEPS) -> DataFrame:
    """The ratings (lane, player, rating, evidence) that a step moves by less than ``tolerance``.

    ``start`` has (lane, player, rating); players without a game are left out.
    """
    zero = F.array().cast("array<double>")
    now = step(entries, sides, start, prior).select("lane", "player", F.col("rating").alias("start"))
    now = written(now.join(start.select("lane", "player", F.col("rating").alias("given")), ["lane", "player"], "left").select("lane", "player", F.coalesce("given", "start").alias("x"), zero.alias("dx"), zero.alias("df"), F.lit(None).cast("double").alias("f0")), "ratings")
    for k in range(steps):
        g = step(entries, sides, now.select("lane", "player", F.col("x").alias("rating")), prior)
        rows = now.join(g.withColumnRenamed("rating", "g"), ["lane", "player"]).withColumn("f", F.col("g") - F.col("x"))
        if k:  # the last move and what it changed, newest first
            rows = rows.withColumn("df", F.slice(F.concat(F.array(F.col("f") - F.col("f0")), "df"), 1, memory))
        rows = written(rows, "step")
        m = min(k, memory)
        pairs = [F.sum(F.get("df", i) * F.get("df", j)) for i in range(m) for j in range(i, m)]
        sums = rows.groupBy("lane").agg(F.max(F.abs("f")).alias("moved"), F.array(*[F.sum(F.get("df", i) * F.col("f")) for i in range(m)], *pairs).cast("array<double>").alias("s")).collect()  # a row per cutoff
        if all(r["moved"] < tolerance for r in sums):
            return rows.select("lane", "player", F.col("g").alias("rating"), "evidence")
        mixed = []
        for r in sums:
            b, gram = np.array(r["s"][:m]), np.zeros((m, m))
            gram[np.triu_indices(m)] = r["s"][m:]
            gram += np.triu(gram, 1).T
            mixed.append((r["lane"], np.linalg.lstsq(gram, b, rcond=1e-10)[0].tolist() if m else []))
        weights = F.broadcast(rows.sparkSession.createDataFrame(mixed, "lane int, c array<double>"))  # a row per cutoff
        moves = F.zip_with("dx", "df", lambda d, e: d + e)
        back = F.aggregate(F.zip_with("c", moves, lambda c, d: c * d), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
        new = rows.join(weights, "lane").withColumn("y", F.col("g") - back)
        now = new.select("lane", "player", F.col("y").alias("x"), F.slice(F.concat(F.array(F.col("y") - F.col("x")), "dx"), 1, memory).alias("dx"), "df", F.col("f").alias("f0"))
    raise RuntimeError("ratings did not settle")


def blowouts(games: DataFrame, clubs: DataFrame, strength: DataFrame, gap: float = BLOWOUT_GAP, kept: int = MIN_KEPT) -> DataFrame:
    """(lane, game_key, event_id) of the games that are left out at these strengths.

    A win by more than twice the loser's points and one, of a team more than
    ``gap`` stronger, is left out while its winner's club keeps ``kept`` other
    results; larger gaps come first, equal ones by key. ``clubs`` has (lane,
    team, club). A game is settled as soon as its winner's earlier games are, or
    as soon as they cannot matter; every round settles the first open game.
    """
    of = lambda side: strength.join(clubs, ["lane", "team"]).select("lane", F.col("team").alias(f"{side}_id"), F.col("strength").alias(f"{side}_t"), F.col("club").alias(f"{side}_club"))
    rows = games.join(of("home"), ["lane", "home_id"]).join(of("away"), ["lane", "away_id"])
    counts = rows.select("lane", F.explode(F.array("home_club", "away_club")).alias("club")).groupBy("lane", "club").agg(F.count("*").alias("n"))
    ahead = F.col("sign") * (F.col("home_t") - F.col("away_t"))
    won = lambda a, b: F.when(F.col("sign") > 0, F.col(a)).otherwise(F.col(b))
    far = rows.where((F.col("sign") != 0) & (ahead > gap) & (F.col("most") > 2 * F.col("least") + 1))
    far = far.select("lane", "game_key", "event_id", ahead.alias("ahead"), won("home_club", "away_club").alias("top"), won("away_club", "home_club").alias("low"))
    far = far.join(counts.withColumnRenamed("club", "top"), ["lane", "top"]).withColumn("out", F.lit(None).cast("boolean"))
    far = written(far, "blowouts")
    role = F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("top").alias("club")), F.struct(F.lit(1).alias("role"), F.col("low").alias("club")))).alias("r")
    before = W.partitionBy("lane", "r.club").orderBy(F.desc("ahead"), "game_key", "event_id", "r.role").rowsBetween(W.unboundedPreceding, -1)
    while far.where("out is null").limit(1).count():
        both = far.select("*", role)
        sure = F.coalesce(F.sum(F.col("out").cast("int")).over(before), F.lit(0))
        maybe = F.coalesce(F.sum(F.col("out").isNull().cast("int")).over(before), F.lit(0))
        left = F.col("n") - sure - 1
        told = F.when(left - maybe >= kept, True).when(left < kept, False)
        far = written(both.withColumn("told", told).where("r.role = 0").withColumn("out", F.coalesce("out", "told")).drop("r", "told"), "blowouts")
    return far.where("out").select("lane", "game_key", "event_id")


def rate_players_batch(
    games: DataFrame,
    rosters: DataFrame,
    clubs: DataFrame,
    stats: DataFrame | None,
    cutoffs: list[datetime.date],
    half: float = 126.0,
    window: int = 730,
    prior: float = 2.0,
    tolerance: float = 0.01,
    start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ratings (cutoff, player, rating, evidence) and strengths (cutoff, event_team_id, strength) from the games before each cutoff.

    games as from ``load_games``, rosters (event_team_id, player_id), clubs
    (event_team_id, club), stats as from ``load_stat_events`` or None. A player
    listed twice counts twice. ``start`` may give ratings (cutoff, player,
    rating) to begin with; they change the number of steps, not the result. The
    games left out as blowouts and the ratings are found in turn, six times at
    most; a player without a game of some weight has no rating and counts as the
    mean. Empty tables give empty results.
    """
    lanes = {c: i for i, c in enumerate(cutoffs)}
    rows = written(window_games(games, cutoffs, half, window), "window")
    who = None
    if start is None:  # of those who begin alike, players on the same rosters without stat lines are rated once
        who = twins(rosters, *([] if stats is None else [stats.where("player_id is not null").select(F.col("player_id").cast("string").alias("player"))]))
    entries = written(entries_of(rows, rosters, clubs, stats, cutoffs, who), "entries")
    teams = entries.select("lane", "team", "club").distinct()
    players = entries.select("lane", "player").distinct().withColumn("rating", F.lit(BASE))
    day = F.create_map(*[x for c, i in lanes.items() for x in (F.lit(c).cast("date"), F.lit(i))])
    if start is not None:
        given = start.select(F.try_element_at(day, F.col("cutoff")).alias("lane"), "player", F.col("rating").alias("given"))
        players = players.join(given, ["lane", "player"], "left").select("lane", "player", F.coalesce("given", "rating").alias("rating"))
    found, out, key = players, rows.sparkSession.createDataFrame([], "lane int, game_key long, event_id long"), ["lane", "game_key", "event_id"]
    for _ in range(ROUNDS):
        found = solve(entries, written(sides_of(rows.join(out, key, "left_anti")), "sides"), found, prior, tolerance)
        now = written(blowouts(rows, teams, strengths(entries, found)), "out")
        changed = now.join(out, key, "left_anti").limit(1).count() or out.join(now, key, "left_anti").limit(1).count()
        if not changed:
            break
        out = now
    cutoff = F.element_at(F.array(*[F.lit(c).cast("date") for c in cutoffs]), F.col("lane") + 1).alias("cutoff")
    named = strengths(entries, found).select(cutoff, F.col("team").alias("event_team_id"), "strength")
    rated = found.where("evidence > 0").select(cutoff, "player", "rating", "evidence")
    return (rated if who is None else everyone(rated, who)), named


def walk_forward_players(games: DataFrame, rosters: DataFrame, clubs: DataFrame, stats: DataFrame | None, cutoffs: list[datetime.date], **options) -> DataFrame:
    """For each game of a cutoff's day the strength difference from the games before that day (cutoff, game_key, event_id, diff, outcome).

    A team's strength is that of its own roster at the ratings of the cutoff; players unrated then count as the mean.
    """
    rated, _ = rate_players_batch(games, rosters, clubs, stats, cutoffs, **options)
    rated = written(rated, "rated")
    lanes = F.create_map(*[x for i, c in enumerate(cutoffs) for x in (F.lit(c).cast("date"), F.lit(i))])
    today = games.withColumn("lane", F.try_element_at(lanes, F.col("date"))).where(F.col("lane").isNotNull())
    entries = entries_of(today, rosters, clubs, stats, cutoffs)
    t = written(strengths(entries, rated.select(F.try_element_at(lanes, F.col("cutoff")).alias("lane"), "player", "rating")), "strengths")
    of = lambda side: t.select("lane", F.col("team").alias(f"{side}_id"), F.col("strength").alias(f"{side}_t"))
    both = today.join(of("home"), ["lane", "home_id"]).join(of("away"), ["lane", "away_id"])
    outcome = (F.signum(F.col("home_score") - F.col("away_score")) + 1) / 2
    return both.select(F.col("date").alias("cutoff"), "game_key", "event_id", (F.col("home_t") - F.col("away_t")).alias("diff"), outcome.alias("outcome"))
