"""Player and team rankings on several roster bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake import vocab
from rosterlake.functions import measures, names
from rosterlake.operators.graph import written

#: Rows of a counted table that a broadcast may have.
_FEW = 200_000


def rank_players(state: DataFrame, min_games: int = 5, published: DataFrame | None = None) -> DataFrame:
    """Players with enough games, without ghosts, by rating, id and games downwards, with 90 % bounds.

    ``published`` (player, rating) has the last ratings that trajectories booked
    to events; they take the place of the model's. The bounds rest on the
    model's own deviation ``rd`` where the state has one, else on the number of
    games. The rank is counted in ranges of rating, so no task holds all players.
    """
    rows = state.where((F.col("games") >= min_games) & ~F.col("player").startswith("ghost:"))
    if published is not None:
        rows = rows.join(published.select("player", F.col("rating").alias("_booked")), "player", "left").withColumn("rating", F.coalesce("_booked", "rating")).drop("_booked")
    sigma = F.col("rd") if "rd" in state.columns else measures.rating_sigma(F.greatest("games", F.lit(1)))
    rows = rows.select("player", "rating", "games", F.bround(F.col("rating") - 1.645 * sigma, 1).alias("lo90"), F.bround(F.col("rating") + 1.645 * sigma, 1).alias("hi90"))
    rows = rows.withColumn("band", F.floor(F.col("rating") / 5).cast("long"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"))
    above = sizes.select("band", F.coalesce(F.sum("n").over(W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = F.row_number().over(W.partitionBy("band").orderBy(F.desc("rating"), F.desc("player"), F.desc("games")))
    return rows.join(above, "band").withColumn("rank", (inside + F.col("above")).cast("long")).drop("band", "above")


def last_appearance(rosters: DataFrame, events: DataFrame) -> DataFrame:
    """Each player's team at the latest event; of equal dates the greatest team id."""
    rows = rosters.select("player_id", "event_team_id", "event_id").join(events.select("event_id", "start_date"), "event_id")
    return rows.groupBy("player_id").agg(F.max(F.struct("start_date", "event_team_id")).alias("x")).select("player_id", "x.start_date", "x.event_team_id")


def latest_rosters(teams: DataFrame, clubs: DataFrame, events: DataFrame, as_of: str, season: int | None = None, basis: str = "completed") -> DataFrame:
    """Per club and division of a season the latest event that is over, or the soonest one that is not.

    An event is over if it has an end on or before ``as_of``. It is still ahead
    if its end is on that day or later, or it has no end and does not start
    before it; an event that ends that day is both. Of equal starts the greatest
    team id counts.
    """
    if basis not in ("completed", "upcoming"):
        raise ValueError(f"unknown basis {basis!r}")
    day = F.lit(as_of).cast("date")
    own = events.select("event_id", "season", F.coalesce("division", F.lit("club-men")).alias("division"), "start_date", "end_date")
    rows = teams.select("event_team_id", "event_id").join(clubs, "event_team_id").join(own, "event_id")
    rows = rows.where(F.col("season") == season) if season is not None else rows
    over = F.col("end_date") <= day
    ahead = (F.col("end_date") >= day) | (F.col("end_date").isNull() & (F.col("start_date") >= day))
    rows = rows.where(over if basis == "completed" else ahead)
    order = [F.desc("start_date") if basis == "completed" else F.asc("start_date"), F.desc("event_team_id")]
    best = F.row_number().over(W.partitionBy("season", "division", "club").orderBy(*order))
    return rows.withColumn("r", best).where("r = 1").select("season", "division", "club", "event_team_id", "start_date")


def team_strength(rosters: DataFrame, ratings: DataFrame, tau: float = 500.0) -> DataFrame:
    """Softmax-weighted mean rating of every roster: weights exp((r - max) / tau)."""
    rows = rosters.join(ratings, "player_id")
    top = rows.groupBy("event_team_id").agg(F.max("rating").alias("top"))
    w = F.exp((F.col("rating") - F.col("top")) / tau)
    return rows.join(top, "event_team_id").groupBy("event_team_id").agg((F.sum(w * F.col("rating")) / F.sum(w)).alias("strength"), F.count("*").alias("n"))


def best_rosters(strength: DataFrame, teams: DataFrame, clubs: DataFrame, floor: float = 0.8) -> DataFrame:
    """Each club's strongest roster among those with at least ``floor`` of its largest size."""
    rows = strength.join(clubs, "event_team_id").join(teams.select("event_team_id", "division"), "event_team_id")
    most = rows.groupBy("division", "club").agg(F.max("n").alias("most"))
    rows = rows.join(most, ["division", "club"]).where(F.col("n") >= floor * F.col("most"))
    best = F.row_number().over(W.partitionBy("division", "club").orderBy(F.desc(F.round("strength", 9)), "event_team_id"))
    return rows.withColumn("r", best).where("r = 1").select("division", "club", "event_team_id", "n", "strength")


def team_table(best: DataFrame) -> DataFrame:
    """Clubs ranked within their division by strength and key downwards."""
    rank = F.row_number().over(W.partitionBy("division").orderBy(F.desc(F.round("strength", 9)), F.desc("club")))
    return best.select("division", "club", F.bround("strength", 1).alias("strength"), "n", rank.cast("long").alias("rank"))


def published_rosters(own: DataFrame, external: DataFrame, basis: str) -> DataFrame:
    """Rosters of a basis with those of another corpus's season added, unless the basis is upcoming; of the same club the added one counts."""
    if basis == "upcoming":
        return own
    key = ["division", "club"]
    return own.join(external.select(*key).distinct(), key, "left_anti").unionByName(external.select(*own.columns))


def division_masks(appearances: DataFrame) -> DataFrame:
    """Bits of the divisions in which a player has ever been, and in the last season (W7): (player_id, divisions, divisions_now).

    appearances: (player_id, season, division, start_date), a row per roster. Of
    the club divisions of the last season the one with most rosters counts
    alone, of equal ones the one with the latest start.
    """
    rows = appearances.withColumn("division", F.coalesce("division", F.lit("club-men")))
    bit = F.expr("shiftleft(1L, code)")
    rows = rows.withColumn("code", names.division_code(F.col("division")))
    ever = rows.groupBy("player_id").agg(F.bit_or(bit).alias("divisions"), F.max("season").alias("season"))
    now = rows.join(ever.select("player_id", "season"), ["player_id", "season"]).groupBy("player_id", "division", "code").agg(F.count("*").alias("n"), F.max("start_date").alias("latest"))
    club = F.col("division").isin(vocab.CLUB_DIVISIONS)
    best = F.row_number().over(W.partitionBy("player_id", club).orderBy(F.desc("n"), F.desc_nulls_last("latest"), "code"))
    kept = now.withColumn("r", best).where(~club | (F.col("r") == 1)).groupBy("player_id").agg(F.bit_or(bit).alias("divisions_now"))
    return ever.join(kept, "player_id").select("player_id", "divisions", "divisions_now")


def division_rankings(latest: DataFrame, rosters: DataFrame, ratings: DataFrame, top: int = 15) -> DataFrame:
    """The first clubs of each season and division by the strength of the latest roster (W8). latest as from ``latest_rosters``."""
    strength = team_strength(rosters.join(latest.select("event_team_id"), "event_team_id", "left_semi"), ratings)
    rows = latest.join(strength, "event_team_id")
    rank = F.row_number().over(W.partitionBy("season", "division").orderBy(F.desc(F.round("strength", 9)), F.desc("club")))
    rows = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return rows.select("season", "division", "rank", "club", F.bround("strength", 1).alias("strength"), "n")


def pro_team_rankings(members: DataFrame, records: DataFrame, links: DataFrame, ratings: DataFrame) -> DataFrame:
    """Professional teams with games by the strength of their linked players, with the coverage.

    members: (team_id, pro_id); records: (team_id, wins, losses); links: (pro_id, player_id).
    """
    all_ = members.groupBy("team_id").agg(F.count("*").alias("n_roster"))
    linked = members.join(links, "pro_id").select(F.col("team_id").alias("event_team_id"), "player_id")
    rows = team_strength(linked, ratings).withColumnsRenamed({"event_team_id": "team_id", "n": "n_linked"})
    rows = rows.join(all_, "team_id").join(records.where("wins + losses > 0"), "team_id")
    rank = F.row_number().over(W.orderBy(F.desc(F.round("strength", 9)), F.desc("team_id")))  # one row per team of a league
    return rows.select(rank.cast("long").alias("rank"), "team_id", F.bround("strength", 1).alias("strength"), "n_linked", "n_roster", "wins", "losses")


def external_gender(players: DataFrame, appearances: DataFrame) -> DataFrame:
    """Genders with 'w' for players without one who were in a women's division of another corpus (W9). players: (player_id, gender)."""
    women = appearances.where(F.col("division").contains("women")).select("player_id").distinct().withColumn("_w", F.lit("w"))
    out = players.join(women, "player_id", "full")
    return out.select("player_id", F.coalesce("gender", "_w").alias("gender"))


def ranked_population(rows: DataFrame, by: list, text: str | None = None, column: str = "club", limit: int = 300) -> DataFrame:
    """The first ``limit`` rows whose name holds a text, with their rank among all rows given, found or not."""
    ranked = rows.withColumn("rank", F.row_number().over(W.orderBy(*by)).cast("long"))  # a page's population, filtered by the caller
    found = ranked.where(F.lower(column).contains(text.lower())) if text else ranked
    return found.orderBy("rank").limit(limit)


def season_snapshot(points: DataFrame) -> DataFrame:
    """The last point of every subject in a season (W11). points: (subject, season, day, seq, rating)."""
    return points.groupBy("subject", "season").agg(F.max_by("rating", F.struct("day", "seq")).alias("rating"), F.count("*").alias("n_points"))


def point_deltas(points: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Changes between the consecutive points of a subject (W12); with ``deltas`` split into results and roster.

    points: (subject, day, seq, rating, event_id); deltas: (subject, event_id,
    delta), the changes in the games of an event. The rest of a change comes
    from the roster.
    """
    w = W.partitionBy("subject").orderBy("day", "seq")
    kept = [c for c in ("event_id",) if c in points.columns]
    out = points.select("subject", "day", "seq", "rating", *kept, (F.col("rating") - F.lag("rating").over(w)).alias("delta"))
    if deltas is None:
        return out
    results = deltas.groupBy("subject", "event_id").agg(F.sum("delta").alias("results"))
    out = out.join(results, ["subject", "event_id"], "left").withColumn("results", F.coalesce("results", F.lit(0)))
    return out.withColumn("roster", F.col("delta") - F.col("results"))


def event_list(facts: DataFrame, division: str | None = None, season: int | None = None, tier: int | None = None, letter: str | None = None, state: str | None = None, text: str | None = None, order: str = "date", limit: int = 400) -> DataFrame:
    """Filtered events in one of three orders: latest first, largest first, strongest first.

    facts as from ``event_facts``; ``letter`` and the order 'strength' need the
    columns letter and score, ``state`` a column place.
    """
    rows = facts
    for column, value in (("division", division), ("season", season), ("tier", tier), ("letter", letter)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    rows = rows.where(names.state_of(F.col("place")) == state) if state is not None else rows
    rows = rows.where(F.lower("name").contains(text.lower())) if text else rows
    orders = {"date": "start_date", "size": "n_teams", "strength": "score"}
    return rows.orderBy(F.desc_nulls_last(orders[order]), "event_id").limit(limit)


def season_roster(rosters: DataFrame, clubs: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Players of a club in a season with the number of events.

    With ``best`` (division, club, event_team_id) the players of a club's latest
    season are those of its best roster, whether or not at the club's events so
    far; their number of events may be null.
    """
    rows = rosters.join(clubs, "event_team_id")
    key = ["division", "club", "season", "player_id"]
    counted = rows.groupBy(*key).agg(F.countDistinct("event_id").alias("n_events"))
    if best is None:
        return counted
    counted = written(counted, "counted")
    latest = counted.groupBy("division", "club").agg(F.max("season").alias("season"))
    of = written(best.select("division", "club", "event_team_id").join(latest, ["division", "club"]), "best")
    theirs = of.select("event_team_id").distinct()
    theirs = F.broadcast(theirs) if of.count() <= _FEW else theirs  # rosters stay where they are read
    listed = rosters.select("event_team_id", "player_id").join(theirs, "event_team_id", "left_semi").distinct()
    now = of.join(listed, "event_team_id").select(*key).join(counted, key, "left")
    return counted.join(latest, ["division", "club", "season"], "left_anti").unionByName(now)


