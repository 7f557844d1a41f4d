"""Field strength of events, rating trajectories and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake import vocab
from rosterlake.functions import measures
from rosterlake.operators.graph import written

#: Rows of a counted table that a broadcast may have.
_FEW = 200_000


def last_before(points: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (club, day, event_id) the club's last rating strictly before the day (J6, FS1).

    points: (club, day, rating); of equal days the highest rating counts. Both
    are merged in one order per club, so no pairs are made.
    """
    p = points.groupBy("club", "day").agg(F.max("rating").alias("rating")).select("club", "day", "rating", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("event_id"))
    q = asked.select("club", "day", F.lit(None).cast("double").alias("rating"), F.lit(0).alias("kind"), F.col("event_id").cast("long").alias("event_id"))
    w = W.partitionBy("club").orderBy("day", "kind").rowsBetween(W.unboundedPreceding, -1)
    return p.unionByName(q).withColumn("known", F.last("rating", ignorenulls=True).over(w)).where("kind = 0").select("club", "day", "event_id", F.col("known").alias("rating"))


def field_strength(known: DataFrame, events: DataFrame, prior: int = 6) -> DataFrame:
    """Mean rating of the clubs at an event, drawn to the median event of the division (FS2)."""
    raw = known.where("rating is not null").groupBy("event_id").agg(F.avg("rating").alias("mean"), F.count("*").alias("n"))
    raw = raw.join(events.select("event_id", "division", "name"), "event_id")
    mid = raw.groupBy("division").agg(F.percentile("mean", 0.5).alias("mid"))
    score = (F.col("n") * F.col("mean") + prior * F.col("mid")) / (F.col("n") + prior)
    return raw.join(F.broadcast(mid), "division").select("event_id", "division", "name", "n", F.bround(score, 1).alias("score"))  # one row per division


def cutoffs(scores: DataFrame) -> DataFrame:
    """Grade limits per division (FS3): S the weakest national championship, C the median, A and B evenly between."""
    national = F.when(F.lower("name").rlike(vocab.CHAMPIONSHIP) & ~F.lower("name").rlike(vocab.NOT_CHAMPIONSHIP), F.col("score"))
    x = scores.groupBy("division").agg(F.coalesce(F.min(national), F.max("score")).alias("s"), F.percentile("score", 0.5).alias("c"))
    step = (F.col("s") - F.col("c")) / 3
    return x.select("division", "s", F.bround(F.col("c") + 2 * step, 1).alias("a"), F.bround(F.col("c") + step, 1).alias("b"), F.bround("c", 1).alias("c"))


def graded(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Events with their letter S to D."""
    letter = F.when(F.col("score") >= F.col("s"), "S").when(F.col("score") >= F.col("a"), "A").when(F.col("score") >= F.col("b"), "B").when(F.col("score") >= F.col("c"), "C").otherwise("D")
    return scores.join(F.broadcast(limits), "division").select("event_id", "division", "score", letter.alias("letter"))  # one row per division


def named_grades(grades: DataFrame, listed: DataFrame) -> DataFrame:
    """Scores and letters of listed events (FS4), found by date, the first 46 characters of the name, season and division.

    grades: (event_id, day, name, season, division, score, letter); of events
    that share all four the strongest counts. Listed events without a grade stay.
    """
    key = ["day", "short", "season", "division"]
    short = F.substring("name", 1, 46).alias("short")
    best = grades.select("day", short, "season", "division", F.struct("score", "letter").alias("x")).groupBy(*key).agg(F.max("x").alias("x"))
    return listed.withColumn("short", F.substring("name", 1, 46)).join(best, key, "left").select("event_id", "x.score", "x.letter")


def trends(points: DataFrame, top: int = 25) -> DataFrame:
    """Season medians and the subjects who reached a season's first ``top`` (ties kept), with their peak, for every choice of a filter (H4).

    points: (kind, subject, season, rating), one row per subject and season. With
    columns ``division`` and ``gender`` every combination of them and of 'all'
    is answered.
    """
    by = [c for c in ("division", "gender") if c in points.columns]
    rows = points
    for c in by:
        rows = rows.withColumn(c, F.explode(F.array(F.lit("all"), F.coalesce(c, F.lit("")))))
    group = ["kind", *by]
    rank = F.rank().over(W.partitionBy(*group, "season").orderBy(F.desc("rating")))
    in_top = rows.withColumn("r", rank).where(F.col("r") <= top).select(*group, "subject").distinct()
    peak = rows.groupBy(*group, "subject").agg(F.max("rating").alias("peak"), F.max_by("season", F.struct("rating", -F.col("season"))).alias("peak_season"), F.count("*").alias("n_seasons"))
    return peak.join(in_top, [*group, "subject"], "left_semi")


def _choices(points: DataFrame) -> DataFrame:
    """Each subject's last rating of a season (kind, division, gender, subject, season, value) for every choice of a division and a gender, 'all' among them.

    Only the last point of a season in each division is repeated for the choices.
    """
    group, at = ["kind", "division", "gender", "subject", "season"], F.struct("day", "seq")
    last = points.groupBy(*group).agg(F.max_by(F.struct("day", "seq", "rating"), at).alias("x")).select(*group, "x.*")
    gender = F.when(F.coalesce(F.col("gender"), F.lit("")) == "", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("gender")))
    rows = last.withColumn("division", F.explode(F.array(F.lit("all"), F.coalesce("division", F.lit(""))))).withColumn("gender", F.explode(gender))
    return rows.groupBy(*group).agg(F.max_by("rating", at).alias("value"))


def trend_cube(points: DataFrame, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """Seasons and drawn subjects for every choice of a division and a gender (H4).

    points: (kind, subject, season, division, gender, day, seq, rating), all
    points of all subjects; a division selects points, not subjects; subjects
    without a gender are under 'all' alone. The first table has for each kind,
    division, gender and season the median of all subjects' last ratings, their
    number and ``cut``, the ``top``-th largest of them or the least. The second
    one has the subjects who reach a season's cut, ties included, in the order of
    their rating in the last season of all, then of their peak, then of their name.
    """
    values = written(_choices(points), "choices")
    group = ["kind", "division", "gender"]
    largest = W.partitionBy(*group, "season").orderBy(F.desc("value"))
    cut = values.withColumn("n", F.row_number().over(largest)).where(F.col("n") <= top).groupBy(*group, "season").agg(F.min("value").alias("cut"))
    seasons = values.groupBy(*group, "season").agg(F.percentile("value", 0.5).alias("median"), F.count("*").alias("n")).join(cut, [*group, "season"])
    last = values.agg(F.max("season").alias("last"))
    drawn = values.join(cut, [*group, "season"]).crossJoin(F.broadcast(last))  # one row
    drawn = drawn.groupBy(*group, "subject").agg(
        F.max(F.col("value") >= F.col("cut")).alias("in_top"), F.max("value").alias("peak"), F.max(F.when(F.col("season") == F.col("last"), F.col("value"))).alias("current")
    )
    order = W.partitionBy(*group).orderBy(F.desc_nulls_last("current"), F.desc("peak"), F.asc_nulls_last(F.col("subject").try_cast("long")), "subject")
    chosen = drawn.where("in_top").withColumn("position", F.row_number().over(order).cast("long"))
    return seasons, chosen.select(*group, "subject", "peak", "current", "position")


def medians(points: DataFrame) -> DataFrame:
    return points.groupBy("kind", "season").agg(F.percentile("rating", 0.5).alias("median"), F.count("*").alias("n"))


def club_stints(rows: DataFrame) -> DataFrame:
    """Runs of consecutive events of a player with one club (H10). rows: (player_id, start_date, event_team_id, club)."""
    w = W.partitionBy("player_id").orderBy("start_date", "event_team_id")
    change = F.when(F.lag("club").over(w) == F.col("club"), 0).otherwise(1)
    runs = rows.withColumn("new", change).withColumn("stint", F.sum("new").over(w).cast("long"))
    return runs.groupBy("player_id", "stint").agg(F.first("club").alias("club"), F.min("start_date").alias("since"), F.max("start_date").alias("until"), F.count("*").alias("n_events"))


def club_names(rows: DataFrame) -> DataFrame:
    """The spelling of a club at its latest event (H9). rows: (club, start_date, event_team_id, display_name)."""
    return rows.groupBy("club").agg(F.max_by("display_name", F.struct("start_date", "event_team_id")).alias("display_name"))


def event_club_index(fix: DataFrame, clubs: DataFrame) -> DataFrame:
    """Pairs of event and club that have games (H7)."""
    both = fix.select("event_id", F.explode(F.array("home_id", "away_id")).alias("event_team_id"))
    return both.join(clubs, "event_team_id").select("event_id", "club").distinct()


def trajectory(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points of a replay with the facts of their events (H1): (kind, subject, event_id, day, season, division, rating, n, club)."""
    e = events.select("event_id", F.coalesce("start_date", "end_date").alias("day"), "season", F.coalesce("division", F.lit("club-men")).alias("division"))
    return points.join(e, "event_id").select("kind", "subject", "event_id", "day", "season", "division", F.bround("rating", 0).cast("long").alias("rating"), "n", "club")


def game_deltas(moves: DataFrame) -> DataFrame:
    """How much a game moved both clubs' ratings (H2)."""
    return moves.select("event_id", "game_key", F.bround(F.col("home_after") - F.col("home_before"), 0).cast("long").alias("home_delta"), F.bround(F.col("away_after") - F.col("away_before"), 0).cast("long").alias("away_delta"))


def history(points: DataFrame, state: DataFrame, games: DataFrame, deltas: DataFrame, clubs: DataFrame, min_games: int = 30) -> dict[str, DataFrame]:
    """The tables of a published history (H3): trajectories of clubs and of players with enough games, their events, and the rated games with both clubs' changes."""
    keep = state.where((F.col("games") >= min_games) & ~F.col("player").startswith("ghost:")).select(F.col("player").alias("subject"))
    kept = points.where("kind = 'club'").unionByName(points.where("kind = 'player'").join(keep, "subject", "left_semi").select(points.columns))
    used = kept.select("event_id").distinct()
    rows = games.join(used, "event_id", "left_semi")
    for side in ("home", "away"):
        rows = rows.join(clubs.select(F.col("event_team_id").alias(f"{side}_id"), F.col("club").alias(f"{side}_club")), f"{side}_id")
    rows = rows.join(deltas, ["event_id", "game_key"], "left").fillna(0, ["home_delta", "away_delta"])
    cols = ["event_id", "game_key", "home_club", "away_club", "home_score", "away_score", F.coalesce("stage", F.lit("")).alias("stage"), "home_delta", "away_delta"]
    return {"points": kept, "events": used, "games": rows.select(*cols)}


def spans(points: DataFrame) -> DataFrame:
    """First and last season and the range of ratings of each kind, and how many subjects stand in several divisions (H5)."""
    many = points.groupBy("kind", "subject").agg(F.countDistinct("division").alias("n")).groupBy("kind").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("n_in_several"))
    ends = points.groupBy("kind").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.min("rating").alias("least"), F.max("rating").alias("most"))
    return ends.join(many, "kind")


def with_records(points: DataFrame, records: DataFrame) -> DataFrame:
    """Points of clubs with the wins and losses of the event (H6); points without games have none."""
    r = records.select("event_id", F.col("club").alias("subject"), "wins", "losses")
    return points.where("kind = 'club'").join(r, ["event_id", "subject"], "left").select("subject", "event_id", "rating", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("losses", F.lit(0)).alias("losses"))


def tiers(points: DataFrame, rosters: DataFrame, games: DataFrame, n: int = 32) -> dict[str, DataFrame]:
    """The tables of a history by the partitions in which they are read (H7): players by id, rosters by the club's place in order, games by season.

    A club's place is counted in buckets of names' first letters, so no task
    numbers all clubs. Rosters stay where they are read while the clubs are
    counted to be at most ``_FEW``, as a club can have most of the rows.
    """
    number = F.col("subject").try_cast("long")
    players = points.where("kind = 'player'").withColumn("bucket", F.pmod(F.coalesce(number, F.xxhash64("subject")), F.lit(n)).cast("int"))
    names_ = written(rosters.select("club").distinct(), "clubs").withColumn("head", F.substring("club", 1, 2))
    sizes = names_.groupBy("head").agg(F.count("*").alias("c"))
    before = sizes.select("head", F.coalesce(F.sum("c").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per two letters
    place = names_.join(before, "head").withColumn("place", F.row_number().over(W.partitionBy("head").orderBy("club")) - 1 + F.col("before"))
    place = written(place.select("club", F.pmod("place", F.lit(n)).cast("int").alias("bucket")), "places")
    listed = rosters.join(F.broadcast(place) if place.count() <= _FEW else place, "club")
    return {"players": players, "rosters": listed, "games": games.withColumn("bucket", F.col("season"))}


def event_meta(graded_: DataFrame, champs: DataFrame, clubs: DataFrame, fix: DataFrame, events: DataFrame) -> DataFrame:
    """Score, letter, the champion's club and whether an event is still to come, that is has no game done (H8)."""
    done = fix.where("done").select("event_id").distinct()
    won = champs.join(clubs.select(F.col("event_team_id").alias("champion"), "club"), "champion", "left").select("event_id", F.col("club").alias("champion_club"))
    out = events.select("event_id").join(graded_.select("event_id", "score", "letter"), "event_id", "left").join(won, "event_id", "left").join(done.withColumn("_done", F.lit(True)), "event_id", "left")
    return out.select("event_id", "score", "letter", "champion_club", F.col("_done").isNull().alias("upcoming"))


def player_rows(ranked: DataFrame, genders: DataFrame, masks: DataFrame, loo: DataFrame, min_games: int = 30) -> DataFrame:
    """Published rows of players with enough games (H11): rating, bounds, gender code (1 m, 2 w, 0 unknown), masks and the code of the leave-one-out loss."""
    out = ranked.where(F.col("games") >= min_games).join(genders, "player", "left").join(masks, "player", "left").join(loo, "player", "left")
    gender = F.when(F.col("gender") == "m", 1).when(F.col("gender") == "w", 2).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("rank", "player", "rating", "lo90", "hi90", "games", gender.alias("gender"), zero("divisions"), zero("divisions_now"), measures.loo_code(F.col("loo")).alias("loo_code"))
