"""Loading and keeping the corpus: games, stat lines, clubs, merges, replacement and provider checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake import vocab
from rosterlake.functions import measures, names


def load_games(games: DataFrame, events: DataFrame) -> DataFrame:
    """Rated games (S2): both teams and scores there, not 0-0, at least 4 points, status empty or Final.

    ``date`` is the game's date, else the event's start, else 1 January, kept
    within the event; ``clock`` is '23:59' where the time cannot be read. The
    order of a corpus is (date, clock, event_id, game_key).
    """
    e = events.select("event_id", "season", "start_date", "end_date", F.coalesce("division", F.lit("club-men")).alias("division"))
    total = F.col("home_score") + F.col("away_score")
    ok = F.col("home_id").isNotNull() & F.col("away_id").isNotNull() & (total >= 4) & (F.coalesce("status", F.lit("")).isin("", "Final"))
    day = F.coalesce("date", "start_date", F.make_date("season", F.lit(1), F.lit(1)))
    kept = F.when(F.col("start_date").isNull(), day).otherwise(F.least(F.greatest(day, "start_date"), F.coalesce("end_date", "start_date")))
    return games.where(ok).join(e, "event_id").select(
        "event_id", "game_key", "season", "division", kept.alias("date"), measures.clock(F.col("time")).alias("clock"), "stage", "home_id", "away_id", "home_score", "away_score"
    )


def load_stat_events(stats: DataFrame, teams: DataFrame, events: DataFrame) -> DataFrame:
    """Stat lines per team-event (S3): usage (1 is the average team-mate) and quality, dated at the event's end."""
    any_ = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("points", "assists", "ds", "turns")])
    p, a, d, t = (measures.stat(F.col(c)) for c in ("points", "assists", "ds", "turns"))
    lines = stats.where(any_).join(teams.select("event_team_id", "event_id"), "event_team_id").join(events.select("event_id", "end_date").where("end_date is not null"), "event_id")
    w = W.partitionBy("event_team_id", "end_date")
    lines = lines.select("event_team_id", "end_date", "player_id", (p + a + d + t).alias("part"), (p + a + d - t).alias("quality"))
    lines = lines.withColumn("total", F.sum("part").over(w)).withColumn("n", F.count("*").over(w)).where("total > 0 and n >= 2")
    return lines.select("event_team_id", "end_date", "player_id", (F.col("part") * F.col("n") / F.col("total")).alias("usage"), "quality")


def load_clubs(teams: DataFrame) -> DataFrame:
    """The club key of every team at an event."""
    return teams.select("event_team_id", names.club_key(F.col("full_name"), F.col("display_name"), F.col("division")).alias("club"))


def conflicting_keys(corpora: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that stand in more than one corpus with different values."""
    rest = [c for c in corpora[0].columns if c not in key]
    tagged = [c.select(*key, F.xxhash64(*rest).alias("_v")) for c in corpora]
    return reduce(DataFrame.unionByName, tagged).groupBy(*key).agg(F.countDistinct("_v").alias("n")).where("n > 1").drop("n")


def merge_inputs(corpora: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of corpora, equal rows once (S9); raises if a key has two values."""
    bad = conflicting_keys(corpora, key).first()
    if bad is not None:
        raise ValueError(f"conflicting rows for {bad.asDict()}")
    return reduce(DataFrame.unionByName, corpora).dropDuplicates(key)


def merge_latest(corpora: list[DataFrame]) -> DataFrame:
    """The latest appearance of each player over corpora (S9): that of the greatest season, of equal ones that of the later corpus. Each: (player_id, name, club, season)."""
    tagged = [c.withColumn("_corpus", F.lit(i)) for i, c in enumerate(corpora)]
    best = F.max_by(F.struct("name", "club", "season"), F.struct("season", "_corpus")).alias("x")
    return reduce(DataFrame.unionByName, tagged).groupBy("player_id").agg(best).select("player_id", "x.*")


def merge_appearances(corpora: list[DataFrame]) -> DataFrame:
    """Appearances of all corpora, each once."""
    return reduce(DataFrame.unionByName, corpora).distinct()


def upsert_events(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Events merged on (url without a trailing slash, division) (S10): new values, old ids.

    Of several rows of one key in a table, that of the largest id counts.
    """
    own = W.partitionBy("url", "division").orderBy(F.desc("event_id"))
    one = lambda df: df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    norm = lambda df: df.withColumn("url", F.regexp_replace("url", "/+$", ""))
    rest = [c for c in current.columns if c not in ("event_id", "url", "division")]
    old = one(norm(current)).alias("o")
    new = one(norm(incoming)).alias("n")
    both = old.join(new, ["url", "division"], "full")
    fresh = F.col("n.event_id").isNotNull()
    return both.select(
        F.coalesce("o.event_id", "n.event_id").alias("event_id"), "url", "division", *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest]
    )


def replace_event(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """A table with all rows of the incoming rows' events replaced (S11); the same input again changes nothing."""
    return table.join(incoming.select("event_id").distinct(), "event_id", "left_anti").unionByName(incoming.distinct())


def replace_events(tables: dict[str, DataFrame], incoming: dict[str, DataFrame], event_ids: DataFrame) -> dict[str, DataFrame]:
    """Teams, games, rosters and standings with all rows of some events replaced together.

    Tables without ``event_id`` hang on ``event_team_id``. The incoming rows are
    checked first: games and standings must name incoming teams of their event,
    rosters too, and played games need scores; otherwise nothing is replaced and
    ValueError is raised. An event with no incoming row loses its rows.
    """
    teams = incoming["event_teams"]
    known = teams.select("event_id", "event_team_id")
    for side in ("home_id", "away_id"):
        named = incoming["games"].where(F.col(side).isNotNull()).select("event_id", F.col(side).alias("event_team_id"))
        bad = named.join(known, ["event_id", "event_team_id"], "left_anti").first()
        if bad is not None:
            raise ValueError(f"a game names unknown team {bad['event_team_id']} of event {bad['event_id']}")
    if "status" in incoming["games"].columns:
        bad = incoming["games"].where("status in ('played', 'has_outcome', 'Final') and (home_score is null or away_score is null)").first()
        if bad is not None:
            raise ValueError(f"played game {bad['game_key']} of event {bad['event_id']} has no score")
    for name in ("roster_entries", "standings"):
        if name in incoming:
            bad = incoming[name].join(known.select("event_team_id"), "event_team_id", "left_anti").first()
            if bad is not None:
                raise ValueError(f"{name} name unknown team {bad['event_team_id']}")
    gone = tables["event_teams"].join(event_ids.select("event_id").distinct(), "event_id", "left_semi").select("event_team_id")
    out = {}
    for name, table in tables.items():
        by = "event_id" if "event_id" in table.columns else "event_team_id"
        ids = event_ids.select("event_id").distinct() if by == "event_id" else gone
        kept = table.join(ids, by, "left_anti")
        out[name] = kept.unionByName(incoming[name].distinct()) if name in incoming else kept
    return out


def drop_reseeded(games: DataFrame, incoming: DataFrame) -> DataFrame:
    """Games with the incoming ones in, without placeholders of slots that came under another key.

    Old rows without a slot are placeholders if their key is 'pool-' or
    'bracket-' and an incoming slot of the event.
    """
    taken = incoming.where("slot is not null").select("event_id", F.col("slot").cast("string").alias("_slot")).distinct()
    kept = games.join(incoming.select("event_id", "game_key"), ["event_id", "game_key"], "left_anti")
    kept = kept.withColumn("_slot", F.coalesce(F.col("slot").cast("string"), F.regexp_extract(F.col("game_key").cast("string"), "^(?:pool|bracket)-(.*)$", 1)))
    return kept.join(taken, ["event_id", "_slot"], "left_anti").select(*games.columns).unionByName(incoming.select(*games.columns))


def mark_complete(events: DataFrame, teams: DataFrame, rosters: DataFrame, as_of: str) -> DataFrame:
    """Whether an event has ended and has no schedule, or no team without a roster (S13). Events without an end are not complete."""
    has = rosters.select("event_team_id").distinct().withColumn("has", F.lit(1))
    lack = teams.join(has, "event_team_id", "left").groupBy("event_id").agg(F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).alias("lacking"))
    over = F.coalesce(F.col("end_date") < F.lit(as_of).cast("date"), F.lit(False))
    bare = ~F.coalesce("has_schedule", F.lit(True)) if "has_schedule" in events.columns else F.lit(False)
    return events.join(lack, "event_id", "left").select("event_id", (over & (bare | (F.coalesce("lacking", F.lit(0)) == 0))).alias("complete"))


def merge_divisions(main: DataFrame, source: DataFrame, division: str, offset: int) -> DataFrame:
    """``main`` without a division, plus that division's rows of ``source`` with shifted ids."""
    moved = source.where(F.col("division") == division).withColumn("event_id", F.col("event_id") + offset)
    return main.where(F.col("division") != division).unionByName(moved, allowMissingColumns=True)


def stale_events(events: DataFrame, games: DataFrame, as_of: str, seasons: list[int] | None = None) -> DataFrame:
    """Past events without games or with unplayed ones (S16): (event_id, n_games, n_open)."""
    played = (F.col("status") == "Final") & (F.col("home_score") + F.col("away_score") > 0)
    state = games.groupBy("event_id").agg(F.count("*").alias("n_games"), F.sum(F.when(F.coalesce(played, F.lit(False)), 0).otherwise(1)).alias("n_open"))
    past = events.where(F.coalesce("end_date", "start_date") < F.lit(as_of).cast("date"))
    past = past.where(F.col("season").isin(seasons)) if seasons else past
    out = past.join(state, "event_id", "left").fillna(0, ["n_games", "n_open"])
    return out.where("n_games = 0 or n_open > 0").select("event_id", "n_games", "n_open")


def refresh_plan(ours: DataFrame, stale: DataFrame, offered: DataFrame, as_of: str) -> DataFrame:
    """What to fetch from a provider (S17): (url, action), 'replace' for stale events of which it has more played games, 'add' for past events never seen.

    ours: (event_id, url); stale as from ``stale_events``; offered: (url, name,
    start_date, end_date, played). Cancelled events and such that are not over
    are not added, nor any without a played game. Urls are compared without a
    trailing slash.
    """
    plain = lambda df: df.withColumn("url", F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", ""))
    known = plain(ours).select("url", "event_id").join(stale.select("event_id", (F.col("n_games") - F.col("n_open")).alias("own"), F.lit(True).alias("stale")), "event_id", "left")
    both = plain(offered).join(known, "url", "left")
    over = F.coalesce("end_date", "start_date") < F.lit(as_of).cast("date")
    add = F.col("event_id").isNull() & over & ~F.lower(F.coalesce("name", F.lit(""))).contains("cancel") & (F.col("played") > 0)
    action = F.when(F.col("stale") & (F.col("played") > F.col("own")), "replace").when(add, "add")
    return both.select("url", action.alias("action")).where("action is not null")


def compare_providers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per event of both providers, the sorted score pairs that only one of them has."""
    def scores(df: DataFrame) -> DataFrame:
        ok = df.where("status = 'Final' and home_score + away_score > 0")
        return ok.select("event_id", F.greatest("home_score", "away_score").alias("hi"), F.least("home_score", "away_score").alias("lo"))

    ca, cb = (scores(x).groupBy("event_id", "hi", "lo").agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb")))
    each = ca.join(cb, ["event_id", "hi", "lo"], "full").fillna(0, ["na", "nb"])
    return each.groupBy("event_id").agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("only_b")
    ).where("n_a > 0 and n_b > 0")


def attach_structure(games: DataFrame, published: DataFrame) -> DataFrame:
    """Published stages joined on the unordered pair of teams and of scores, where that is unique on both sides."""
    key = [
        F.least("home_id", "away_id").alias("t1"), F.greatest("home_id", "away_id").alias("t2"),
        F.least("home_score", "away_score").alias("s1"), F.greatest("home_score", "away_score").alias("s2"),
    ]
    on = ["event_id", "t1", "t2", "s1", "s2"]
    alone = lambda df: df.withColumn("_n", F.count("*").over(W.partitionBy(*on))).where("_n = 1").drop("_n")
    left = alone(games.select("event_id", "game_key", *key))
    right = alone(published.select("event_id", *key, F.col("stage").alias("stage_pub")))
    return left.join(right, on).select("event_id", "game_key", "stage_pub")


def event_list_filter(events: DataFrame) -> DataFrame:
    """Events that belong to their division by name.

    Cancelled ones never do; developmental ones not to a college division, of
    which the D-III ones take the D-III names and the others the rest; names of
    age-restricted series not to a club division.
    """
    fits = lambda pattern: F.col("name").rlike("(?i)" + pattern)
    division = F.coalesce("division", F.lit("club-men"))
    college = ~fits(vocab.DEVELOPMENTAL_NAME) & (fits(vocab.D3_NAME) == division.endswith("-d3"))
    ok = F.when(division.startswith("college"), college).when(division.startswith("club"), ~fits(vocab.AGE_NAME)).otherwise(True)
    return events.where(ok & ~F.lower("name").contains("cancel"))


def division_scope(games: DataFrame, members: DataFrame) -> DataFrame:
    """Games by division (S21): both teams are members of it, or the event has that division alone."""
    n = members.select("event_id", "division").distinct().withColumn("n", F.count("*").over(W.partitionBy("event_id")))
    sole = games.join(n.where("n = 1").select("event_id", "division"), "event_id")
    several = games.join(n.where("n > 1").select("event_id", "division"), "event_id")
    m = members.select("event_id", "division", "event_team_id")
    for side in ("home_id", "away_id"):
        several = several.join(m.withColumnRenamed("event_team_id", side), ["event_id", "division", side], "left_semi")
    return sole.unionByName(several).select("division", "event_id", "game_key")


def link_sources(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Source ids with their one local key (S24); raises if a source id has two.

    Rows may carry source_url, observed_at and payload_hash; the incoming ones count.
    """
    key = [c for c in ("source", "entity_type", "source_id") if c in current.columns]
    rest = [c for c in current.columns if c not in (*key, "local_key")]
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.select(*current.columns).withColumn("_new", F.lit(1)))
    out = both.groupBy(*key).agg(F.min("local_key").alias("local_key"), F.max("local_key").alias("_other"), F.max_by(F.struct(F.lit(0).alias("_"), *rest), "_new").alias("x"))
    bad = out.where("local_key <> _other").first()
    if bad is not None:
        raise ValueError(f"{bad['source']} {bad['source_id']} has two local keys")
    return out.select(*key, "local_key", *[F.col(f"x.{c}").alias(c) for c in rest])


def observe(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Observations of resources, one per (source, resource_type, source_id, source_url, payload_hash), with the latest time, state and count."""
    key = ["source", "resource_type", "source_id", "source_url", "payload_hash"]
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.select(*current.columns).withColumn("_new", F.lit(1)))
    rest = ["observed_at", "state", "record_count"]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_new", "observed_at")).alias("x")).select(*key, "x.*")


def roster_fallback(rosters: DataFrame, teams: DataFrame, index: DataFrame, per_team: int = 5) -> DataFrame:
    """Rosters with index rows added for events of fewer than ``per_team`` lines a team."""
    lines = rosters.select("event_team_id").join(teams.select("event_team_id", "event_id"), "event_team_id").groupBy("event_id").agg(F.count("*").alias("lines"))
    thin = teams.groupBy("event_id").agg(F.count("*").alias("n")).join(lines, "event_id", "left").where(F.coalesce("lines", F.lit(0)) < per_team * F.col("n"))
    known = teams.join(thin.select("event_id"), "event_id", "left_semi").select("event_team_id")
    extra = index.join(known, "event_team_id", "left_semi").select("event_team_id", "player_id")
    have = rosters.select("event_team_id", "player_id")
    return have.unionByName(extra.join(have, ["event_team_id", "player_id"], "left_anti").distinct())


def load_season_stat_events(stats: DataFrame, links: DataFrame, scale: float = 1 / 3) -> DataFrame:
    """Stat lines of a whole season (S4), dated 1 September: usage is the share of points played on the full team, quality is scaled.

    stats: (pro_id, team_id, year, points_played, quality); links: (pro_id,
    player_id). Teams with fewer than two linked players give nothing.
    """
    w = W.partitionBy("team_id", "year")
    rows = stats.withColumn("total", F.sum("points_played").over(w)).withColumn("n", F.count("*").over(w)).where("total > 0 and n >= 2").join(links, "pro_id")
    rows = rows.withColumn("linked", F.count("*").over(w)).where("linked >= 2")
    return rows.select("team_id", F.make_date("year", F.lit(9), F.lit(1)).alias("end_date"), "player_id", (F.col("points_played") * F.col("n") / F.col("total")).alias("usage"), (F.col("quality") * scale).alias("quality"))


def load_pro_games(games: DataFrame, played: DataFrame, links: DataFrame, min_linked: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(games, rosters, clubs) of a professional league.

    games: (game_id, year, date, home_team_id, away_team_id, home_score,
    away_score, status), of which the final ones with scores count; played:
    (game_id, team_id, pro_id, points_played); links: (pro_id, player_id). A
    roster are the linked players who took the field, if there are ``min_linked``.
    """
    key = lambda team: F.concat_ws(":", F.lit("ufa"), F.col("game_id").cast("string"), F.col(team).cast("string"))
    done = games.where("status = 'Final' and home_score is not null and away_score is not null")
    day = F.coalesce("date", F.make_date("year", F.lit(6), F.lit(1)))
    out = done.select(
        F.lit(0).cast("long").alias("event_id"), F.col("game_id").cast("long").alias("game_key"), F.col("year").cast("int").alias("season"), F.lit("ufa").alias("division"), day.alias("date"), F.lit("12:00").alias("clock"),
        F.lit(None).cast("string").alias("stage"), key("home_team_id").alias("home_id"), key("away_team_id").alias("away_id"), "home_score", "away_score",
    )
    clubs = done.select(key("home_team_id").alias("event_team_id"), F.col("home_team_id").alias("t")).unionByName(done.select(key("away_team_id").alias("event_team_id"), F.col("away_team_id").alias("t")))
    rows = played.where("points_played > 0").join(links, "pro_id").withColumn("event_team_id", key("team_id")).select("event_team_id", "player_id")
    enough = rows.groupBy("event_team_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_linked).select("event_team_id")
    rosters = rows.join(enough, "event_team_id", "left_semi").join(clubs.select("event_team_id"), "event_team_id", "left_semi")
    return out, rosters, clubs.select("event_team_id", F.concat(F.lit("ufa-"), F.col("t").cast("string")).alias("club")).distinct()


def pro_roster_sizes(games: DataFrame, lineups: DataFrame, links: DataFrame, min_linked: int = 7) -> DataFrame:
    """The rosters of ``load_pro_games`` with their number of players, (event_team_id, n), where a team's line-up is that of its year in all games.

    lineups: (team_id, year, pro_id, points_played). A line-up is counted once, not in each of its games.
    """
    done = games.where("status = 'Final' and home_score is not null and away_score is not null")
    sides = done.select("game_id", "year", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    size = lineups.where("points_played > 0").join(links, "pro_id").groupBy("team_id", "year").agg(F.count("*").alias("n"))
    key = F.concat_ws(":", F.lit("ufa"), F.col("game_id").cast("string"), F.col("team_id").cast("string"))
    return sides.join(size, ["team_id", "year"]).groupBy(key.alias("event_team_id")).agg(F.sum("n").alias("n")).where(F.col("n") >= min_linked)


def load_season_rosters(observations: DataFrame, entries: DataFrame, event_teams: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, teams) of a corpus whose rosters are those of a season.

    observations: (roster_id, season, division, team_name); entries: (roster_id,
    name_key, player_name); event_teams: (event_team_id, season, division,
    full_name, display_name); bridges: (compact, player_id). ``people`` has the
    players of each roster once, with the id of the bridged player or one made of
    the name, and of division and team too where a compact name stands on two
    teams of a season's division; ``teams`` has the roster of each event team,
    found by its full and then its display name. An event team without a roster
    raises ValueError.
    """
    obs = observations.withColumn("team_key", names.team_name_key(F.col("team_name")))
    rows = entries.join(obs, "roster_id").withColumn("compact", names.compact_name_key(F.col("name_key")))
    twice = rows.groupBy("compact", "season", "division").agg(F.min("team_key").alias("a"), F.max("team_key").alias("b")).where("a <> b").select("compact").distinct()
    rows = rows.join(twice.withColumn("collides", F.lit(True)), "compact", "left").join(bridges.select("compact", F.col("player_id").alias("bridged")), "compact", "left")
    key = F.when(F.col("collides"), F.concat_ws("|", "compact", "division", "team_key")).otherwise(F.col("compact"))
    own = F.coalesce(F.when(F.col("collides").isNull(), F.col("bridged")), names.stable_id("eucs-ranking", key))
    people = rows.select("season", "division", "team_key", own.alias("player_id"), "player_name").groupBy("season", "division", "team_key", "player_id").agg(F.min("player_name").alias("player_name"))
    club = lambda k: F.concat_ws(":", F.lit("euf"), "division", k)
    ask = event_teams.withColumns({"k1": names.team_name_key(F.col("full_name")), "k2": names.team_name_key(F.col("display_name"))})
    have = obs.select("season", "division", "team_key").distinct()
    for k in ("k1", "k2"):
        ask = ask.join(have.select("season", "division", F.col("team_key").alias(k), F.lit(True).alias(f"has_{k}")), ["season", "division", k], "left")
    found = ask.withColumn("team_key", F.when(F.col("has_k1"), F.col("k1")).when(F.col("has_k2"), F.col("k2")))
    bad = found.where("team_key is null").first()
    if bad is not None:
        raise ValueError(f"no season roster for event team {bad['event_team_id']}")
    return people, found.select("event_team_id", "season", "division", "team_key", club("team_key").alias("club"))


def load_international_games(games: DataFrame, events: DataFrame) -> DataFrame:
    """Rated games of international events (S8): played ones with teams, scores and at least 4 points. The date is not kept within the event."""
    e = events.select("event_id", "season", "division", "start_date")
    day = F.coalesce("date", "start_date", F.make_date("season", F.lit(1), F.lit(1)))
    ok = games.where("status in ('played', 'has_outcome') and home_id is not null and away_id is not null and home_score + away_score >= 4")
    return ok.join(e, "event_id").select(
        (-F.col("event_id")).alias("event_id"), "game_key", "season", "division", day.alias("date"), F.coalesce("time", F.lit("23:59")).alias("clock"), "stage",
        F.concat(F.lit("wfdf:"), "home_id").alias("home_id"), F.concat(F.lit("wfdf:"), "away_id").alias("away_id"), "home_score", "away_score",
    )


def load_international_clubs(teams: DataFrame, matched: DataFrame) -> DataFrame:
    """The club of each team at an international event (S8): the one it is matched with, if clubs compete there, else one of its own country and name.

    teams: (event_team_id, division, display_name, country, competition), the
    competition being club or national; matched: (event_team_id, club).
    """
    key = lambda c: names.team_name_key(F.col(c))
    kind = F.when(F.col("competition") == "national", "national").otherwise("club")
    own = F.concat(F.lit("wfdf-"), kind, F.lit(":"), F.col("division"), F.lit(":"), key("country"), F.lit(":"), key("display_name"))
    out = teams.join(matched.select("event_team_id", F.col("club").alias("_m")), "event_team_id", "left")
    return out.select("event_team_id", F.coalesce(F.when(F.col("competition") == "club", F.col("_m")), own).alias("club"))
