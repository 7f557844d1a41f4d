"""Pages over events, games and teams, and publication audits."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake import vocab
from rosterlake.functions import names


def _page(rows: DataFrame, order: list, first: int, offset: int) -> DataFrame:
    if not 1 <= first <= 200 or offset < 0:
        raise ValueError("first must be 1 to 200 and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(first)


class Page(NamedTuple):
    """``nodes``: the rows of a page; ``total``: one row with total_count and has_next_page."""

    nodes: DataFrame
    total: DataFrame


def _paged(rows: DataFrame, order: list, first: int, offset: int) -> Page:
    count = rows.agg(F.count("*").alias("total_count"))
    return Page(_page(rows, order, first, offset), count.withColumn("has_next_page", F.col("total_count") > offset + first))


def filtered_events(events: DataFrame, games: DataFrame, teams: DataFrame, sources: DataFrame | None = None, source: str | None = None, event_code: str | None = None, season: int | None = None, division: str | None = None, team: str | None = None, played: bool | None = None) -> DataFrame:
    """Events that pass all filters given: a source of the event or its division, code, season, division, part of a team's name, any played or any unplayed game."""
    rows = events
    for column, value in (("event_code", event_code), ("season", season), ("division", division)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    if source is not None:
        known = sources.where((F.col("source") == source) & F.col("entity_type").isin("event", "division")).select(F.col("local_key").cast("long").alias("event_id"))
        rows = rows.join(known, "event_id", "left_semi")
    if team is not None:
        rows = rows.join(teams.where(F.lower("display_name").contains(team.lower())).select("event_id"), "event_id", "left_semi")
    if played is not None:
        done = F.coalesce(F.col("state").isin(vocab.PLAYED_STATES), F.lit(False)) if "state" in games.columns else F.col("status") == "Final"
        rows = rows.join(games.where(done if played else ~done).select("event_id"), "event_id", "left_semi")
    return rows


def events_page(events: DataFrame, games: DataFrame, teams: DataFrame, sources: DataFrame | None = None, first: int = 50, offset: int = 0, **filters) -> Page:
    """A page of the events of ``filtered_events`` by date downwards and id, and their number (Q1)."""
    return _paged(filtered_events(events, games, teams, sources, **filters), [F.desc("start_date"), "event_id"], first, offset)


def games_page(games: DataFrame, teams: DataFrame, events: DataFrame, sources: DataFrame | None = None, event_id: int | None = None, first: int = 50, offset: int = 0, **filters) -> Page:
    """A page of games with both teams' names by date, time and key, and their number (Q2): of an event, or of the events of ``filtered_events``; ``played`` is asked of the game."""
    played = filters.pop("played", None)
    rows = games.where(F.col("event_id") == event_id) if event_id is not None else games
    if any(v is not None for v in filters.values()):
        rows = rows.join(filtered_events(events, games, teams, sources, **filters).select("event_id"), "event_id", "left_semi")
    if played is not None:
        done = F.col("status") == "Final"
        rows = rows.where(done if played else ~F.coalesce(done, F.lit(False)))
    for side in ("home", "away"):
        rows = rows.join(teams.select(F.col("event_team_id").alias(f"{side}_id"), F.col("display_name").alias(f"{side}_name")), f"{side}_id", "left")
    cols = ["event_id", "game_key", "date", "time", "home_name", "away_name", "home_score", "away_score"]
    return _paged(rows.select(*cols), [F.asc_nulls_last("date"), F.asc_nulls_last("time"), "game_key"], first, offset)


def teams_page(teams: DataFrame, event_teams: DataFrame, rankings: DataFrame, events: DataFrame, sources: DataFrame | None = None, source: str | None = None, event_code: str | None = None, season: int | None = None, division: str | None = None, name: str | None = None, first: int = 50, offset: int = 0) -> Page:
    """A page of teams by name and id, and their number (Q3).

    teams: (team_id, name); event_teams: (team_id, event_id); rankings:
    (team_id, season, division). Season and division are each met by an event
    of the team or by a ranking of it.
    """
    rows = teams
    if source is not None:
        rows = rows.join(sources.where((F.col("source") == source) & (F.col("entity_type") == "team")).select(F.col("local_key").alias("team_id")), "team_id", "left_semi")
    if name is not None:
        rows = rows.where(F.lower("name").contains(name.lower()))
    at = event_teams.join(events, "event_id")
    if event_code is not None:
        rows = rows.join(at.where(F.col("event_code") == event_code).select("team_id"), "team_id", "left_semi")
    for column, value in (("season", season), ("division", division)):
        if value is not None:
            fits = at.where(F.col(column) == value).select("team_id").unionByName(rankings.where(F.col(column) == value).select("team_id"))
            rows = rows.join(fits, "team_id", "left_semi")
    return _paged(rows, ["name", "team_id"], first, offset)


def source_refs(sources: DataFrame, keys: DataFrame, entity_types: tuple[str, ...] = ("event", "division")) -> DataFrame:
    """The references of each entity, each once, in order (Q6): (local_key, refs). sources: (source, entity_type, source_id, local_key, source_url, payload_hash)."""
    rows = sources.where(F.col("entity_type").isin(*entity_types)).join(keys.select("local_key").distinct(), "local_key", "left_semi")
    ref = F.struct("source", "source_id", "source_url", "payload_hash")
    return rows.groupBy("local_key").agg(F.array_sort(F.collect_set(ref)).alias("refs"))


def event_standings(standings: DataFrame, teams: DataFrame, event_id: int | None = None) -> DataFrame:
    """Standings of an event, or of all, with team names, by place; tied places stay (Q7). standings: (event_id, event_team_id, place, division, source)."""
    rows = standings.where(F.col("event_id") == event_id) if event_id is not None else standings
    return rows.join(teams.select("event_team_id", "display_name"), "event_team_id").select("event_id", "place", "division", "event_team_id", F.col("display_name").alias("team"), "source")


def games_by_event(games: DataFrame, first: int = 3, offset: int = 0) -> DataFrame:
    """A page of games of every event in one pass (Q5)."""
    w = W.partitionBy("event_id").orderBy(F.asc_nulls_last("date"), F.asc_nulls_last("time"), "game_key")
    rows = games.withColumn("r", F.row_number().over(w))
    return rows.where((F.col("r") > offset) & (F.col("r") <= offset + first)).select("event_id", "game_key", F.col("r").cast("long").alias("r"))


def team_rosters(event_teams: DataFrame, availability: DataFrame, rankings: DataFrame) -> DataFrame:
    """Whether a team's roster is public (true), known to be empty (false) or unknown (null) (Q4).

    event_teams: (team_id, event_id); availability: (event_id, state); rankings:
    (team_id, record_count). A public event or a ranking roster with players
    makes it true, an empty event or a ranking roster alone false.
    """
    states = event_teams.join(availability, "event_id").groupBy("team_id").agg(F.max(F.col("state") == "public").alias("public"), F.max(F.col("state") == "empty").alias("empty"))
    ranked = rankings.groupBy("team_id").agg(F.max("record_count").alias("most"))
    both = event_teams.select("team_id").unionByName(rankings.select("team_id")).distinct().join(states, "team_id", "left").join(ranked, "team_id", "left")
    yes = F.coalesce("public", F.lit(False)) | F.coalesce(F.col("most") > 0, F.lit(False))
    no = F.coalesce("empty", F.lit(False)) | F.col("most").isNotNull()
    return both.select("team_id", F.when(yes, True).when(no, False).alias("available"))


def team_players(entries: DataFrame, event_teams: DataFrame, ranking_entries: DataFrame, available: DataFrame) -> DataFrame:
    """The names on a team's event rosters and ranking rosters, each once (Q4); teams of unknown availability have none. entries: (event_team_id, name); ranking_entries: (team_id, name)."""
    own = entries.join(event_teams.select("event_team_id", "team_id"), "event_team_id").select("team_id", "name")
    known = available.where("available is not null").select("team_id")
    return own.unionByName(ranking_entries.select("team_id", "name")).distinct().join(known, "team_id", "left_semi")


def event_roster_entries(entries: DataFrame, event_teams: DataFrame, events: DataFrame) -> DataFrame:
    """All roster lines of teams with their events (Q4)."""
    e = events.select("event_id", F.col("name").alias("event"), "season", "division", "start_date")
    return entries.join(event_teams.select("event_team_id", "team_id", "event_id"), "event_team_id").join(e, "event_id")


def roster_state(teams: DataFrame, rosters: DataFrame) -> DataFrame:
    """public, partial or unavailable for each event: all, some or none of its teams have a roster (A5)."""
    has = rosters.select("event_team_id").distinct().withColumn("_has", F.lit(1))
    n = teams.join(has, "event_team_id", "left").groupBy("event_id").agg(F.count("*").alias("n_teams"), F.count("_has").alias("n_rosters"))
    state = F.when(F.col("n_rosters") == F.col("n_teams"), "public").when(F.col("n_rosters") > 0, "partial").otherwise("unavailable")
    return n.select("event_id", "n_teams", "n_rosters", state.alias("state"))


def publication_audit(events: DataFrame, games: DataFrame, teams: DataFrame, sources: DataFrame, standings: DataFrame | None = None, findings: int = 0) -> DataFrame:
    """Findings that block a publication, one row (A1).

    games: with ``status``; sources: (source, entity_type, source_id,
    local_key). Played games need both teams and scores, a source id has one
    local key, and events, games, teams and standings have a source.
    """
    played = F.coalesce(F.col("status").isin("played", "has_outcome", "Final"), F.lit(False))
    lacks = F.col("home_id").isNull() | F.col("away_id").isNull() | F.col("home_score").isNull() | F.col("away_score").isNull()
    parts = [games.where(played & lacks).agg(F.count("*").alias("invalid_games"))]
    twice = sources.groupBy("source", "entity_type", "source_id").agg(F.countDistinct("local_key").alias("n")).where("n > 1")
    parts.append(twice.agg(F.count("*").alias("duplicate_mappings")))
    key = {"event": F.col("event_id").cast("string"), "game": F.concat_ws("|", F.col("event_id").cast("string"), F.col("game_key").cast("string")), "team": F.col("event_team_id")}
    for kind, table in (("event", events), ("game", games), ("team", teams)):
        known = sources.where(F.col("entity_type") == kind).select("local_key").distinct()
        parts.append(table.select(key[kind].alias("local_key")).join(known, "local_key", "left_anti").agg(F.count("*").alias(f"{kind}s_without_source")))
    if standings is not None:
        parts.append(standings.agg(F.count("*").alias("s")).crossJoin(sources.where("entity_type = 'standing'").agg(F.count("*").alias("k"))).select(F.greatest(F.col("s") - F.col("k"), F.lit(0)).alias("standings_without_source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("blocked", reduce(lambda a, b: a + b, [F.col(c) for c in out.columns]) + F.lit(findings) > 0)


def score_conflicts(games: DataFrame, incoming: DataFrame) -> DataFrame:
    """Games on which two sources differ (A2): (event_id, game_key, detail), the detail as JSON.

    Both: (source, source_id, event_id, game_key, date, time, home, away,
    home_score, away_score). An incoming game meets the one of another source
    with its source id in the event, else the one of the same date, hour and
    minute and team names; games without scores meet nothing.
    """
    scored = lambda df: df.where("home_score is not null and away_score is not null")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    slot = lambda df: df.withColumn("slot", F.struct("date", F.substring(F.coalesce("time", F.lit("")), 1, 5).alias("t"), low("home").alias("h"), low("away").alias("a")))
    old = slot(scored(games)).select("event_id", "source_id", "slot", F.struct("source", "game_key", "home_score", "away_score").alias("old"))
    new = slot(scored(incoming))
    by_id = old.select("event_id", "source_id", F.col("old").alias("by_id"))
    by_slot = old.select("event_id", "slot", F.col("old").alias("by_slot")).groupBy("event_id", "slot").agg(F.max("by_slot").alias("by_slot"))
    met = new.join(by_id, ["event_id", "source_id"], "left").join(by_slot, ["event_id", "slot"], "left")
    other = lambda c: F.when(F.col(f"{c}.source") != F.col("source"), F.col(c))
    met = met.withColumn("prior", F.coalesce(other("by_id"), other("by_slot"))).where("prior is not null")
    met = met.where("prior.home_score <> home_score or prior.away_score <> away_score")
    detail = F.struct(
        F.col("prior.source").alias("source_a"), F.array("prior.home_score", "prior.away_score").alias("source_a_score"), F.col("source").alias("source_b"),
        F.array("home_score", "away_score").alias("source_b_score"), F.col("source_id").alias("source_game_id"),
    )
    return met.select("event_id", F.col("prior.game_key").alias("game_key"), F.to_json(detail).alias("detail"))


def merge_team_lists(teams: DataFrame, standings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(teams with place and country, errors): places of a standing put to the teams they name (A4).

    Both: (team_id, division, name, country), standings also place. A placed
    team must be listed, with the same division and name key; otherwise it is an
    error, 'missing' or 'disagreement', and its team keeps no place.
    """
    own = teams.select("team_id", F.col("division").alias("_d"), names.team_name_key(F.col("name")).alias("_k"))
    placed = standings.join(own, "team_id", "left")
    agree = (F.col("division") == F.col("_d")) & (names.team_name_key(F.col("name")) == F.col("_k"))
    checked = placed.withColumn("error", F.when(F.col("_d").isNull(), "missing").when(~agree, "disagreement"))
    good = checked.where("error is null").select("team_id", "place", F.col("country").alias("_country"))
    out = teams.join(good, "team_id", "left").withColumn("country", F.coalesce(F.when(F.col("country") != "", F.col("country")), "_country")).drop("_country")
    return out, checked.where("error is not null").select("team_id", "error")


def validate_events(games: DataFrame) -> DataFrame:
    """Counts per event: games, final ones, draws, without time (A3, M6)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return games.groupBy("event_id").agg(
        F.count("*").alias("n_games"), one(F.col("status") == "Final").alias("n_final"), one(F.col("home_score") == F.col("away_score")).alias("n_draws"), one(F.col("time").isNull()).alias("n_no_time"),
        F.countDistinct("home_id", "away_id").alias("n_pairings"),
    )


def flatten_standings(nested: DataFrame) -> DataFrame:
    """(event_id, stage, place, team) from a map of stage to teams in order; tied teams keep one place."""
    stage = nested.select("event_id", F.explode("stages").alias("stage", "teams"))
    return stage.select("event_id", "stage", F.explode("teams").alias("t")).select("event_id", "stage", "t.place", "t.team")


def response_state(status: Column, n_rows: Column, complete: Column) -> Column:
    """restricted, incomplete, empty or ok."""
    return F.when(status.isin(401, 403), "restricted").when(~complete, "incomplete").when(n_rows == 0, "empty").otherwise("ok")
