"""Fixtures, brackets, pools, champions, series and standings of tournaments."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.functions import measures, names
from rosterlake.operators.graph import written
from rosterlake.operators.identity import with_keys


def fixtures(games: DataFrame) -> DataFrame:
    """Games of an event in playing order: date, minutes, the slot's number, key; a missing date comes last (T1). A published stage counts before the game's own."""
    done = (F.coalesce("status", F.lit("")) == "Final") & (F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0)) > 0)
    order = W.partitionBy("event_id").orderBy(F.asc_nulls_last("date"), measures.minutes_of_day(F.col("time")), measures.slot_number(F.col("slot").cast("string")), F.col("game_key"))
    stage = F.coalesce("stage_pub", "stage") if "stage_pub" in games.columns else F.col("stage")
    return games.select(
        "event_id", "game_key", stage.alias("stage"), "date", "home_id", "away_id", "home_score", "away_score", done.alias("done"), F.row_number().over(order).cast("long").alias("ord")
    )


def labelled(fix: DataFrame) -> DataFrame:
    """Fixtures with the kind of bracket and the round their stage names (F15). A label is read once, not in each of its games."""
    return with_keys(fix, "stage", kind=measures.bracket_kind, round=measures.round_rank)


def champions(fix: DataFrame) -> DataFrame:
    """The winner of the final of an event's first title bracket, by its labels.

    Every final is a tree of its own; the tree of more games comes first, then
    that of the earlier final. Drawn games are in no tree.
    """
    trees = label_brackets(fix).where("kind = 'champ'")
    size = trees.groupBy("event_id", "tree").agg(F.count("*").alias("size"))
    win = measures.winner(F.col("home_score"), F.col("away_score"), F.col("home_id"), F.col("away_id"))
    finals = labelled(fix).where("round = 0").select("event_id", "game_key", "ord", win.alias("champion"))
    roots = trees.where("depth = 0").join(finals, ["event_id", "game_key"]).join(size, ["event_id", "tree"])
    return _first_bracket(roots).select("event_id", "champion")


def _first_bracket(roots: DataFrame) -> DataFrame:
    """Of each event the final whose bracket comes first, from (event_id, size, ord, champion), unless it was drawn."""
    order = W.partitionBy("event_id").orderBy(F.desc("size"), "ord")
    return roots.withColumn("_n", F.row_number().over(order)).where("_n = 1 and champion is not null")


def bracket_trees(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Root and number of steps to it for every game of chains (game, next) (T7), by doubling the steps.

    A game whose chain runs into a circle has no root and is left out.
    """
    now = edges.select("game", F.col("next").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"))
    now = written(now.withColumn("at", F.coalesce("at", "game")), "chain")
    for _ in range(rounds):
        step = now.select(F.col("game").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"))
        new = now.join(step, "at").select("game", F.col("then").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("then") != F.col("at")).alias("moved"))
        new = written(new, "chain")
        if not new.where("moved").limit(1).count():
            now = new
            break
        now = new.drop("moved")
    roots = edges.where("next is null").select(F.col("game").alias("at"))
    return now.join(roots, "at").select("game", F.col("at").alias("root"), "hops")


def series(events: DataFrame) -> DataFrame:
    """Events by series with the series' label: its most frequent name without the year, then the shortest, then the first by season and event."""
    bare = F.btrim(F.regexp_replace("name", r"\s*\b(19|20)\d{2}\b\s*", " "), F.lit(" -\u2013"))
    season = F.col("season") if "season" in events.columns else F.lit(0)
    keyed = events.select("event_id", bare.alias("bare"), names.series_key(F.col("name")).alias("series"), F.struct(season.alias("s"), F.col("event_id").alias("e")).alias("at"))
    counts = keyed.groupBy("series", "bare").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = W.partitionBy("series").orderBy(F.desc("n"), F.length("bare"), "first")
    label = counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("series", F.col("bare").alias("label"))
    size = keyed.groupBy("series").agg(F.count("*").alias("n_events"))
    return keyed.join(label, "series").join(size, "series").select("event_id", "series", "label", "n_events")


def event_facts(events: DataFrame, teams: DataFrame, champs: DataFrame, fix: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Field size, tier, place and champion of every event.

    With ``fix`` and ``as_of`` only events with a game that is done between
    two teams stay, and those without any game that have not started by that day.
    """
    size = teams.groupBy("event_id").agg(F.count("*").alias("n_teams"))
    out = events.join(size, "event_id", "left").join(champs, "event_id", "left")
    if fix is not None and as_of is not None:
        played = F.col("done") & F.col("home_id").isNotNull() & F.col("away_id").isNotNull()
        has = fix.groupBy("event_id").agg(F.max(played).alias("_played"))
        out = out.join(has, "event_id", "left").where(F.col("_played") | (F.col("_played").isNull() & (F.col("start_date") >= F.lit(as_of).cast("date"))))
    place = F.concat_ws(", ", *[c for c in ("city", "state") if c in events.columns])
    return out.select("event_id", "name", "season", "division", "start_date", F.coalesce("n_teams", F.lit(0)).alias("n_teams"), names.tier(F.col("name")).alias("tier"), place.alias("place"), "champion")


def sides(fix: DataFrame) -> DataFrame:
    """Each done game from both teams' side."""
    done = fix.where("done")
    more = [c for c in ("stage", "pool") if c in fix.columns]
    one = done.select("event_id", *more, F.col("home_id").alias("team"), F.col("away_id").alias("rival"), F.col("home_score").alias("own"), F.col("away_score").alias("other"))
    two = done.select("event_id", *more, F.col("away_id").alias("team"), F.col("home_id").alias("rival"), F.col("away_score").alias("own"), F.col("home_score").alias("other"))
    return one.unionByName(two)


def _tables(rows: DataFrame, pool: str) -> DataFrame:
    rows = rows.withColumn("win", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
    table = rows.groupBy("event_id", pool, "team").agg(F.sum("win").alias("wins"), F.sum(F.col("own") - F.col("other")).alias("diff"), F.sum("own").alias("points"))
    tied = rows.join(table.select("event_id", pool, "team", F.col("wins").alias("w")), ["event_id", pool, "team"])
    tied = tied.join(table.select("event_id", pool, F.col("team").alias("rival"), F.col("wins").alias("rw")), ["event_id", pool, "rival"]).where("w = rw")
    head = tied.groupBy("event_id", pool, "team").agg(F.sum("win").alias("head"))
    out = table.join(head, ["event_id", pool, "team"], "left").fillna(0, ["head"])
    w = W.partitionBy("event_id", pool).orderBy(F.desc("wins"), F.desc("head"), F.desc("diff"), F.desc("points"), "team")
    return out.withColumn("place", F.row_number().over(w).cast("long"))


def standings(fix: DataFrame) -> DataFrame:
    """Tables of the pools that stages name: wins, then wins among equals, point difference, points, team (T11). Draws count for neither."""
    return _tables(sides(fix.where(F.col("stage").startswith("Pool"))), "stage")


def pool_standings(fix: DataFrame, pools: DataFrame) -> DataFrame:
    """Tables of pools as from ``recover_pools``, keyed by the pool's number, with its ``later`` flag."""
    rows = fix.where("done").join(pools.select("event_id", "game_key", "pool"), ["event_id", "game_key"])
    rows = written(rows.select("event_id", "pool", "home_id", "away_id", "home_score", "away_score", "done"), "pooled")  # read from both sides, for wins and for those among equals
    later = pools.groupBy("event_id", "pool").agg(F.max("later").alias("later"))
    return _tables(sides(rows), "pool").join(later, ["event_id", "pool"])


def seeds(table: DataFrame) -> DataFrame:
    """Seeds from ``pool_standings``: the pool's letter and the team's place in it; of a team's pools the first, later ones do not count."""
    letter = F.when(F.col("pool") <= 26, F.chr(F.col("pool") + 64)).otherwise(F.col("pool").cast("string"))
    order = W.partitionBy("event_id", "team").orderBy("pool")
    first = table.where("not later").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("event_id", "team", "pool", "place", F.concat(letter, F.col("place").cast("string")).alias("seed"))


def club_records(fix: DataFrame, clubs: DataFrame) -> DataFrame:
    """Wins and losses of a club at an event; draws and games against itself count nothing but make the row."""
    c = clubs.select(F.col("event_team_id").alias("team"), "club")
    rows = sides(fix).join(c, "team").join(clubs.select(F.col("event_team_id").alias("rival"), F.col("club").alias("rival_club")), "rival")
    real = F.col("club") != F.col("rival_club")
    return rows.groupBy("event_id", "club").agg(
        F.sum(F.when(real & (F.col("own") > F.col("other")), 1).otherwise(0)).alias("wins"), F.sum(F.when(real & (F.col("own") < F.col("other")), 1).otherwise(0)).alias("losses")
    )


def _pool_of(a: int, b: int, met: list[int], days: list[list[int]]) -> int:
    """Of the sets of three teams or more around a pair who all met, none of them part of another, the one of the fewest days, then the largest, then the first by names; 0 if there is none.

    A set is the bits of its teams' numbers, as are the teams that each one has
    met; ``days`` has the bit of the day on which each pair meets next. All sets
    are searched but those that cannot come before the best one found: a set
    never has fewer days or more teams to add than a part of it.
    """
    best, fewest, largest = 0, 0, 0
    todo = [(1 << a | 1 << b, days[a][b], met[a] & met[b], 0)]
    while todo:
        team, on, more, gone = todo.pop()
        if best and (n := on.bit_count()) >= fewest:
            if n > fewest or team.bit_count() + more.bit_count() < largest:
                continue
            most = team.bit_count() + _shades(more, met, largest - team.bit_count() + 1)
            if most < largest or most == largest and not _first(team | more, best):
                continue
        if not more:
            if not gone and team.bit_count() > 2:
                best, fewest, largest = team, on.bit_count(), team.bit_count()  # as it has not been passed over
            continue
        # the first of those who met most of the teams to add; who met them all is not outdone
        most, pivot, whole, rest = -1, 0, more.bit_count() - (not gone), more | gone
        while rest:
            bit = rest & -rest
            t = bit.bit_length() - 1
            n = (more & met[t]).bit_count()
            if n > most:
                most, pivot = n, t
                if n >= whole:
                    break
            rest ^= bit
        rest, next_ = more & ~met[pivot], []
        while rest:
            bit = rest & -rest
            t = bit.bit_length() - 1
            then, mates, with_ = on, team, days[t]
            while mates:
                mate = mates & -mates
                then |= with_[mate.bit_length() - 1]
                mates ^= mate
            next_.append((team | bit, then, more & met[t], gone & met[t]))
            more ^= bit
            gone |= bit
            rest ^= bit
        todo += reversed(next_)  # the first names first
    return best


def _shades(more: int, met: list[int], enough: int) -> int:
    """The most teams of ``more`` who can all have met: as many as there are groups of teams none of whom met, counted up to ``enough``."""
    n = 0
    while more and n < enough:
        n += 1
        rest = more
        while rest:
            bit = rest & -rest
            rest &= ~met[bit.bit_length() - 1] & ~bit
            more ^= bit
    return n


def _first(teams: int, best: int) -> bool:
    """Whether some of ``teams``, as many as ``best`` has, can come before it by names."""
    new, lost = teams & ~best, best & ~teams
    return bool(new) and (not lost or (new & -new) < (lost & -lost))


def _members(team: int) -> list[int]:
    """The numbers of a set's teams in order."""
    return [i for i in range(team.bit_length()) if team >> i & 1]


def pools_of(games: list[tuple]) -> list[tuple[int, object, bool]]:
    """(number of the pool, game, whether a later one) from games (ord, key, day, home, away) in order; games in no pool are left out.

    The earliest game that is not placed seeds a pool: of the sets of three teams
    or more who all met, through both its teams, the one whose games, the first
    open one of each pair, fall on the fewest days, then the larger, then the
    first by names. A pool takes one game of each pair; a second meeting is left
    for a later pool. A pool is a later one if a team of it was in one before.
    """
    teams = sorted({t for g in games for t in g[3:5]})
    number = {t: i for i, t in enumerate(teams)}
    day_bit: dict = {}
    days, met = [[0] * len(teams) for _ in teams], [0] * len(teams)
    open_: dict[tuple[int, int], list[int]] = {}  # the games of a pair, the next one last
    sides, bits = [], []
    for n, g in enumerate(games):
        a, b = sorted((number[g[3]], number[g[4]]))
        sides.append((a, b))
        bits.append(day_bit.setdefault(g[2], 1 << len(day_bit)))
        open_.setdefault((a, b), []).append(n)
    for (a, b), part in open_.items():
        part.reverse()
        met[a] |= 1 << b
        met[b] |= 1 << a
        days[a][b] = days[b][a] = bits[part[-1]]
    placed, found = [False] * len(games), []

    def take(a: int, b: int) -> int:
        part = open_[a, b]
        n = part.pop()
        placed[n] = True
        if part:
            days[a][b] = days[b][a] = bits[part[-1]]
        else:
            met[a] &= ~(1 << b)
            met[b] &= ~(1 << a)
        return n

    for n, (a, b) in enumerate(sides):
        if placed[n]:
            continue
        best = _pool_of(a, b, met, days)
        if not best:
            take(a, b)
            continue
        members = _members(best)
        found.append((best, sorted(take(x, y) for i, x in enumerate(members) for y in members[i + 1 :])))
    found.sort(key=lambda pool: pool[1][0])
    out, before = [], 0
    for n, (team, part) in enumerate(found, 1):
        later = bool(before & team)
        out += [(n, games[i][1], later) for i in part]
        before |= team
    return out


_POOLS = "event_id long, pool long, game_key long, later boolean"


def recover_pools(fix: DataFrame) -> DataFrame:
    """Pools of events from who met whom (T2): (event_id, pool, game_key, later). A group is the games of one event."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf["home_id"] != pdf["away_id"]].sort_values("ord")
        games = [(r.ord, r.game_key, str(r.date), r.home_id, r.away_id) for r in rows.itertuples()]
        event = pdf["event_id"].iloc[0]
        return pd.DataFrame([(event, *x) for x in pools_of(games)], columns=["event_id", "pool", "game_key", "later"])

    rows = fix.where("done and home_id is not null and away_id is not null").select("event_id", "game_key", "ord", "date", "home_id", "away_id")
    return rows.groupBy("event_id").applyInPandas(run, _POOLS)


def published_brackets(fix: DataFrame) -> DataFrame:
    """Brackets that a provider published (T4): those with exactly one game in the last round, 0; (event_id, bracket, kind, n_games).

    The kind comes from the place, 1 being the title, else from the stage of
    the last game, which names no place if it is the title's. fix: (event_id,
    bracket, round, place, stage, game_key).
    """
    rows = fix.where("bracket is not null and round is not null")
    root = rows.groupBy("event_id", "bracket").agg(
        F.sum(F.when(F.col("round") == 0, 1).otherwise(0)).alias("roots"), F.min(F.when(F.col("round") == 0, F.col("stage"))).alias("root_stage"), F.min("place").alias("place"), F.count("*").alias("n_games")
    )
    named = F.coalesce(measures.bracket_kind(F.col("root_stage")), F.lit("champ"))
    kind = F.when(F.col("place") == 1, "champ").when(F.col("place") > 1, measures.ordinal(F.col("place"))).otherwise(named)
    return root.where("roots = 1").select("event_id", "bracket", kind.alias("kind"), "n_games")


def bracket_slots(fix: DataFrame) -> DataFrame:
    """The brackets that stage labels name as padded trees (T3): (event_id, kind, tree, depth, slot, game_key, ord).

    Every final of a kind of bracket roots a tree; without one all games of the
    innermost round that there is are the roots of one tree. The slots 2 s and
    2 s + 1 of the next depth lead to the home and the away team of slot s: each
    holds the game of the next round that the team won, or null for a bye or a
    team that came from elsewhere. A game stands in one slot: of several
    requests for a team's games, by tree and slot, the first gets the first. A
    tree ends above the first depth without a game. Drawn games are in no tree.
    """
    win = measures.winner(F.col("home_score"), F.col("away_score"), F.col("home_id"), F.col("away_id"))
    rows = labelled(fix).where("kind is not null and done").withColumn("winner", win).where("winner is not null")
    rows = rows.withColumn("inner", F.min("round").over(W.partitionBy("event_id", "kind")))
    own = W.partitionBy("event_id", "kind", "round", "winner").orderBy("ord")
    rows = rows.select("event_id", "kind", "inner", "round", "game_key", "ord", "home_id", "away_id", F.col("winner").alias("team"), F.row_number().over(own).alias("nth"))
    rows = written(rows, "knockout")
    n = F.row_number().over(W.partitionBy("event_id", "kind").orderBy("ord")).cast("long")
    final = F.col("inner") == 0
    level = rows.where("round = inner").select("event_id", "kind", F.when(final, n).otherwise(1).cast("long").alias("tree"), F.lit(0).cast("long").alias("depth"), F.when(final, 0).otherwise(n - 1).cast("long").alias("slot"), "game_key", "ord", "home_id", "away_id")
    levels = [written(level, "slots")]
    asks = W.partitionBy("event_id", "kind", "team").orderBy("tree", "slot")
    while True:
        depth = len(levels)
        sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("home_id").alias("team")), F.struct(F.lit(1).alias("side"), F.col("away_id").alias("team")))).alias("s")
        asked = levels[-1].select("event_id", "kind", "tree", "slot", sides).select("event_id", "kind", "tree", (2 * F.col("slot") + F.col("s.side")).alias("slot"), "s.team")
        asked = asked.withColumn("nth", F.row_number().over(asks))
        feeders = rows.where(F.col("round") == F.col("inner") + depth).select("event_id", "kind", "team", "nth", "game_key", "ord", "home_id", "away_id")
        level = asked.join(feeders, ["event_id", "kind", "team", "nth"], "left")
        level = level.withColumn("any", F.max(F.col("game_key").isNotNull()).over(W.partitionBy("event_id", "kind", "tree"))).where("any")
        level = written(level.select("event_id", "kind", "tree", F.lit(depth).cast("long").alias("depth"), "slot", "game_key", "ord", "home_id", "away_id"), "slots")
        if not level.limit(1).count():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("home_id", "away_id")


def label_brackets(fix: DataFrame) -> DataFrame:
    """The games of ``bracket_slots``: (event_id, kind, tree, game_key, depth)."""
    return bracket_slots(fix).where("game_key is not null").select("event_id", "kind", "tree", "game_key", "depth")


def bracket_order(slots: DataFrame) -> DataFrame:
    """The brackets of ``bracket_slots`` with their number of games and their place in an event's order.

    The title's come first, then those for a place by that place, then others;
    larger trees before smaller ones, then kinds and trees in playing order.
    """
    trees = slots.groupBy("event_id", "kind", "tree").agg(F.count("game_key").alias("n_games"))
    kinds = slots.groupBy("event_id", "kind").agg(F.min("ord").alias("first"))
    place = F.regexp_extract("kind", r"^(\d+)(?:st|nd|rd|th)$", 1).try_cast("int")
    group = F.when(F.col("kind") == "champ", 0).when(place.isNotNull(), 1).otherwise(2)
    order = W.partitionBy("event_id").orderBy("group", F.coalesce("number", F.lit(0)), F.desc("n_games"), "first", "tree")
    rows = trees.join(kinds, ["event_id", "kind"]).withColumns({"group": group, "number": place})
    return rows.withColumn("position", F.row_number().over(order).cast("long")).select("event_id", "kind", "tree", "n_games", "position")


def decompose(fix: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Where every done game stands (T5): in a bracket, a pool, or loose; one row per game (event_id, game_key, place, bracket, pool).

    Games of published brackets, (event_id, game_key, bracket, round, place,
    stage), come first. Of the rest, games with a pool's label are searched for
    pools, or where an event has none, all games without a knockout's label.
    What is left over is searched for brackets by its labels; a kind that a
    published bracket has is not claimed again. A team's game against itself is
    loose.
    """
    done, brackets, pools = _places(fix, published)
    out = done.select("event_id", "game_key").join(brackets, ["event_id", "game_key"], "left").join(pools.drop("later"), ["event_id", "game_key"], "left")
    place = F.when(F.col("bracket").isNotNull(), "bracket").when(F.col("pool").isNotNull(), "pool").otherwise("loose")
    return out.select("event_id", "game_key", place.alias("place"), "bracket", "pool")


def _places(fix: DataFrame, published: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The done games, their brackets (event_id, game_key, bracket) and their pools as ``recover_pools`` gives them."""
    done = fix.where("done and home_id is not null and away_id is not null")
    real = done.where("home_id <> away_id")
    taken = None
    if published is not None:
        whole = published_brackets(published.join(real.select("event_id", "game_key"), ["event_id", "game_key"], "left_semi"))
        taken = written(published.select("event_id", "game_key", "bracket").join(whole.select("event_id", "bracket", "kind"), ["event_id", "bracket"]).select("event_id", "game_key", "kind"), "taken")
        real = real.join(taken, ["event_id", "game_key"], "left_anti")
    marked = with_keys(real, "stage", poolish=measures.poolish, named=lambda stage: measures.bracket_kind(stage).isNotNull())
    marked = marked.withColumn("any_pool", F.max("poolish").over(W.partitionBy("event_id")))
    marked = written(marked, "marked")
    pools = written(recover_pools(marked.where((F.col("any_pool") & F.col("poolish")) | (~F.col("any_pool") & ~F.col("named")))), "pools")
    rest = marked.join(pools, ["event_id", "game_key"], "left_anti")
    trees = label_brackets(rest)
    if taken is not None:
        trees = trees.join(taken.select("event_id", "kind").distinct(), ["event_id", "kind"], "left_anti")
    brackets = trees.select("event_id", "game_key", F.concat_ws(" ", "kind", "tree").alias("bracket"))
    if taken is not None:
        brackets = brackets.unionByName(taken.select("event_id", "game_key", F.col("kind").alias("bracket")))
    return done, brackets, pools


def decomposed_champions(fix: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """The winner of the final of an event's first title bracket, published or by labels (T6 on T5); a drawn final crowns nobody."""
    done, brackets, _ = _places(fix, published)  # a published bracket may have games that are not done
    rank = F.col("round")
    title = labelled(brackets.where("bracket = 'champ' or bracket like 'champ %'").join(done, ["event_id", "game_key"]))
    if published is not None:
        title = title.join(published.select("event_id", "game_key", F.col("round").alias("_round")), ["event_id", "game_key"], "left")
        rank = F.when(F.col("bracket") == "champ", F.col("_round")).otherwise(rank)
    win = measures.winner(F.col("home_score"), F.col("away_score"), F.col("home_id"), F.col("away_id"))
    title = written(title.withColumn("rank", rank).select("event_id", "bracket", "ord", "rank", win.alias("champion")), "title")
    size = title.groupBy("event_id", "bracket").agg(F.count("*").alias("size"))
    finals = title.where("rank = 0").select("event_id", "bracket", "ord", "champion").join(size, ["event_id", "bracket"])
    return _first_bracket(finals).select("event_id", "champion")


def champion_audit(fix: DataFrame, published: DataFrame) -> DataFrame:
    """Events whose champion differs with and without the published structure (T10): (event_id, by_labels, by_structure)."""
    fix = written(fix, "fixtures")
    plain = decomposed_champions(fix).withColumnRenamed("champion", "by_labels")
    known = decomposed_champions(fix, published).withColumnRenamed("champion", "by_structure")
    return plain.join(known, "event_id", "full").where(~F.col("by_labels").eqNullSafe(F.col("by_structure"))).select("event_id", "by_labels", "by_structure")
