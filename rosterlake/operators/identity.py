"""From names on rosters to players: ambiguity, identity keys, gender evidence and links between corpora.

Inputs of one shape: rosters with (event_team_id, event_id, season, division,
club, name, pronouns, start_date, end_date); ``norm`` is the normal form of name,
``club`` that of the club's name, without a division's suffix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.functions import measures, names
from rosterlake.operators.graph import written


def with_keys(rows: DataFrame, column: str, **keys: Callable) -> DataFrame:
    """The rows with columns that depend on one text alone. Each text is worked on once, as Spark hands every row to a Python function, whatever ``when`` it stands in."""
    texts = rows.select(F.col(column).alias("_text")).distinct()
    texts = written(texts.select("_text", *[f(F.col("_text")).alias(name) for name, f in keys.items()]), "texts")
    return rows.join(texts, rows[column].eqNullSafe(texts["_text"]), "left").drop("_text")


def name_appearances(rows: DataFrame) -> DataFrame:
    """Clubs of each name per division and season (I1). Clubs are grouped first, so that only few of them are sorted for the smallest."""
    each = rows.groupBy("norm", "division", "season", "club").agg(F.count("*").alias("n"))
    return each.groupBy("norm", "division", "season").agg(F.count("club").alias("n_clubs"), F.min("club").alias("first_club"), F.sum("n").alias("n_rows"))


def seen(rows: DataFrame) -> DataFrame:
    """What dates, clubs and divisions tell of the names, without the rows that repeat it."""
    return written(rows.select("norm", "division", "season", "club", "event_id", "start_date", "end_date").distinct(), "seen")


def gender_split(rows: DataFrame) -> DataFrame:
    """Names seen in both men's and women's divisions."""
    g = names.division_gender(F.col("division"))
    return rows.select("norm", g.alias("g")).groupBy("norm").agg(F.countDistinct("g").alias("n")).where("n = 2").select("norm")


def raw_ambiguous(rows: DataFrame) -> DataFrame:
    """Names with two clubs or more in one division and season."""
    return name_appearances(rows).where("n_clubs > 1").select("norm").distinct()


def date_conflicts(rows: DataFrame) -> DataFrame:
    """Ambiguous names on rosters of two clubs at two events on one day (I4). Rows without a start have no days.

    Two spans overlap if they share a day, so every name and day is one small
    aggregate. Pairs of club and event of one day of which no two differ in both
    have all the same club or all the same event; so there is a conflict if
    there are two clubs and two events.
    """
    spans = rows.join(raw_ambiguous(rows), "norm", "left_semi").where("start_date is not null").select("norm", "club", "event_id", "start_date", "end_date").distinct()
    end = F.greatest("start_date", F.coalesce("end_date", "start_date"))
    days = spans.select("norm", "club", "event_id", F.explode(F.sequence("start_date", end)).alias("day"))
    each = days.groupBy("norm", "day").agg(F.min("club").alias("c1"), F.max("club").alias("c2"), F.min("event_id").alias("e1"), F.max("event_id").alias("e2"))
    return each.where("c1 <> c2 and e1 <> e2").select("norm").distinct()


def review(overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocked, merged, scopes) from reviewed rows (norm_name, action, note, scope, clubs).

    A merge with two divisions or two clubs or more, joined by |, is scoped:
    ``scopes`` has (norm, kind, value, scope) with kind division or club, and the
    name is not merged as a whole. Confirmed names need nothing.
    """
    norm = names.norm_name(F.col("norm_name")).alias("norm")
    rows = overrides.select(norm, F.lower(F.trim("action")).alias("action"), F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("clubs", F.lit("")).alias("clubs"))
    parts = lambda c, f: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, r"\|"), f), lambda x: x != "")))
    rows = rows.withColumns({"scope": parts("scope", lambda x: F.trim(x)), "clubs": parts("clubs", lambda x: F.when(F.trim(x) == "", "").otherwise(names.norm_club(x, x)))})
    scoped = rows.where((F.col("action") == "merge") & ((F.size("scope") >= 2) | (F.size("clubs") >= 2)))
    scoped = scoped.withColumn("name", F.concat(F.array_join("scope", ","), F.lit("/"), F.array_join("clubs", ",")))
    scopes = scoped.select("norm", F.lit("division").alias("kind"), F.explode("scope").alias("value"), F.col("name").alias("scope")).unionByName(
        scoped.select("norm", F.lit("club").alias("kind"), F.explode("clubs").alias("value"), F.col("name").alias("scope"))
    )
    merged = rows.where("action = 'merge'").select("norm").distinct().join(scopes.select("norm"), "norm", "left_anti")
    return rows.where("action = 'block'").select("norm").distinct(), merged, scopes.groupBy("norm", "kind", "value").agg(F.max("scope").alias("scope"))


def split_names(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Names that dates prove to be several people and that no review merged."""
    return date_conflicts(rows).join(merged, "norm", "left_anti")


def identity_keys(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """The identity of every roster row with a name (I6, I7): scoped merge (by club before division), ambiguous, blocked, merged, split by gender, or the name alone.

    Ids are hashes of the key and stable; ``ambiguous`` tells names split by club.
    """
    rows = rows.where("norm <> ''")
    facts = seen(rows)
    blocked, merged, scopes = review(overrides)
    flags = [(split_names(facts, merged), "ambiguous"), (blocked, "blocked"), (merged, "merged"), (gender_split(facts), "split")]
    marked = flags[0][0].select("norm", F.lit(flags[0][1]).alias("flag"))
    for df, flag in flags[1:]:
        marked = marked.unionByName(df.select("norm", F.lit(flag).alias("flag")))
    marked = written(marked.groupBy("norm").agg(F.collect_set("flag").alias("flags")), "flags")
    scope = lambda kind: scopes.where(F.col("kind") == kind).select("norm", F.col("value").alias(kind), F.col("scope").alias(f"{kind}_scope"))
    out = rows.join(scope("club"), ["norm", "club"], "left").join(scope("division"), ["norm", "division"], "left").join(marked, "norm", "left")
    has = lambda flag: F.coalesce(F.array_contains("flags", flag), F.lit(False))
    part = F.coalesce("club_scope", "division_scope")
    g = F.coalesce(names.division_gender(F.col("division")), names.pronoun_gender(F.col("pronouns")), F.lit("?"))
    key = (
        F.when(part.isNotNull(), F.concat_ws("|", F.lit("scoped"), "norm", part))
        .when(has("ambiguous"), F.concat_ws("|", F.lit("club"), "norm", "club"))
        .when(has("blocked"), F.concat_ws("|", F.lit("division"), "norm", "division"))
        .when(has("merged"), F.concat_ws("|", F.lit("name"), "norm"))
        .when(has("split"), F.concat_ws("|", F.lit("gender"), "norm", g))
        .otherwise(F.concat_ws("|", F.lit("name"), "norm"))
    )
    kept = [c for c in rows.columns if c != "player_id"]
    return out.select(*kept, key.alias("identity"), has("ambiguous").alias("ambiguous")).withColumn("player_id", F.xxhash64("identity"))


def display_names(keyed: DataFrame) -> DataFrame:
    """The spelling of each identity (I8): the one on the earliest roster that has the normal form of the name, white space squeezed."""
    shown = keyed.groupBy("norm").agg(F.min_by(F.trim(F.regexp_replace("name", r"\s+", " ")), F.struct("event_id", "event_team_id", "name")).alias("display_name"))
    return keyed.select("identity", "norm").distinct().join(shown, "norm").select("identity", "display_name")


def roster_players(keyed: DataFrame) -> DataFrame:
    """One identity per (event team, spelling) (I9): that of the first row; rows of a team differ in pronouns alone, which are put in order."""
    return keyed.groupBy("event_team_id", "name").agg(F.min_by("identity", F.struct(F.coalesce("pronouns", F.lit("")), "identity")).alias("identity"))


def gender_evidence(keyed: DataFrame) -> DataFrame:
    """Gender by division, if all divisions agree, else by a majority of pronouns on mixed rosters (I10): (identity, gender, source). A row stands for ``n`` rows, if it says so."""
    weight = F.col("n") if "n" in keyed.columns else F.lit(1)
    g = names.division_gender(F.col("division"))
    p = F.when(g.isNull(), names.pronoun_gender(F.col("pronouns")))
    count = lambda c, v: F.sum(F.when(c == v, weight).otherwise(0))
    n = keyed.groupBy("identity").agg(count(g, "m").alias("dm"), count(g, "w").alias("dw"), count(p, "m").alias("pm"), count(p, "w").alias("pw"))
    by_division = F.when((F.col("dm") > 0) & (F.col("dw") == 0), "m").when((F.col("dw") > 0) & (F.col("dm") == 0), "w")
    by_pronoun = F.when(F.col("pm") > F.col("pw"), "m").when(F.col("pw") > F.col("pm"), "w")
    return n.select(
        "identity", F.coalesce(by_division, by_pronoun).alias("gender"), F.when(by_division.isNotNull(), "division").when(by_pronoun.isNotNull(), "pronouns").alias("gender_source")
    )


def name_likelihood(known: DataFrame, min_seen: int = 5, min_share: float = 0.95) -> DataFrame:
    """First names that tell a gender (I11). known: (first, gender)."""
    per = known.where("first is not null and gender is not null").groupBy("first").agg(
        F.count("*").alias("seen"), F.sum(F.when(F.col("gender") == "m", 1).otherwise(0)).alias("m"), F.sum(F.when(F.col("gender") == "w", 1).otherwise(0)).alias("w")
    )
    all_ = known.where("first is not null and gender is not null").agg(
        F.sum(F.when(F.col("gender") == "m", 1).otherwise(0)).alias("all_m"), F.sum(F.when(F.col("gender") == "w", 1).otherwise(0)).alias("all_w")
    )
    x = per.crossJoin(F.broadcast(all_))  # one row
    pm, pw = F.col("m") / F.greatest("all_m", F.lit(1)), F.col("w") / F.greatest("all_w", F.lit(1))
    x = x.withColumn("share_m", pm / (pm + pw)).where(F.col("seen") >= min_seen)
    return x.select("first", "seen", F.when(F.col("share_m") >= min_share, "m").when(1 - F.col("share_m") >= min_share, "w").alias("gender")).where("gender is not null")


def ambiguity_report(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names with several clubs in a division and season, their clubs there, and what became of them."""
    _, merged, _ = review(overrides)
    split = split_names(rows, merged).withColumn("hit", F.lit(True))
    clubs = rows.groupBy("norm", "division", "season").agg(F.array_join(F.array_sort(F.collect_set("club")), "; ").alias("clubs"), F.countDistinct("club").alias("n")).where("n > 1")
    return clubs.join(split, "norm", "left").select("norm", "division", "season", "clubs", F.when(F.col("hit"), "split").otherwise("auto-merged").alias("verdict"))


def bridge_report(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names that join two divisions or more as one identity, with their divisions and clubs (I12): not split by dates or gender and not blocked."""
    blocked, merged, _ = review(overrides)
    rows = seen(rows)
    both = rows.select("norm", "division", "club").distinct().groupBy("norm").agg(F.array_sort(F.collect_set("division")).alias("divisions"), F.array_sort(F.collect_set("club")).alias("clubs")).where(F.size("divisions") > 1)
    for gone in (split_names(rows, merged), blocked, gender_split(rows)):
        both = both.join(gone, "norm", "left_anti")
    return both.select("norm", F.array_join("divisions", "; ").alias("divisions"), F.array_join("clubs", "; ").alias("teams"))


def colliding_names(rows: DataFrame, by: list[str]) -> DataFrame:
    """Compact names on two teams or more of one ``by`` group, such as a season's division or an event (I13). rows: (compact, team)."""
    return rows.select("compact", "team", *by).distinct().groupBy("compact", *by).agg(F.min("team").alias("a"), F.max("team").alias("b")).where("a <> b").select("compact").distinct()


def bridge_names(entries: DataFrame, players: DataFrame, colliding: DataFrame) -> DataFrame:
    """Names of another corpus that are one player here (I13): (compact, player_id, match_method, shared_seasons).

    entries: (compact, name_key, season), name_key in exact form; players:
    (player_id, compact, exact, ambiguous, season). A compact name counts if it
    does not collide, belongs to exactly one player, who is not ambiguous, and
    both have a season in common. The match is exact if there is one spelling
    and it is the player's.
    """
    players, entries = written(players.distinct(), "players"), written(entries.select("compact", "name_key", "season").distinct(), "entries")
    ours = players.groupBy("compact").agg(F.countDistinct("player_id").alias("n"), F.min("player_id").alias("player_id"), F.max("ambiguous").alias("amb"), F.min("exact").alias("exact")).where("n = 1 and not amb")
    theirs = entries.groupBy("compact").agg(F.min("name_key").alias("k1"), F.max("name_key").alias("k2")).join(colliding, "compact", "left_anti")
    shared = entries.select("compact", "season").distinct().join(players.select("compact", "season").distinct(), ["compact", "season"]).groupBy("compact").agg(F.count("*").alias("shared_seasons"))
    exact = (F.col("k1") == F.col("k2")) & (F.col("k1") == F.col("exact"))
    return theirs.join(ours, "compact").join(shared, "compact").select("compact", "player_id", F.when(exact, "exact").otherwise("compact").alias("match_method"), "shared_seasons")


def source_key(compact, division, team, colliding):
    """The key from which a player of another corpus gets an id (I14): the compact name, with division and team where it collides. Columns."""
    return F.when(colliding, F.concat_ws("|", compact, division, team)).otherwise(compact)


def assign_international(rows: DataFrame, bridges: DataFrame, european: DataFrame, colliding: DataFrame) -> DataFrame:
    """The player behind each roster row of an international event (I15, J9): the rows with player_id and match_method.

    rows: (event_id, event_team_id, number, name_key, compact, season, division);
    bridges: (compact, player_id); european: (season, division, name_key,
    compact, player_id) with ``division`` named as in rows. First comes the
    bridged player, then the one European player of that season and division
    with the exact, then with the compact name; else an id is made from the
    compact name, or, where that collides, from event, team, number and name.
    """
    one = lambda df, keys, out: df.groupBy(*keys).agg(F.countDistinct("player_id").alias("_n"), F.min("player_id").alias(out)).where("_n = 1").drop("_n")
    out = rows.join(colliding.withColumn("collides", F.lit(True)), "compact", "left").join(bridges.select("compact", F.col("player_id").alias("bridged")), "compact", "left")
    out = out.join(one(european, ["season", "division", "name_key"], "by_exact"), ["season", "division", "name_key"], "left")
    out = out.join(one(european, ["season", "division", "compact"], "by_compact"), ["season", "division", "compact"], "left")
    free = F.col("collides").isNull()
    known = F.when(free, F.coalesce("bridged", "by_exact", "by_compact"))
    scoped = F.concat(F.col("event_id").cast("string"), F.lit("|"), F.col("event_team_id"), F.lit("|"), F.coalesce("number", F.lit("")), F.lit("|"), F.col("name_key"))
    made = names.stable_id("wfdf-results", F.when(free, F.col("compact")).otherwise(scoped)) - 2**52
    method = F.when(~free, "event-team-scoped").when(F.col("bridged").isNotNull(), "usau-name").when(F.coalesce("by_exact", "by_compact").isNotNull(), "euf-name").otherwise("generated")
    return out.select(*rows.columns, F.coalesce(known, made).alias("player_id"), method.alias("match_method"))


def resolve_links(links: DataFrame, players: DataFrame, memberships: DataFrame) -> DataFrame:
    """The current player of each accepted link (I19, J11): (pro_id, player_id).

    links: (pro_id, norm, club), club empty for names that are not ambiguous;
    players: (player_id, norm, ambiguous); memberships of ambiguous players:
    (player_id, club), club in lower case.
    """
    plain = players.where("not ambiguous").groupBy("norm").agg(F.max("player_id").alias("plain"))
    by_club = players.where("ambiguous").join(memberships, "player_id").groupBy("norm", "club").agg(F.max("player_id").alias("of_club"))
    out = links.join(plain, "norm", "left").join(by_club, ["norm", "club"], "left")
    return out.select("pro_id", F.when(F.col("club") != "", F.col("of_club")).otherwise(F.col("plain")).alias("player_id")).where("player_id is not null")


def bridge_heights(rows: DataFrame, bridges: DataFrame, least: int = 2, gap: int = 4) -> DataFrame:
    """Bridges whose median heights in two divisions lie ``gap`` inches apart or more (I21). rows: (norm, division, height); bridges: (norm)."""
    inches = measures.inches(F.col("height"))
    med = rows.join(bridges.select("norm").distinct(), "norm", "left_semi").where(inches.isNotNull()).groupBy("norm", "division").agg(F.percentile(inches, 0.5).alias("median"), F.count("*").alias("n"))
    wide = med.where(F.col("n") >= least).groupBy("norm").agg(F.count("*").alias("k"), (F.max("median") - F.min("median")).alias("gap"))
    out = bridges.select("norm").distinct().join(wide.where("k > 1"), "norm", "left")
    return out.select("norm", F.bround("gap", 1).alias("height_gap"), F.coalesce(F.col("gap") >= gap, F.lit(False)).alias("height_conflict"))


def bridge_audit(bridges: DataFrame, players: DataFrame, full: DataFrame, severed: DataFrame) -> DataFrame:
    """What a merged career gains on the larger of its careers by division (I21): the bridges with rating_shift, conflicts first, then the greatest shift.

    bridges as from ``bridge_heights``; players: (norm, player); full: (player,
    rating) of the merged replay; severed: (player, division, rating, games) of
    the replay with an identity per division.
    """
    largest = severed.groupBy("player").agg(F.max_by("rating", F.struct("games", "division")).alias("part"))
    out = bridges.join(players, "norm", "left").join(full.select("player", "rating"), "player", "left").join(largest, "player", "left")
    shift = F.coalesce(F.bround(F.col("rating") - F.col("part"), 1), F.lit(0.0))
    return out.select("norm", "height_gap", "height_conflict", shift.alias("rating_shift")).orderBy(F.desc("height_conflict"), F.desc(F.abs("rating_shift")), "norm")


def bridge_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names of one corpus with exactly one identity in the other and a season in common (I13). Both: (norm, identity, season)."""
    one = right.select("norm", "identity").distinct().groupBy("norm").agg(F.countDistinct("identity").alias("n"), F.min("identity").alias("identity")).where("n = 1").drop("n")
    shared = left.select("norm", "season").distinct().join(right.select("norm", "season").distinct(), ["norm", "season"]).groupBy("norm").agg(F.count("*").alias("shared_seasons"))
    return one.join(shared, "norm")


def match_clubs(teams: DataFrame, ours: DataFrame, european: DataFrame) -> DataFrame:
    """The club of each team of another corpus (I16): (event_team_id, club), null where none or several fit.

    teams: (event_team_id, division, key); ours and european: (division, key,
    club). The club of the same division counts if it is the only one with the
    key, else the only one of the analogous European division.
    """
    alone = lambda df, n: df.groupBy("division", "key").agg(F.countDistinct("club").alias("_n"), F.min("club").alias(n)).where("_n = 1").drop("_n")
    analogous = F.create_map(*[F.lit(x) for x in ("club-men", "euf-open", "club-women", "euf-women", "club-mixed", "euf-mixed")])
    out = teams.join(alone(ours, "own"), ["division", "key"], "left").withColumn("_eu", F.try_element_at(analogous, F.col("division")))
    out = out.join(alone(european, "eu").withColumnRenamed("division", "_eu"), ["_eu", "key"], "left")
    return out.select("event_team_id", F.coalesce("own", "eu").alias("club"))


def link_by_evidence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Links by name with corroboration (I18). a: (a_id, norm, cities, jerseys, years), b: (b_id, norm, cities, jerseys, years).

    Common cities, jersey numbers and years are a piece of evidence each. A link
    is accepted if the best candidate has any and the next one has none;
    otherwise the reason stands in ``audit``.
    """
    kinds = ("cities", "jerseys", "years")
    cand = a.join(b.select("b_id", "norm", *[F.col(c).alias(f"b_{c}") for c in kinds]), "norm", "left")
    pieces = sum((F.when(F.arrays_overlap(c, f"b_{c}"), 1).otherwise(0) for c in kinds), F.lit(0))
    cand = cand.select("a_id", "b_id", F.when(F.col("b_id").isNotNull(), pieces).alias("evidence"))
    w = W.partitionBy("a_id").orderBy(F.desc_nulls_last("evidence"), "b_id")
    best = cand.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("evidence").over(w)).where("r = 1")
    accepted = (F.col("evidence") > 0) & (F.coalesce("next", F.lit(0)) == 0)
    audit = F.when(F.col("b_id").isNull(), "no-match").when(accepted, "linked").when(F.col("next").isNotNull(), "ambiguous").otherwise("no-corroboration")
    return best.select("a_id", F.when(accepted, F.col("b_id")).alias("b_id"), audit.alias("audit"))


def name_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many names two corpora share by exact and by folded keys (I17), a row per ``key``: shared, of those the ones with one unambiguous identity on the right, and with a common season too.

    left: (exact, folded, season); right: (exact, folded, season, identity, ambiguous).
    """
    parts = []
    for kind in ("exact", "folded"):
        a = left.select(kind, "season").distinct().groupBy(kind).agg(F.collect_set("season").alias("sa"))
        b = right.select(kind, "season", "identity", "ambiguous").distinct().groupBy(kind).agg(F.collect_set("season").alias("sb"), F.countDistinct("identity").alias("n"), F.max("ambiguous").alias("amb"))
        one = (F.col("n") == 1) & ~F.col("amb")
        count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
        parts.append(a.join(b, kind).agg(F.count("*").alias("shared"), count(one).alias("unique"), count(one & F.arrays_overlap("sa", "sb")).alias("same_season")).withColumn("key", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def mapping_candidates(details: DataFrame) -> DataFrame:
    """Pairs of events of different sources with equal season, division and squeezed name (I20, J7). details: (id, source, season, division, key)."""
    b = details.select(F.col("id").alias("other_id"), F.col("source").alias("other_source"), "season", "division", "key")
    return details.join(b, ["season", "division", "key"]).where("source <> other_source and id < other_id").select("season", "division", "key", "id", "other_id")
