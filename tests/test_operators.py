"""Edge cases of relational operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import measures, names
from rosterlake.operators import api, corpus, identity, tournaments, trends
from rosterlake.operators.graph import components


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_names(spark):
    df = spark.createDataFrame([("  José  O’Neil. ",), ("ANA",), (None,)], "n string")
    assert [r[0] for r in df.select(names.norm_name(F.col("n"))).collect()] == ["jose oneil", "ana", None]
    got = spark.range(1).select(names.stable_id("eucs-ranking", F.lit("alice"))).first()[0]
    assert got == -1458579005195971


def test_pronouns(spark):
    df = spark.createDataFrame([("H",), ("s / T",), ("H/S",), ("T",), (None,)], "p string")
    assert [r[0] for r in df.select(names.pronoun_gender(F.col("p"))).collect()] == ["m", "w", None, None, None]


def test_stage_labels(spark):
    """Kind of bracket and wins from its final, by the rules for rounds, places, losers' routes and games to go."""
    want = {
        "Finals": ("champ", 0), "Semi-Finals": ("champ", 1), "Pre-Quarters": ("champ", 3), "9th Place Quarters": ("9th", 2), "Third Place": ("3rd", 0), "1st Place Game": ("champ", 0), "T-3rd": ("3", 0),
        "13th/14th Place": ("13th", 0), "Game to Go": ("gtg", 0), "g2g semis": ("gtg", 1), "Consolation Final": ("consolation", 0), "Round of 64": ("champ", 5), "Pool A": (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(x,) for x in want], "s string")
    got = {r[0]: (r[1], r[2]) for r in df.select("s", measures.bracket_kind(F.col("s")), measures.round_rank(F.col("s"))).collect()}
    assert got == want


def test_tiers_and_series(spark):
    want = {"USA Ultimate Club Championships 2023": 4, "U.S. Open 2019": 4, "Ohio Valley Regionals": 3, "Big Sectionals": 2, "East Conf 2020": 1, "Cooler Classic 30": 0}
    df = spark.createDataFrame([(x,) for x in want], "s string")
    assert {r[0]: r[1] for r in df.select("s", names.tier(F.col("s"))).collect()} == want
    key = lambda x: spark.createDataFrame([(x,)], "s string").select(names.series_key(F.col("s"))).first()[0]
    assert key("Cooler Classic 30") == key("2024 Cooler Classic XXXI (ICC)") == key("Cooler Classic International 29 - Day 2") == "cooler classic"
    assert key("2024") == "2024"


def test_times(spark):
    df = spark.createDataFrame([("1:05 PM",), ("12:00 AM",), ("13:05",), ("late",), (None,), ("1:05pm",), ("8:15p",), ("9:00 AM ET",), ("12:30",)], "t string")
    got = [tuple(r) for r in df.select(measures.clock(F.col("t")), measures.minutes_of_day(F.col("t"))).collect()]
    assert got == [("13:05", 785), ("00:00", 0), ("23:59", 65), ("23:59", 10000), ("23:59", 10000), ("23:59", 785), ("23:59", 1215), ("23:59", 540), ("23:59", 30)]
    slots = spark.createDataFrame([("A1-B12",), ("F3",), ("",), (None,), ("Field",)], "s string")
    assert [r[0] for r in slots.select(measures.slot_number(F.col("s"))).collect()] == [112, 3, 10**9, 10**9, 10**9]


def test_game_x_of_the_published_score(spark):
    assert round(spark.range(1).select(measures.game_x(F.lit(15), F.lit(11))).first()[0]) == 381


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = dict(values(components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 120))


def test_circles_have_no_root(spark):
    edges = spark.createDataFrame([(1, 2), (2, None), (3, 1), (8, 9), (9, 8)], "game long, next long")
    assert values(tournaments.bracket_trees(edges, rounds=5)) == [(1, 2, 1), (2, 2, 0), (3, 2, 2)]


def test_conflicting_sources_are_refused(spark):
    a = spark.createDataFrame([("x", "1", "k")], "source string, source_id string, local_key string")
    b = spark.createDataFrame([("x", "1", "other")], a.schema)
    assert corpus.link_sources(a, a).count() == 1
    with pytest.raises(ValueError, match="two local keys"):
        corpus.link_sources(a, b)


def test_merge_refuses_conflicts(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(ValueError, match="conflicting"):
        corpus.merge_inputs([a, spark.createDataFrame([(1, "y")], a.schema)], ["k"])
    assert corpus.merge_inputs([a, a], ["k"]).count() == 1


def test_replacing_an_event_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "event_id long, t string")
    new = spark.createDataFrame([(1, "z")], old.schema)
    once = corpus.replace_event(old, new)
    assert values(once) == values(corpus.replace_event(once, new)) == [(1, "z"), (2, "c")]


def test_date_conflicts_need_two_clubs_and_two_events(spark):
    import datetime

    d = lambda n: datetime.date(2020, 1, n)
    rows = [
        ("a", "m", 2020, "x", 1, d(1), d(5)), ("a", "m", 2020, "y", 2, d(4), None),  # overlap
        ("b", "m", 2020, "x", 1, d(1), d(3)), ("b", "m", 2020, "y", 2, d(4), d(6)),  # one after the other
        ("c", "m", 2020, "x", 1, d(1), d(9)), ("c", "m", 2020, "y", 1, d(2), d(3)),  # one event
        ("e", "m", 2020, "x", 1, None, d(9)), ("e", "m", 2020, "y", 2, d(2), d(3)),  # unknown start
        ("f", "m", 2020, "x", 1, d(1), d(9)), ("f", "m", 2020, "x", 3, d(2), d(9)), ("f", "m", 2020, "y", 1, d(20), d(21)),
    ]
    df = spark.createDataFrame(rows, "norm string, division string, season int, club string, event_id long, start_date date, end_date date")
    assert [r[0] for r in identity.date_conflicts(df).collect()] == ["a"]


def test_last_before_is_strict(spark):
    import datetime

    p = spark.createDataFrame([("x", datetime.date(2020, 1, 1), 5.0), ("x", datetime.date(2020, 1, 2), 7.0), ("x", datetime.date(2020, 1, 2), 9.0)], "club string, day date, rating double")
    q = spark.createDataFrame([("x", datetime.date(2020, 1, n), n) for n in (1, 2, 3)] + [("y", datetime.date(2020, 1, 3), 4)], "club string, day date, event_id long")
    assert [(r.club, r.event_id, r.rating) for r in trends.last_before(p, q).orderBy("club", "event_id").collect()] == [("x", 1, None), ("x", 2, 5.0), ("x", 3, 9.0), ("y", 4, None)]


def pools(spark, met):
    """Pools of games (day, home, away) in order: for each pool its games' numbers and whether it is a later one."""
    import datetime

    rows = [(1, k, datetime.date(2020, 1, d), h, a, True, k) for k, (d, h, a) in enumerate(met)]
    df = spark.createDataFrame(rows, "event_id long, game_key long, date date, home_id string, away_id string, done boolean, ord long")
    out: dict = {}
    for r in tournaments.recover_pools(df).orderBy("pool", "game_key").collect():
        out.setdefault((r.pool, r.later), []).append(r.game_key)
    return out


def test_pools_are_the_sets_that_all_met(spark):
    assert pools(spark, [(1, "a", "b"), (1, "a", "c"), (1, "b", "c"), (1, "d", "e"), (1, "d", "f"), (1, "e", "f"), (1, "a", "d")]) == {(1, False): [0, 1, 2], (2, False): [3, 4, 5]}


def test_a_pool_of_one_day_beats_a_larger_one(spark):
    """Three teams on the first day; two of them meet two others on the second, where all four met: the later pool takes the second meeting."""
    met = [(1, "a", "b"), (1, "a", "c"), (1, "b", "c"), (2, "a", "d"), (2, "a", "e"), (2, "b", "d"), (2, "b", "e"), (2, "d", "e"), (2, "a", "b")]
    assert pools(spark, met) == {(1, False): [0, 1, 2], (2, True): [3, 4, 5, 6, 7, 8]}


def test_events_are_replaced_together_or_not_at_all(spark):
    teams = spark.createDataFrame([("1:a", 1), ("1:b", 1), ("2:a", 2)], "event_team_id string, event_id long")
    games = spark.createDataFrame([(1, "g", "1:a", "1:b", 5, 4, "Final")], "event_id long, game_key string, home_id string, away_id string, home_score int, away_score int, status string")
    people = spark.createDataFrame([("1:a", "x"), ("2:a", "y")], "event_team_id string, name string")
    old = {"event_teams": teams, "games": games, "roster_entries": people}
    ids = spark.createDataFrame([(1,)], "event_id long")
    new = {"event_teams": spark.createDataFrame([("1:c", 1), ("1:d", 1)], teams.schema), "games": spark.createDataFrame([(1, "h", "1:c", "1:d", 9, 9, "Final")], games.schema)}
    out = corpus.replace_events(old, new, ids)
    assert values(out["games"]) == [(1, "h", "1:c", "1:d", 9, 9, "Final")] and values(out["roster_entries"]) == [("2:a", "y")] and len(values(out["event_teams"])) == 3
    with pytest.raises(ValueError, match="unknown team"):
        corpus.replace_events(old, new | {"games": spark.createDataFrame([(1, "h", "1:c", "1:x", 9, 9, "Final")], games.schema)}, ids)
    with pytest.raises(ValueError, match="no score"):
        corpus.replace_events(old, new | {"games": spark.createDataFrame([(1, "h", "1:c", "1:d", None, 9, "Final")], games.schema)}, ids)


def test_reviews_with_scopes(spark):
    rows = [("José A", "merge", "", "college|club-men", ""), ("b", "merge", "", "college", ""), ("c", "Block", "", "", ""), ("d", "merge", "", "", "Rhino | Other (2)"), ("e", "confirm", "", "", "")]
    blocked, merged, scopes = identity.review(spark.createDataFrame(rows, "norm_name string, action string, note string, scope string, clubs string"))
    assert values(blocked) == [("c",)] and values(merged) == [("b",)]
    assert values(scopes.select("norm", "kind", "value")) == [("d", "club", "other"), ("d", "club", "rhino slam!"), ("jose a", "division", "club-men"), ("jose a", "division", "college")]


def test_pages_are_bounded(spark):
    with pytest.raises(ValueError, match="first"):
        api._page(spark.range(3), ["id"], 0, 0)


def test_every_game_has_one_place(spark):
    rows = [
        ("Semi Finals", "a", "b", 15, 3), ("Semi Finals", "c", "d", 4, 15), ("Finals", "a", "d", 15, 9), ("Pool A", "a", "c", 9, 8), ("Pool A", "a", "e", 9, 8), ("Pool A", "c", "e", 9, 8), ("Crossover", "b", "e", 9, 8),
    ]
    df = spark.createDataFrame([(1, k, *r, True, k) for k, r in enumerate(rows)], "event_id long, game_key long, stage string, home_id string, away_id string, home_score int, away_score int, done boolean, ord long").withColumn("date", F.lit("2020-01-01").cast("date"))
    assert values(tournaments.label_brackets(df).select("game_key", "kind", "depth")) == [(0, "champ", 1), (1, "champ", 1), (2, "champ", 0)]
    got = {r.game_key: r.place for r in tournaments.decompose(df).collect()}
    assert got == {0: "bracket", 1: "bracket", 2: "bracket", 3: "pool", 4: "pool", 5: "pool", 6: "loose"}
    assert values(tournaments.champions(df)) == [(1, "a")]


def test_brackets_without_a_final_are_one_tree(spark):
    rows = [("Quarters", "a", "b", 9, 3), ("Quarters", "c", "d", 9, 3), ("Semis", "a", "c", 9, 8), ("Semis", "e", "f", 9, 1), ("Semis", "g", "h", 5, 5)]
    df = spark.createDataFrame([(1, k, *r, True, k) for k, r in enumerate(rows)], "event_id long, game_key long, stage string, home_id string, away_id string, home_score int, away_score int, done boolean, ord long")
    assert values(tournaments.label_brackets(df).select("game_key", "tree", "depth")) == [(0, 1, 1), (1, 1, 1), (2, 1, 0), (3, 1, 0)]


def test_published_structure_changes_the_champion(spark):
    """Two games called finals: the published one crowns its winner, labels alone the first."""
    rows = [("Finals", "a", "b", 9, 3), ("Finals", "c", "d", 9, 3)]
    df = spark.createDataFrame([(1, k, *r, True, k) for k, r in enumerate(rows)], "event_id long, game_key long, stage string, home_id string, away_id string, home_score int, away_score int, done boolean, ord long").withColumn("date", F.lit("2020-01-01").cast("date"))
    published = spark.createDataFrame([(1, 1, "main", 0, 1, "Finals")], "event_id long, game_key long, bracket string, round int, place int, stage string")
    assert values(tournaments.champion_audit(df, published)) == [(1, "a", "c")]


def bracket_frame(spark, rows):
    df = spark.createDataFrame([(1, k, *r, True, k) for k, r in enumerate(rows)], "event_id long, game_key long, stage string, home_id string, away_id string, home_score int, away_score int, done boolean, ord long")
    return df.withColumn("date", F.lit("2020-01-01").cast("date"))


def test_of_two_finals_the_larger_tree_crowns(spark):
    rows = [("Finals", "a", "b", 9, 3), ("Semi Finals", "c", "x", 9, 3), ("Semi Finals", "d", "y", 9, 3), ("Finals", "c", "d", 9, 3)]
    assert values(tournaments.champions(bracket_frame(spark, rows))) == [(1, "c")]
    assert values(tournaments.champions(bracket_frame(spark, rows[:1] + rows[3:]))) == [(1, "a")]
    assert values(tournaments.champions(bracket_frame(spark, [("Semi Finals", "a", "b", 9, 3)]))) == []
    assert values(tournaments.decomposed_champions(bracket_frame(spark, rows))) == [(1, "c")]


def test_series_labels_have_no_year(spark):
    rows = [(3, "Cup 2020", 2020), (1, "Cup 2018", 2018), (2, "Cup 2019 - ICC", 2019), (4, "Other 1999", 1999)]
    got = {r.event_id: r.label for r in tournaments.series(spark.createDataFrame(rows, "event_id long, name string, season int")).collect()}
    assert got == {1: "Cup", 2: "Cup", 3: "Cup", 4: "Other"}


def test_seeds_come_from_a_team_s_first_pool(spark):
    table = [(1, 1, "a", 1, False), (1, 1, "b", 2, False), (1, 2, "c", 1, False), (1, 2, "a", 2, False), (1, 3, "d", 1, True), (2, 27, "z", 3, False)]
    got = tournaments.seeds(spark.createDataFrame(table, "event_id long, pool long, team string, place long, later boolean"))
    assert values(got.select("event_id", "team", "seed")) == [(1, "a", "A1"), (1, "b", "A2"), (1, "c", "B1"), (2, "z", "273")]


def test_slots_of_padded_trees(spark):
    """A final fed by one semi-final, whose home team came from a quarter-final; a second flight takes what the first has left."""
    rows = [("Quarters", "a", "q", 9, 3), ("Semi Finals", "a", "s", 9, 3), ("Semi Finals", "a", "t", 9, 3), ("Finals", "b", "a", 3, 9), ("Finals", "a", "c", 9, 3), ("Third Place", "s", "t", 9, 3)]
    slots = tournaments.bracket_slots(bracket_frame(spark, rows))
    got = sorted(tuple(r) for r in slots.where("kind = 'champ'").select("tree", "depth", "slot", F.coalesce("game_key", F.lit(-1))).collect())
    assert got == [(1, 0, 0, 3), (1, 1, 0, -1), (1, 1, 1, 1), (1, 2, 0, -1), (1, 2, 1, -1), (1, 2, 2, 0), (1, 2, 3, -1), (2, 0, 0, 4), (2, 1, 0, 2), (2, 1, 1, -1)]
    order = tournaments.bracket_order(slots)
    assert values(order.select("kind", "tree", "n_games", "position")) == [("3rd", 1, 1, 3), ("champ", 1, 3, 1), ("champ", 2, 2, 2)]
