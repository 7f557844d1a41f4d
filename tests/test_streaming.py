"""Streams give what the batch operators give over the same rows."""

import datetime

from pyspark.sql import functions as F

from rosterlake.operators import ratings
from rosterlake.sources import tables
from rosterlake.streaming import ingest

GAMES = "season int, division string, game_key long, played timestamp, home_club string, away_club string, home_score int, away_score int"


def test_team_elo_of_a_shuffled_stream_equals_the_batch(spark, tmp_path):
    day = datetime.datetime(2021, 1, 1)
    rows = [(2021, "club-men", k, day + datetime.timedelta(hours=7 * (k // 2)), f"t{k % 5}", f"t{(k + 1 + k % 3) % 5}", k % 7, (3 * k) % 11) for k in range(60)]
    rows += [(2021, "college", 100 + k, day + datetime.timedelta(days=k), "x", "y", k, 5) for k in range(15)]
    order = sorted(rows, key=lambda r: (r[3] + datetime.timedelta(hours=(r[2] * 37) % 60), r[2]))  # up to 60 hours late
    order += [(2022, "none", 999, day + datetime.timedelta(days=400), "x", "y", 1, 0)]
    for n in range(0, len(order), 19):
        spark.createDataFrame(order[n : n + 19], GAMES).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n:03d}"))
    stream = spark.readStream.schema(GAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    q = ingest.streaming_team_elo(stream, "3 days").writeStream.format("memory").queryName("elo").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {r.game_key: r.expected for r in spark.table("elo").collect()}
    pools = {}
    for s, d, k, _, h, a, hs, as_ in sorted(rows, key=lambda r: (r[3], r[2])):
        pool = pools.setdefault((s, d), ratings.Pool(ratings.EloConfig(involvement_credit=False, stat_transfer_beta=0.0, roster_shrink=0.0)))
        assert abs(got[k] - pool.game([h], [a], hs, as_, d, 0, 0)[0]) < 1e-9
    assert len(got) == len(rows)  # the last game is not passed


def test_deliveries_in_any_order_give_the_same_table(spark, tmp_path):
    import itertools

    schema = "event_id long, game_key long, version long, home_score int"
    parts = [[(1, 1, 1, 5), (1, 2, 1, 6), (2, 3, 4, 7), (2, 3, 4, 7)], [(1, 9, 2, 8)], [(1, 10, 2, 9), (3, 1, None, 0)], [(2, 4, 3, 1), (1, 9, 2, 8)]]
    want = [(1, 9, 2, 8), (1, 10, 2, 9), (2, 3, 4, 7), (3, 1, None, 0)]
    for n, order in enumerate([*itertools.islice(itertools.permutations(range(4)), 0, 24, 7), (0, 1, 2, 3, 0, 2)]):
        folder = tmp_path / str(n)
        for i, k in enumerate(order):
            spark.createDataFrame(parts[k], schema).coalesce(1).write.parquet(str(folder / "in" / f"n={i}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "n=*"))
        ingest.start_ingest(stream, str(folder / "log"), str(folder / "cp"), once=True).awaitTermination(120)
        rows = lambda df: sorted(tuple(r) for r in df.select("event_id", "game_key", "version", "home_score").collect())
        assert rows(ingest.current_events(spark, str(folder / "log"))) == want
    ingest.compact_events(spark, str(tmp_path / "base"), str(tmp_path / "0" / "log"), parts=2)
    assert rows(ingest.current_events(spark, str(tmp_path / "base"))) == want
    newer = spark.createDataFrame([(2, 8, 5, 3), (1, 1, 1, 5)], schema)
    newer.write.parquet(str(tmp_path / "more" / "batch=0"))
    assert rows(ingest.current_events(spark, str(tmp_path / "base"), str(tmp_path / "more"))) == [(1, 9, 2, 8), (1, 10, 2, 9), (2, 8, 5, 3), (3, 1, None, 0)]


def test_deliveries_without_versions_count_by_batch(spark, tmp_path):
    schema = "event_id long, game_key long, home_score int"
    for i, part in enumerate(([(1, 1, 5), (1, 2, 6), (2, 3, 7), (2, 3, 7)], [(1, 9, 8)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    got = sorted(tuple(r) for r in ingest.current_events(spark, str(tmp_path / "out")).select("event_id", "game_key", "home_score").collect())
    assert got in ([(1, 9, 8), (2, 3, 7)], [(1, 1, 5), (1, 2, 6), (2, 3, 7)])  # files may be read in either order


def test_stat_lines_wait_for_the_end(spark, tmp_path):
    """Lines of an event's last day come out once a later day has been seen, and lines still to come do not."""
    at = lambda d, h: datetime.datetime(2021, 1, d, h)
    schema = "event_team_id string, ended timestamp, player_id long, usage double, quality double"
    batches = [[("1:a", at(1, 9), 1, 0.5, 2.0), ("1:a", at(1, 12), 2, 1.5, 1.0)], [("1:b", at(1, 18), 3, 1.0, 0.0), ("2:a", at(3, 9), 1, 1.0, 1.0)], [("3:a", at(9, 9), 4, 1.0, 1.0)]]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = ingest.deferred_stats(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_team_id: (str(r.acts_from), [x.player_id for x in r.lines]) for r in spark.table("late").collect()}
    assert got["1:a"] == ("2021-01-02", [1, 2]) and got["1:b"] == ("2021-01-02", [3]) and got["2:a"] == ("2021-01-04", [1]) and "3:a" not in got


def test_snapshots_with_errors_give_no_rows(spark):
    good = '{"source": "x", "rows": [{"season": 2020, "division": "open", "team": "A", "url": "https://e.org", "payload_hash": "%s", "players": ["p"]}]}' % ("a" * 64)
    bad = good.replace("2020", "1800").replace("https", "http")
    rows, errors = tables.ingest_snapshot(spark.createDataFrame([(good,), (bad,), ("no json",)], "body string"))
    assert [r.team for r in rows.collect()] == ["A"]
    assert {"bad season", "bad url"} <= {r.error for r in errors.collect()}


def test_pages_and_calendar(spark):
    html = '<a href="/t?id=7">Team</a><a href="/t?id=7">Team</a><table><tr><th>Name</th><th>No</th></tr><tr><td>Ana</td><td>4</td></tr></table>'
    out = tables.extract_page_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.kind, r.id, r.cells) for r in out] == [("link", "7", None), ("row", None, {"Name": "Ana", "No": "4"})]
    ics = ["BEGIN:VEVENT", "DTSTART:20240501T101500", "LOCATION:Field 3", "SUMMARY:A - B", "END:VEVENT"]
    plan = spark.createDataFrame([("2024-05-01", "10:15", "3", "A", "B"), ("2024-05-01", "11:00", "3", "A", "C")], "day string, time string, field string, home string, away string")
    got = tables.cross_check_calendar(plan.withColumn("day", F.to_date("day")), spark.createDataFrame(list(enumerate(ics)), "pos long, line string")).first()
    assert tuple(got) == (2, 1, 1)


def test_buckets_and_tables(spark, tmp_path):
    tables.write_buckets(spark.range(100), str(tmp_path / "b"), "id", 8)
    assert spark.read.parquet(str(tmp_path / "b")).where("bucket <> id % 8").count() == 0
    df = spark.createDataFrame([("t", 1, "A", None, None)], tables.SCHEMAS["event_teams"])
    tables.write_table(df, str(tmp_path / "event_teams.csv"), "csv")
    assert tables.read_table(spark, "event_teams", str(tmp_path), "csv").first()["event_id"] == 1


def test_schedules_in_context(spark):
    html = """<h3>Pool A</h3><table><tr data-game="7"><td><span data-type="game-date">Sat 7/3</span><span data-type="game-time"> 9:00 AM </span><span data-type="game-team-home"><a href="?EventTeamId=x&amp;y">A (1)</a></span>
    <span data-type="game-team-away"><a href="?EventTeamId=b">B</a></span><span data-type="game-score-home">W</span><span data-type="game-score-away">11</span><a href="/g?EventGameId=55">go</a></td></tr><tr data-game="8"><td></td></tr></table>
    <h4>Other</h4><h4 class="col_title">Semis</h4><div class="bracket_game" id="b1"><div><span data-type="game-team-home"><a href="?EventTeamId=c">C</a></span></div><span class="date">7/4/2021 1:15 PM</span><span class="game-status">Final</span></div>
    <tr data-game="9"><td><a href="/g?EventGameId=55">again</a></td></tr>"""
    got = [tuple(r)[1:] for r in tables.extract_schedule(spark.createDataFrame([(1, html, 2020), (2, None, None)], "page_id long, html string, year int")).collect()]
    assert got == [
        ("55", "7", "Pool A", "2020-07-03", "9:00 AM", "x&y", "b", None, 11, None),
        ("pool-8", "8", "Pool A", None, None, None, None, None, None, None),
        ("bracket-b1", "b1", "Semis", "2021-07-04", "1:15 PM", "c", None, None, None, "Final"),
    ]


def test_two_calendars_in_one_table(spark):
    def ics(*games):
        return [x for start, field, *summary in games for x in ["BEGIN:VEVENT", f"DTSTART;TZID=Z:{start}", f"LOCATION:Field {field}", "SUMMARY:" + summary[0], *(" " + s for s in summary[1:]), "END:VEVENT"]]

    lines = [("x", i, t) for i, t in enumerate(ics(("20240501T101500", 3, "A -", " B"), ("20240501T111500", 3, "C - D")))] + [("y", i, t) for i, t in enumerate(ics(("20240501T101500", 3, "E - F")))]
    plan = [("x", "2024-05-01", "10:15", "3", "A", "B"), ("x", "2024-05-01", "11:15", "3", "C", "X"), ("x", "2024-05-01", "12:15", "3", "C", "X"), ("y", "2024-05-01", "10:15", "3", "E", "F"), ("z", "2024-05-01", "10:15", "3", "E", "F")]
    schedule = spark.createDataFrame(plan, "calendar string, day string, time string, field string, home string, away string").withColumn("day", F.to_date("day"))
    got = tables.cross_check_calendar(schedule, spark.createDataFrame(lines, "calendar string, pos int, line string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == [("x", 3, 2, 1), ("y", 1, 1, 1), ("z", 1, 0, 0)]
