"""Some queries of each kind give the rows that DuckDB gives, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from rosterlake.plans import more  # noqa: F401
from rosterlake.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()
#: A few of each kind; the driver compares them all on larger tables.
SOME = [
    "s2_clean_games", "s10_upsert_events", "s19_attach_structure", "f_math", "f_ids", "i4_date_conflicts", "m1_metrics_cube",
    "f_labels", "f_provider_values", "s12_drop_reseeded", "i12_ambiguity_report", "w7_division_masks", "w3_latest_rosters_upcoming", "t9_event_facts", "q3_teams_page", "a2_score_conflicts",
    "w1_rank_players", "w4_best_rosters", "t7_bracket_trees", "t11_standings", "fs1_last_before", "h4_trends", "q5_games_by_event",
    "r1_player_elo_without_stats", "r5_one_step", "t1_fixtures", "t3_bracket_slots", "t6_champions", "t12_seeds", "h4_cube_top", "s25_schedule_rows", "s26_calendars", "st1_deliveries_in_any_order",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:10]
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
