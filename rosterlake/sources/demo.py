"""Sports tables derived from the order tables by integer arithmetic, alike in Spark and DuckDB.

Each view is one SELECT with a few dialect marks: ``{days}``, ``{div:a|b}`` for
integer division, ``{plus:d|n}`` for a date n days later and ``{spark:x}`` for a
condition that follows from the others and gives Spark a key to join by.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators.graph import written

VIEWS = {
    "v_order": """
      SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS odate, {days} AS dnum,
        {div:{days}|7} AS week, CAST(substr(o_orderpriority, 1, 1) AS INT) AS dcode
      FROM orders""",
    "v_event": """
      SELECT event_id, season, CASE WHEN week % 26 = 0 THEN concat('National Championships ', CAST(season AS STRING))
          WHEN week % 26 = 5 THEN concat('U.S. Open ', CAST(season AS STRING)) WHEN week % 26 = 7 THEN concat('Metro Regionals ', CAST(season AS STRING))
          WHEN week % 26 = 9 THEN concat('Lake Sectionals XII ', CAST(season AS STRING)) WHEN week % 26 = 11 THEN concat('Pacific Conference Open - Day 2 ', CAST(season AS STRING))
          WHEN week % 26 = 13 THEN concat('Men''s Club ', CAST(season AS STRING)) ELSE concat('Cup ', CAST(week % 30 AS STRING), ' ', CAST(season AS STRING)) END AS name,
        concat('https://example.org/e/', CAST(event_id AS STRING), CASE WHEN week % 4 = 0 THEN '/' ELSE '' END) AS url,
        start_date, CASE WHEN week % 17 = 0 THEN CAST(NULL AS DATE) ELSE {plus:start_date|6} END AS end_date,
        CASE dcode WHEN 1 THEN 'club-men' WHEN 2 THEN 'college' WHEN 3 THEN 'club-mixed' WHEN 4 THEN 'club-women' ELSE 'college-women' END AS division
      FROM (SELECT week * 10 + dcode AS event_id, week, dcode, {plus:DATE'1995-01-01'|7 * week} AS start_date,
              CAST(year({plus:DATE'1995-01-01'|7 * week}) AS INT) AS season
            FROM v_order GROUP BY week, dcode) x""",
    "v_game": """
      SELECT week * 10 + dcode AS event_id, o_orderkey AS game_key, o_orderkey % 4 AS slot,
        CASE WHEN o_orderkey % 41 = 0 THEN CAST(NULL AS DATE) WHEN o_orderkey % 97 = 0 THEN {plus:odate|-3650} ELSE odate END AS date,
        CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS STRING) ELSE concat(CAST(8 + o_orderkey % 4 AS STRING), ':15 AM') END AS time,
        concat(CAST(week * 10 + dcode AS STRING), ':', CAST(o_custkey % 40 AS STRING)) AS home_id,
        concat(CAST(week * 10 + dcode AS STRING), ':', CAST((o_custkey + 1 + o_orderkey % 39) % 40 AS STRING)) AS away_id,
        CAST(4 + (7 * o_orderkey + o_custkey) % 12 AS INT) AS home_score, CAST((13 * o_orderkey + 5 * o_custkey) % 16 AS INT) AS away_score,
        CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' ELSE 'Final' END AS status,
        CASE o_orderkey % 24 WHEN 0 THEN 'Finals' WHEN 1 THEN 'Semi Finals' WHEN 2 THEN 'Semi Finals' WHEN 3 THEN '9th Place Quarters'
          WHEN 4 THEN 'Game to Go' WHEN 5 THEN 'Third Place' WHEN 6 THEN 'Pre-Quarters' WHEN 7 THEN 'Consolation Semis' WHEN 8 THEN 'Back Door Final'
          WHEN 9 THEN 'Round of 32' WHEN 10 THEN 'T-5 Final' WHEN 11 THEN '13th/14th Place' ELSE concat('Pool ', chr(CAST(65 + o_custkey % 4 AS INT))) END AS stage
      FROM v_order""",
    "v_team": """
      SELECT DISTINCT event_team_id, event_id, team, season, division,
        concat('Team ', CAST(team AS STRING), CASE WHEN team % 7 = 0 THEN ' (2)' ELSE '' END) AS display_name,
        CASE WHEN team % 5 = 0 THEN CAST(NULL AS STRING) WHEN team = 11 THEN 'Rhino' WHEN team = 13 THEN 'Dark  Star-D (3)'
          ELSE concat('  The  Team ', CAST(team AS STRING)) END AS full_name
      FROM (SELECT event_id, home_id AS event_team_id FROM v_game UNION ALL SELECT event_id, away_id FROM v_game) g
        JOIN (SELECT event_id AS eid, season, division FROM v_event) e ON g.event_id = e.eid
        JOIN (SELECT DISTINCT home_id AS tid, CAST(o_custkey % 40 AS INT) AS team FROM v_game JOIN v_order ON game_key = o_orderkey
              UNION SELECT DISTINCT away_id, CAST((o_custkey + 1 + o_orderkey % 39) % 40 AS INT) FROM v_game JOIN v_order ON game_key = o_orderkey) t
          ON g.event_team_id = t.tid""",
    "v_roster": """
      SELECT t.event_team_id, t.event_id, t.season, t.division, t.team, c_custkey AS player_id, {name} AS name,
        CASE c_custkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'S/T' WHEN 2 THEN 'H/S' ELSE '' END AS pronouns
      FROM v_team t JOIN (SELECT c_custkey, 1 + c_custkey % 5 AS dcode, c_custkey AS spot FROM customer
                          UNION ALL SELECT c_custkey, 3 AS dcode, c_custkey + 7 AS spot FROM customer WHERE c_custkey % 10 = 0) c
        ON (c.spot + t.season) % 40 = t.team AND c.dcode = t.event_id % 10{spark: AND pmod(c.spot, 40) = pmod(t.team - t.season, 40)}""",
    "v_stat": """
      SELECT concat(CAST(week * 10 + dcode AS STRING), ':', CAST(o_custkey % 40 AS STRING)) AS event_team_id, l_suppkey AS player_id,
        CAST(CAST(SUM(CAST(l_quantity AS BIGINT) % 3) AS BIGINT) AS STRING) AS points, CAST(CAST(SUM(CAST(l_quantity AS BIGINT) % 4) AS BIGINT) AS STRING) AS assists,
        CASE WHEN MAX(l_linenumber) = 7 THEN '' ELSE CAST(CAST(SUM(CAST(l_quantity AS BIGINT) % 2) AS BIGINT) AS STRING) END AS ds,
        CAST(CAST(SUM(CAST(l_quantity AS BIGINT) % 5) AS BIGINT) AS STRING) AS turns
      FROM lineitem JOIN v_order ON l_orderkey = o_orderkey GROUP BY week, dcode, o_custkey % 40, l_suppkey""",
    "v_game_b": """
      SELECT event_id, game_key, slot, date, time, home_id, away_id,
        CASE WHEN game_key % 33 = 0 THEN home_score + 1 ELSE home_score END AS home_score, away_score, status, stage
      FROM v_game WHERE game_key % 50 <> 7""",
}

FIRST = ["Ana", "Bo", "Chloé", "Dan", "Eve", "Finn", "Gus", "Hana", "Ida", "José", "Kai", "Lou"]


def name_sql() -> str:
    """A player's name with spelling variants, one in seven with an apostrophe and a double space.

    Names of even keys come back in the same division, those of odd keys in another one.
    """
    first = "CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FIRST)) + " END"
    last = "CONCAT('Last', CAST(CASE WHEN c_custkey % 2 = 0 THEN {div:c_custkey|3} % 25 ELSE {div:c_custkey|3} % 41 END AS STRING))"
    return f"CONCAT({first}, CASE WHEN (c_custkey + t.season) % 7 = 0 THEN '  O’' ELSE ' ' END, {last})"


def _dialect(sql: str, duck: bool) -> str:
    sql = sql.replace("{name}", name_sql())
    sql = re.sub(r"\{spark:([^{}]*)\}", "" if duck else r"\1", sql)
    days = "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))" if duck else "datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01')"
    sql = sql.replace("{days}", days)
    sql = re.sub(r"\{div:([^|{}]*)\|([^{}]*)\}", (r"(\1 // \2)" if duck else r"(\1 div \2)"), sql)
    sql = re.sub(r"\{plus:([^|{}]*)\|([^{}]*)\}", (r"CAST(\1 + CAST(\2 AS INTEGER) AS DATE)" if duck else r"date_add(\1, CAST(\2 AS INT))"), sql)
    return sql.replace("AS STRING", "AS VARCHAR") if duck else sql


def duck_with() -> str:
    """The views as the beginning of a DuckDB WITH clause (recursive, so that it may go on with a recursive table)."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_dialect(s, True)})" for n, s in VIEWS.items())


_WRITTEN: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made from the tables of ``sf_dir`` once per application and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _WRITTEN:
        try:
            return spark.read.parquet(_WRITTEN[key])
        except AnalysisException:  # the folder has been cleared since
            del _WRITTEN[key]
    out = written(make(), name)
    files = out.inputFiles()
    if files:
        _WRITTEN[key] = files[0].rsplit("/", 1)[0]
    return out


def dealt(customer: DataFrame, rows: int = 2500) -> DataFrame:
    """Customers in equal parts, those of one squad side by side: each becomes a roster row a week, and aggregates by team, name or player shrink within a part."""
    k = F.col("c_custkey")
    return customer.repartitionByRange(max(1, customer.count() // rows), k % 5, k % 40, k)


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's SELECT over the tables of ``sf_dir`` and the views before it."""
    sql = _dialect(VIEWS[name], False)
    parts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem") if re.search(rf"\b{t}\b", sql)}
    parts |= {v: view(spark, sf_dir, v) for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)}
    if name == "v_roster":
        parts["customer"] = dealt(parts["customer"])
    for t in parts:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of ``sf_dir``."""
    return kept(spark, sf_dir, name, lambda: made(spark, sf_dir, name))
