"""The registered queries over the demo views, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake import vocab
from rosterlake.functions import measures, names
from rosterlake.operators import api, corpus, identity, metrics, rankings, ratings, tournaments, trends
from rosterlake.operators.graph import written
from rosterlake.sources import tables
from rosterlake.sources.demo import VIEWS, duck_with, kept, view

AS_OF = "1999-06-30"

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Views:
    """The demo views of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"v_{name}")

    def kept(self, name: str, make) -> DataFrame:
        return kept(self.spark, self.sf_dir, name, make)

    @property
    def games(self) -> DataFrame:
        return corpus.load_games(self.game, self.event)

    @property
    def clubs(self) -> DataFrame:
        return self.kept("clubs", lambda: corpus.load_clubs(self.team))

    @property
    def named(self) -> DataFrame:
        """Roster rows as the identity operators take them, not written, as they are many."""
        return self._described(self.roster)

    @property
    def spelled(self) -> DataFrame:
        """The same without the players: a row for all of a team with one spelling and pronouns, ``n`` in number."""
        columns = [c for c in self.roster.columns if c != "player_id"]
        return self.kept("spelled", lambda: self._described(self.roster.groupBy(*columns).agg(F.count("*").alias("n"))))

    def _described(self, rows: DataFrame) -> DataFrame:
        e = self.event.select("event_id", "start_date", "end_date")
        bare = self.team.select("event_team_id", names.norm_club(F.col("full_name"), F.col("display_name")).alias("club"))
        norms = self.kept("norms", lambda: identity.with_keys(self.roster.select("name").distinct(), "name", norm=names.norm_name))
        return rows.join(norms, "name", "left").join(bare, "event_team_id").join(e, "event_id")


def query(name: str, sql: str | None = None):
    """Register a function of the views; ``sql`` follows the views' WITH clause."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = duck_with() + (sql if sql.lstrip().startswith(",") else " " + sql)
        return f

    return add


_NAME = """trim(regexp_replace(regexp_replace(COALESCE(full_name, display_name, '?'), '\\s*\\(\\d+\\)\\s*$', ''), '\\s+', ' ', 'g'))"""
_BARE = f"lower(CASE lower({_NAME}) WHEN 'rhino' THEN 'Rhino Slam!' WHEN 'dark star-d' THEN 'Dark Star' ELSE {_NAME} END)"
_CLUB = f""", clubs AS (SELECT event_team_id, {_BARE} || CASE division WHEN 'club-mixed' THEN ' (mixed)' WHEN 'club-women' THEN ' (women''s)' ELSE '' END AS club FROM v_team)"""
_GAMES = """, games AS (SELECT g.event_id, game_key, season, division,
    LEAST(GREATEST(COALESCE(date, start_date), start_date), COALESCE(end_date, start_date)) AS date,
    CASE WHEN time IS NULL THEN '23:59' ELSE strftime(strptime(time, '%I:%M %p'), '%H:%M') END AS clock, stage, home_id, away_id, home_score, away_score
  FROM v_game g JOIN v_event e USING (event_id) WHERE home_score + away_score >= 4 AND status = 'Final')"""
_NAMED = _CLUB + f""", bare AS (SELECT event_team_id, {_BARE} AS club FROM v_team), named AS (SELECT r.*, c.club, e.start_date, e.end_date,
    lower(trim(regexp_replace(regexp_replace(strip_accents(r.name), '[.’'']', '', 'g'), '\\s+', ' ', 'g'))) AS norm
  FROM v_roster r JOIN bare c USING (event_team_id) JOIN v_event e ON r.event_id = e.event_id)"""


@query("s2_clean_games", _GAMES + " SELECT * FROM games")
def _(v):
    return v.games


@query("s3_stat_usage", """, lines AS (SELECT s.event_team_id, end_date, player_id, COALESCE(TRY_CAST(points AS INT), 0) p, COALESCE(TRY_CAST(assists AS INT), 0) a,
    COALESCE(TRY_CAST(ds AS INT), 0) d, COALESCE(TRY_CAST(turns AS INT), 0) t FROM v_stat s JOIN v_team USING (event_team_id) JOIN v_event e ON e.event_id = v_team.event_id WHERE end_date IS NOT NULL),
  w AS (SELECT *, SUM(p + a + d + t) OVER x AS total, COUNT(*) OVER x AS n FROM lines WINDOW x AS (PARTITION BY event_team_id, end_date))
  SELECT event_team_id, end_date, player_id, ROUND((p + a + d + t) * n / total::DOUBLE, 6) AS usage, p + a + d - t AS quality FROM w WHERE total > 0 AND n >= 2""")
def _(v):
    return corpus.load_stat_events(v.stat, v.team, v.event).withColumn("usage", F.round("usage", 6))


@query("s6_club_keys", _CLUB + " SELECT * FROM clubs")
def _(v):
    return v.clubs


@query("s9_conflicting_games", " SELECT a.event_id, a.game_key FROM v_game a JOIN v_game_b b USING (event_id, game_key) WHERE a.home_score <> b.home_score")
def _(v):
    return corpus.conflicting_keys([v.game, v.game_b], ["event_id", "game_key"])


@query("s10_upsert_events", """, o AS (SELECT event_id, rtrim(url, '/') AS url, division, name FROM v_event WHERE event_id % 3 <> 0),
  n AS (SELECT event_id + 1000000 AS event_id, rtrim(url, '/') AS url, division, upper(name) AS name FROM v_event WHERE event_id % 2 = 0)
  SELECT COALESCE(o.event_id, n.event_id) AS event_id, url, division, CASE WHEN n.event_id IS NOT NULL THEN n.name ELSE o.name END AS name FROM o FULL JOIN n USING (url, division)""")
def _(v):
    e = v.event.select("event_id", "url", "division", "name")
    return corpus.upsert_events(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").select((F.col("event_id") + 1000000).alias("event_id"), "url", "division", F.upper("name").alias("name")))


@query("s11_replace_event", """ SELECT * FROM v_game WHERE event_id NOT IN (SELECT event_id FROM v_game_b WHERE event_id % 5 = 0) UNION ALL SELECT * FROM v_game_b WHERE event_id % 5 = 0""")
def _(v):
    return corpus.replace_event(v.game, v.game_b.where("event_id % 5 = 0"))


@query("s12_drop_reseeded", """, g AS (SELECT event_id, CASE WHEN game_key % 11 = 0 THEN NULL ELSE slot END AS slot, CASE WHEN game_key % 11 = 0 THEN 'pool-' || slot ELSE game_key::VARCHAR END AS game_key FROM v_game),
  i AS (SELECT event_id, slot, 'new-' || max(game_key) AS game_key FROM v_game WHERE event_id % 3 = 0 AND slot < 2 GROUP BY event_id, slot)
  SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.event_id = g.event_id AND (i.slot = g.slot OR (g.slot IS NULL AND g.game_key = 'pool-' || i.slot))) UNION ALL SELECT * FROM i""")
def _(v):
    k, old = F.col("game_key"), F.col("game_key") % 11 == 0
    games = v.game.select("event_id", F.when(~old, F.col("slot")).alias("slot"), F.when(old, F.concat(F.lit("pool-"), F.col("slot").cast("string"))).otherwise(k.cast("string")).alias("game_key"))
    new = v.game.where("event_id % 3 = 0 and slot < 2").groupBy("event_id", "slot").agg(F.concat(F.lit("new-"), F.max("game_key").cast("string")).alias("game_key"))
    return corpus.drop_reseeded(games, new)


@query("s13_complete_events", f""", l AS (SELECT event_id, SUM(CASE WHEN event_team_id NOT IN (SELECT event_team_id FROM v_roster) THEN 1 ELSE 0 END) AS lacking FROM v_team GROUP BY event_id)
  SELECT event_id, COALESCE(end_date < DATE '{AS_OF}', false) AND (event_id % 9 = 0 OR COALESCE(lacking, 0) = 0) AS complete FROM v_event LEFT JOIN l USING (event_id)""")
def _(v):
    return corpus.mark_complete(v.event.withColumn("has_schedule", F.col("event_id") % 9 != 0), v.team, v.roster, AS_OF)


@query("s14_merge_divisions", """ SELECT event_id, division, name FROM v_event WHERE division <> 'college' UNION ALL
  SELECT event_id + 5000000, division, name FROM v_event WHERE division = 'college'""")
def _(v):
    e = v.event.select("event_id", "division", "name")
    return corpus.merge_divisions(e, e, "college", 5000000)


@query("s16_stale_events", f""", s AS (SELECT event_id, COUNT(*) AS n_games, SUM(CASE WHEN status = 'Final' AND home_score + away_score > 0 THEN 0 ELSE 1 END)::BIGINT AS n_open FROM v_game GROUP BY event_id)
  SELECT event_id, COALESCE(n_games, 0) AS n_games, COALESCE(n_open, 0) AS n_open FROM v_event LEFT JOIN s USING (event_id)
  WHERE COALESCE(end_date, start_date) < DATE '{AS_OF}' AND (COALESCE(n_games, 0) = 0 OR n_open > 0)""")
def _(v):
    return corpus.stale_events(v.event, v.game, AS_OF)


@query("s17_refresh_plan", f""", s AS (SELECT event_id, COUNT(*) AS n, SUM(CASE WHEN status = 'Final' AND home_score + away_score > 0 THEN 1 ELSE 0 END) AS own FROM v_game GROUP BY event_id),
  x AS (SELECT event_id, rtrim(url, '/') AS url, CASE WHEN event_id % 35 = 0 THEN 'Cancelled ' || name ELSE name END AS name, COALESCE(end_date, start_date) AS over, CASE WHEN event_id % 3 = 0 THEN 0 ELSE n - event_id % 2 END AS played, own, n
    FROM v_event JOIN s USING (event_id))
  SELECT url, CASE WHEN event_id % 5 <> 0 THEN 'replace' ELSE 'add' END AS action FROM x WHERE over < DATE '{AS_OF}' AND CASE WHEN event_id % 5 <> 0 THEN own < n AND played > own ELSE played > 0 AND name NOT LIKE 'Cancelled%' END""")
def _(v):
    k = F.col("event_id")
    n = v.game.groupBy("event_id").agg(F.count("*").alias("n"))
    name = F.when(k % 35 == 0, F.concat(F.lit("Cancelled "), "name")).otherwise(F.col("name"))
    offered = v.event.join(n, "event_id").select("url", name.alias("name"), "start_date", "end_date", F.when(k % 3 == 0, 0).otherwise(F.col("n") - k % 2).alias("played"))
    return corpus.refresh_plan(v.event.where("event_id % 5 <> 0"), corpus.stale_events(v.event, v.game, AS_OF), offered, AS_OF)


@query("s18_compare_providers", """, x AS (SELECT event_id, GREATEST(home_score, away_score) hi, LEAST(home_score, away_score) lo, COUNT(*) n FROM v_game WHERE status = 'Final' AND home_score + away_score > 0 GROUP BY ALL),
  y AS (SELECT event_id, GREATEST(home_score, away_score) hi, LEAST(home_score, away_score) lo, COUNT(*) n FROM v_game_b WHERE status = 'Final' AND home_score + away_score > 0 GROUP BY ALL)
  SELECT event_id, SUM(COALESCE(x.n, 0))::BIGINT AS n_a, SUM(COALESCE(y.n, 0))::BIGINT AS n_b, SUM(GREATEST(COALESCE(x.n, 0) - COALESCE(y.n, 0), 0))::BIGINT AS only_a,
    SUM(GREATEST(COALESCE(y.n, 0) - COALESCE(x.n, 0), 0))::BIGINT AS only_b FROM x FULL JOIN y USING (event_id, hi, lo) GROUP BY event_id HAVING n_a > 0 AND n_b > 0""")
def _(v):
    return corpus.compare_providers(v.game, v.game_b)


@query("s19_attach_structure", """, a AS (SELECT event_id, game_key, LEAST(home_id, away_id) t1, GREATEST(home_id, away_id) t2, LEAST(home_score, away_score) s1, GREATEST(home_score, away_score) s2,
    COUNT(*) OVER (PARTITION BY event_id, LEAST(home_id, away_id), GREATEST(home_id, away_id), LEAST(home_score, away_score), GREATEST(home_score, away_score)) n FROM v_game),
  b AS (SELECT event_id, stage, LEAST(home_id, away_id) t1, GREATEST(home_id, away_id) t2, LEAST(home_score, away_score) s1, GREATEST(home_score, away_score) s2,
    COUNT(*) OVER (PARTITION BY event_id, LEAST(home_id, away_id), GREATEST(home_id, away_id), LEAST(home_score, away_score), GREATEST(home_score, away_score)) n FROM v_game_b)
  SELECT a.event_id, a.game_key, b.stage AS stage_pub FROM a JOIN b USING (event_id, t1, t2, s1, s2) WHERE a.n = 1 AND b.n = 1""")
def _(v):
    return corpus.attach_structure(v.game, v.game_b)


@query("s20_event_filter", """ SELECT event_id, name FROM (SELECT event_id, event_id % 6 AS n, CASE WHEN division LIKE 'college%' AND event_id % 4 = 0 THEN division || '-d3' ELSE division END AS division,
    CASE event_id % 6 WHEN 1 THEN name || ' Masters' WHEN 2 THEN 'Developmental ' || name WHEN 3 THEN name || ' D-III' WHEN 4 THEN name || ' (cancelled)' ELSE name END AS name FROM v_event)
  WHERE n <> 4 AND CASE WHEN division LIKE '%-d3' THEN n = 3 WHEN division LIKE 'college%' THEN n NOT IN (2, 3) ELSE n <> 1 END""")
def _(v):
    n = F.col("event_id") % 6
    add = lambda text: F.concat("name", F.lit(text))
    name = F.when(n == 1, add(" Masters")).when(n == 2, F.concat(F.lit("Developmental "), "name")).when(n == 3, add(" D-III")).when(n == 4, add(" (cancelled)")).otherwise(F.col("name"))
    d3 = F.col("division").startswith("college") & (F.col("event_id") % 4 == 0)
    division = F.when(d3, F.concat("division", F.lit("-d3"))).otherwise(F.col("division"))
    return corpus.event_list_filter(v.event.withColumns({"name": name, "division": division})).select("event_id", "name")


@query("s21_division_scope", """, m AS (SELECT event_id, event_team_id, CASE WHEN event_id % 4 = 0 AND team % 2 = 0 THEN 'other' ELSE division END AS division FROM v_team),
  n AS (SELECT event_id, COUNT(DISTINCT division) k FROM m GROUP BY event_id)
  SELECT DISTINCT h.division, g.event_id, g.game_key FROM v_game g JOIN n USING (event_id) JOIN m h ON h.event_id = g.event_id JOIN m a ON a.event_id = g.event_id AND a.division = h.division
  WHERE k = 1 OR (h.event_team_id = g.home_id AND a.event_team_id = g.away_id)""")
def _(v):
    other = (F.col("event_id") % 4 == 0) & (F.col("team") % 2 == 0)
    return corpus.division_scope(v.game, v.team.withColumn("division", F.when(other, "other").otherwise(F.col("division"))))


@query("s24_link_sources", """ SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, url AS source_id, CAST(event_id AS VARCHAR) AS local_key FROM v_event""")
def _(v):
    rows = v.event.select(F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("url").alias("source_id"), F.col("event_id").cast("string").alias("local_key"))
    return corpus.link_sources(rows, rows.where("source = 'a'"))


@query("s27_roster_fallback", """, thin AS (SELECT event_id FROM v_team t LEFT JOIN (SELECT event_team_id, COUNT(*) c FROM v_roster GROUP BY 1) r USING (event_team_id) GROUP BY event_id HAVING COALESCE(SUM(c), 0) < 5 * COUNT(*))
  SELECT event_team_id, player_id FROM v_roster UNION ALL
  SELECT DISTINCT event_team_id, player_id FROM v_stat WHERE event_team_id IN (SELECT event_team_id FROM v_team WHERE event_id IN (SELECT event_id FROM thin))
    AND (event_team_id, player_id) NOT IN (SELECT event_team_id, player_id FROM v_roster)""")
def _(v):
    return corpus.roster_fallback(v.roster, v.team, v.stat)


@query("f_names", """ SELECT DISTINCT name, lower(trim(regexp_replace(regexp_replace(strip_accents(name), '[.’'']', '', 'g'), '\\s+', ' ', 'g'))) AS norm,
    split_part(lower(trim(regexp_replace(regexp_replace(strip_accents(name), '[.’'']', '', 'g'), '\\s+', ' ', 'g'))), ' ', 1) AS first FROM v_roster""")
def _(v):
    n = F.col("name")
    return v.roster.select("name").distinct().select("name", names.norm_name(n).alias("norm"), names.first_name(n).alias("first"))


@query("f_times", """ SELECT game_key, CASE WHEN time IS NULL THEN '23:59' ELSE strftime(strptime(time, '%I:%M %p'), '%H:%M') END AS clock,
    CASE WHEN time IS NULL THEN 10000 ELSE (date_part('hour', strptime(time, '%I:%M %p')) * 60 + date_part('minute', strptime(time, '%I:%M %p')))::INT END AS minutes,
    CASE WHEN game_key % 2 = 0 THEN (game_key % 8)::INT * 12 + (game_key % 12)::INT END AS inches FROM v_game""")
def _(v):
    k = F.col("game_key")
    height = F.when(k % 2 == 0, F.concat((k % 8).cast("string"), F.lit("'"), (k % 12).cast("string"), F.lit('"'))).otherwise("tall")
    return v.game.select("game_key", measures.clock(F.col("time")).alias("clock"), measures.minutes_of_day(F.col("time")).alias("minutes"), measures.inches(height).alias("inches"))


# what each label of the demo names, by the rules for rounds, places and games to go
_KIND = """CASE stage WHEN 'Finals' THEN 'champ' WHEN 'Semi Finals' THEN 'champ' WHEN '9th Place Quarters' THEN '9th' WHEN 'Game to Go' THEN 'gtg' WHEN 'Third Place' THEN '3rd' WHEN 'Pre-Quarters' THEN 'champ'
  WHEN 'Consolation Semis' THEN 'consolation' WHEN 'Back Door Final' THEN 'back door' WHEN 'Round of 32' THEN 'champ' WHEN 'T-5 Final' THEN '5' WHEN '13th/14th Place' THEN '13th' END"""
_RANK = """CASE stage WHEN 'Finals' THEN 0 WHEN 'Semi Finals' THEN 1 WHEN '9th Place Quarters' THEN 2 WHEN 'Game to Go' THEN 0 WHEN 'Third Place' THEN 0 WHEN 'Pre-Quarters' THEN 3
  WHEN 'Consolation Semis' THEN 1 WHEN 'Back Door Final' THEN 0 WHEN 'Round of 32' THEN 4 WHEN 'T-5 Final' THEN 0 WHEN '13th/14th Place' THEN 0 END::INT"""


@query("f_labels", f" SELECT DISTINCT stage, {_KIND} AS kind, {_RANK} AS rank, stage LIKE 'Pool%' AS poolish FROM v_game")
def _(v):
    s = F.col("stage")
    return v.game.select("stage", measures.bracket_kind(s).alias("kind"), measures.round_rank(s).alias("rank"), measures.poolish(s).alias("poolish")).distinct()


@query("f_math", """ SELECT game_key, ROUND(1 / (1 + pow(10, (away_score - home_score) * 20 / 400.0)), 9) AS chance,
    ROUND(CASE WHEN home_score = away_score THEN 1.0 ELSE ln(1 + abs(home_score - away_score)) / ln(8.0) END, 9) AS mov, ROUND(1 + 5.0 * 10 / (10 + home_score), 9) AS provisional,
    ROUND(sqrt(470.0 * 470.0 / home_score + 49.0 * 49.0), 9) AS sigma, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE 0.5 END::DOUBLE AS outcome FROM v_game""")
def _(v):
    h, a = F.col("home_score"), F.col("away_score")
    return v.game.select("game_key", F.round(measures.expect(h * 20.0, a * 20.0, 400.0), 9).alias("chance"), F.round(measures.margin_multiplier(F.abs(h - a)), 9).alias("mov"),
                         F.round(measures.provisional(h), 9).alias("provisional"), F.round(measures.rating_sigma(h), 9).alias("sigma"), measures.outcome(h, a).alias("outcome"))


@query("f_ids", """ SELECT event_id, -('0x' || substr(sha256('events' || chr(0) || url), 1, 13))::BIGINT AS id, 'gq:' || substr(sha1(url || chr(0) || division), 1, 32) AS key,
    substr(sha256(url || chr(0) || division), 1, 24) AS stable FROM v_event""")
def _(v):
    u, d = F.col("url"), F.col("division")
    return v.event.select("event_id", names.stable_id("events", u).alias("id"), names.team_key(u, d).alias("key"), names.stable_key(u, d).alias("stable"))


@query("i1_name_appearances", _NAMED + " SELECT norm, division, season, COUNT(DISTINCT club) AS n_clubs, MIN(club) AS first_club, COUNT(*) AS n_rows FROM named GROUP BY ALL")
def _(v):
    return identity.name_appearances(v.named)


_G = "CASE WHEN division IN ('club-women', 'college-women') THEN 'w' WHEN division = 'club-mixed' THEN NULL ELSE 'm' END"
_PRONOUN = "CASE pronouns WHEN 'H' THEN 'm' WHEN 'S/T' THEN 'w' END"


@query("i2_gender_split", _NAMED + f" SELECT norm FROM named GROUP BY norm HAVING COUNT(DISTINCT {_G}) = 2")
def _(v):
    return identity.gender_split(v.spelled)


@query("i3_raw_ambiguous", _NAMED + " SELECT DISTINCT norm FROM (SELECT norm FROM named GROUP BY norm, division, season HAVING COUNT(DISTINCT club) > 1)")
def _(v):
    return identity.raw_ambiguous(v.spelled)


_CONFLICT = """, amb AS (SELECT DISTINCT norm FROM (SELECT norm FROM named GROUP BY norm, division, season HAVING COUNT(DISTINCT club) > 1)),
  spans AS (SELECT DISTINCT norm, club, event_id, start_date AS s, COALESCE(end_date, start_date) AS e FROM named WHERE norm IN (SELECT norm FROM amb)),
  conflict AS (SELECT DISTINCT a.norm FROM spans a JOIN spans b ON a.norm = b.norm AND a.club <> b.club AND a.event_id <> b.event_id AND a.s <= b.e AND b.s <= a.e)"""


@query("i4_date_conflicts", _NAMED + _CONFLICT + " SELECT norm FROM conflict")
def _(v):
    return identity.date_conflicts(v.spelled)


_KEYED = _CONFLICT + f""", split AS (SELECT norm FROM named GROUP BY norm HAVING COUNT(DISTINCT {_G}) = 2),
  keyed AS (SELECT *, norm IN (SELECT norm FROM conflict) AND norm NOT LIKE 'bo %' AS ambiguous, CASE WHEN norm LIKE 'eve last2%' AND club IN ('the team 3', 'the team 23') THEN 'scoped|' || norm || '|/the team 23,the team 3'
    WHEN norm LIKE 'ana last1%' AND division IN ('club-men', 'club-mixed') THEN 'scoped|' || norm || '|club-men,club-mixed/'
    WHEN norm IN (SELECT norm FROM conflict) AND norm NOT LIKE 'bo %' THEN 'club|' || norm || '|' || club
    WHEN norm LIKE 'dan %' THEN 'division|' || norm || '|' || division WHEN norm LIKE 'bo %' THEN 'name|' || norm
    WHEN norm IN (SELECT norm FROM split) THEN 'gender|' || norm || '|' || COALESCE({_G}, {_PRONOUN}, '?') ELSE 'name|' || norm END AS identity FROM named)"""


def _overrides(v) -> DataFrame:
    """Reviewed names: blocked, merged as a whole, merged by divisions or clubs, confirmed."""
    n = F.col("norm")
    action = F.when(n.like("dan %"), "block").when(n.like("kai %"), "confirm").when(n.like("bo %") | n.like("ana last1%") | n.like("eve last2%"), "merge")
    scope, clubs = F.when(n.like("ana last1%"), "club-men|club-mixed"), F.when(n.like("eve last2%"), "The Team 3| The  Team 23")
    make = lambda: v.spelled.select("norm").distinct().select(n.alias("norm_name"), action.alias("action"), F.lit("").alias("note"), scope.alias("scope"), clubs.alias("clubs")).where("action is not null")
    return v.kept("overrides", make)


def _keyed(v) -> DataFrame:
    return identity.identity_keys(v.spelled, _overrides(v))


@query("i6_identity_keys", _NAMED + _KEYED + " SELECT DISTINCT norm, division, club, identity FROM keyed")
def _(v):
    return _keyed(v).select("norm", "division", "club", "identity").distinct()


@query("i8_display_names", _NAMED + _KEYED + """, shown AS (SELECT norm, trim(regexp_replace(arg_min(name, {'a': event_id, 'b': event_team_id, 'c': name}), '\\s+', ' ', 'g')) AS display_name FROM keyed GROUP BY norm)
  SELECT DISTINCT identity, display_name FROM keyed JOIN shown USING (norm)""")
def _(v):
    return identity.display_names(_keyed(v))


@query("i9_roster_players", _NAMED + _KEYED + " SELECT event_team_id, name, arg_min(identity, {'p': COALESCE(pronouns, ''), 'i': identity}) AS identity FROM keyed GROUP BY event_team_id, name")
def _(v):
    return identity.roster_players(_keyed(v))


_EVIDENCE = f""", n AS (SELECT identity, SUM(COALESCE({_G} = 'm', false)::INT) dm, SUM(COALESCE({_G} = 'w', false)::INT) dw, SUM(CASE WHEN {_G} IS NULL AND {_PRONOUN} = 'm' THEN 1 ELSE 0 END) pm,
    SUM(CASE WHEN {_G} IS NULL AND {_PRONOUN} = 'w' THEN 1 ELSE 0 END) pw FROM keyed GROUP BY identity),
  evidence AS (SELECT identity, CASE WHEN dm > 0 AND dw = 0 THEN 'm' WHEN dw > 0 AND dm = 0 THEN 'w' WHEN pm > pw THEN 'm' WHEN pw > pm THEN 'w' END AS gender,
    CASE WHEN (dm > 0 AND dw = 0) OR (dw > 0 AND dm = 0) THEN 'division' WHEN pm <> pw THEN 'pronouns' END AS gender_source FROM n)"""


@query("i10_gender_evidence", _NAMED + _KEYED + _EVIDENCE + " SELECT * FROM evidence")
def _(v):
    return identity.gender_evidence(_keyed(v))


@query("i11_name_likelihood", _NAMED + _KEYED + _EVIDENCE + """, k AS (SELECT split_part(split_part(identity, '|', 2), ' ', 1) AS first, gender FROM evidence WHERE gender IS NOT NULL),
  p AS (SELECT first, COUNT(*) AS seen, SUM((gender = 'm')::INT) m, SUM((gender = 'w')::INT) w FROM k GROUP BY first),
  t AS (SELECT SUM((gender = 'm')::INT) am, SUM((gender = 'w')::INT) aw FROM k),
  s AS (SELECT first, seen, (m / greatest(am, 1)) / (m / greatest(am, 1) + w / greatest(aw, 1)) AS share FROM p, t WHERE seen >= 5)
  SELECT first, seen, CASE WHEN share >= 0.6 THEN 'm' ELSE 'w' END AS gender FROM s WHERE share >= 0.6 OR 1 - share >= 0.6""")
def _(v):
    known = identity.gender_evidence(_keyed(v)).select(F.split_part(F.split_part("identity", F.lit("|"), F.lit(2)), F.lit(" "), F.lit(1)).alias("first"), "gender")
    return identity.name_likelihood(known, min_share=0.6)


@query("i12_ambiguity_report", _NAMED + _CONFLICT + """ SELECT norm, division, season, string_agg(club, '; ' ORDER BY club) AS clubs, CASE WHEN norm IN (SELECT norm FROM conflict) AND norm NOT LIKE 'bo %' THEN 'split' ELSE 'auto-merged' END AS verdict
  FROM (SELECT DISTINCT norm, division, season, club FROM named) GROUP BY norm, division, season HAVING COUNT(*) > 1""")
def _(v):
    return identity.ambiguity_report(v.spelled, _overrides(v))


@query("i12_bridge_report", _NAMED + _KEYED + """, d AS (SELECT norm, string_agg(division, '; ' ORDER BY division) AS divisions FROM (SELECT DISTINCT norm, division FROM named) GROUP BY norm HAVING COUNT(*) > 1),
  c AS (SELECT norm, string_agg(club, '; ' ORDER BY club) AS teams FROM (SELECT DISTINCT norm, club FROM named) GROUP BY norm)
  SELECT norm, divisions, teams FROM d JOIN c USING (norm) WHERE norm NOT IN (SELECT norm FROM split) AND norm NOT LIKE 'dan %' AND (norm LIKE 'bo %' OR norm NOT IN (SELECT norm FROM conflict))""")
def _(v):
    return identity.bridge_report(v.spelled, _overrides(v))


@query("i13_bridge_candidates", _NAMED + _KEYED + """, one AS (SELECT norm, MIN(identity) AS identity FROM keyed WHERE division <> 'college' GROUP BY norm HAVING COUNT(DISTINCT identity) = 1),
  sh AS (SELECT norm, COUNT(*) AS shared_seasons FROM (SELECT DISTINCT norm, season FROM named WHERE division = 'college' INTERSECT SELECT DISTINCT norm, season FROM named WHERE division <> 'college') GROUP BY norm)
  SELECT norm, identity, shared_seasons FROM one JOIN sh USING (norm)""")
def _(v):
    keyed = _keyed(v)
    return identity.bridge_candidates(keyed.where("division = 'college'"), keyed.where("division <> 'college'"))


@query("i16_match_clubs", _CLUB + """, k AS (SELECT t.event_team_id, event_id, division, team, season, split_part(club, ' (', 1) AS key, club FROM clubs JOIN v_team t USING (event_team_id)),
  x AS (SELECT division, key, MIN(c) AS own FROM (SELECT division, key, club || CASE WHEN team % 8 = 4 AND season % 2 = 0 THEN ' b' ELSE '' END AS c FROM k WHERE event_id // 10 % 2 = 0 AND team % 4 <> 1) GROUP BY ALL HAVING COUNT(DISTINCT c) = 1),
  y AS (SELECT CASE division WHEN 'club-men' THEN 'club-men' WHEN 'club-women' THEN 'club-women' WHEN 'club-mixed' THEN 'club-mixed' END AS division, key, MIN('euf:' || key) AS eu FROM k WHERE team % 4 = 1 AND division LIKE 'club%' GROUP BY ALL)
  SELECT event_team_id, COALESCE(own, eu) AS club FROM k LEFT JOIN x USING (division, key) LEFT JOIN y USING (division, key) WHERE event_id // 10 % 2 = 1""")
def _(v):
    rows = v.clubs.join(v.team.select("event_team_id", "division", "event_id", "team", "season"), "event_team_id").withColumn("key", F.split_part("club", F.lit(" ("), F.lit(1)))
    other = (F.col("team") % 8 == 4) & (F.col("season") % 2 == 0)
    ours = rows.where("event_id div 10 % 2 = 0 and team % 4 <> 1").select("division", "key", F.when(other, F.concat("club", F.lit(" b"))).otherwise(F.col("club")).alias("club"))
    name = F.create_map(*[F.lit(x) for x in ("club-men", "euf-open", "club-women", "euf-women", "club-mixed", "euf-mixed")])
    european = rows.where("team % 4 = 1 and division like 'club%'").select(name[F.col("division")].alias("division"), "key", F.concat(F.lit("euf:"), "key").alias("club"))
    return identity.match_clubs(rows.where("event_id div 10 % 2 = 1").select("event_team_id", "division", "key"), ours, european)


@query("i18_link_by_evidence", """, a AS (SELECT c_custkey AS a_id, c_custkey % 500 AS norm, [c_nationkey] AS cities, [c_custkey % 9] AS jerseys, [CAST(1995 + c_custkey % 6 AS INT)] AS years FROM customer),
  b AS (SELECT s_suppkey AS b_id, s_suppkey AS norm, [s_nationkey] AS cities, [s_suppkey % 4] AS jerseys, [CAST(1995 + s_suppkey % 5 AS INT)] AS years FROM supplier UNION ALL
        SELECT s_suppkey + 10000, s_suppkey, [CAST((s_nationkey + 1) % 25 AS INT)], [s_suppkey % 5], [CAST(1995 + s_suppkey % 4 AS INT)] FROM supplier WHERE s_suppkey % 3 <> 0),
  c AS (SELECT a_id, b_id, CASE WHEN b_id IS NOT NULL THEN list_has_any(a.cities, b.cities)::INT + list_has_any(a.jerseys, b.jerseys)::INT + list_has_any(a.years, b.years)::INT END AS ev FROM a LEFT JOIN b USING (norm)),
  r AS (SELECT *, ROW_NUMBER() OVER w AS k, LEAD(ev) OVER w AS nx FROM c WINDOW w AS (PARTITION BY a_id ORDER BY ev DESC NULLS LAST, b_id)),
  z AS (SELECT *, CASE WHEN b_id IS NULL THEN 'no-match' WHEN ev > 0 AND COALESCE(nx, 0) = 0 THEN 'linked' WHEN nx IS NOT NULL THEN 'ambiguous' ELSE 'no-corroboration' END AS audit FROM r WHERE k = 1)
  SELECT a_id, CASE WHEN audit = 'linked' THEN b_id END AS b_id, audit FROM z""")
def _(v):
    read = lambda t: v.spark.read.parquet(f"{v.sf_dir}/{t}.parquet")
    year = lambda c: F.array((F.lit(1995) + c).cast("int")).alias("years")
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    a = read("customer").select(k.alias("a_id"), (k % 500).alias("norm"), F.array("c_nationkey").alias("cities"), F.array(k % 9).alias("jerseys"), year(k % 6))
    sup = read("supplier")
    b = sup.select(s.alias("b_id"), s.alias("norm"), F.array("s_nationkey").alias("cities"), F.array(s % 4).alias("jerseys"), year(s % 5)).unionByName(
        sup.where("s_suppkey % 3 <> 0").select((s + 10000).alias("b_id"), s.alias("norm"), F.array(((F.col("s_nationkey") + 1) % 25).cast("int")).alias("cities"), F.array(s % 5).alias("jerseys"), year(s % 4))
    )
    return identity.link_by_evidence(a, b)


def _stats(v) -> DataFrame:
    """Stat lines with the event that earned them."""
    return corpus.load_stat_events(v.stat, v.team, v.event).join(v.team.select("event_team_id", "event_id"), "event_team_id")


def _corpus(v, stats: bool = True) -> ratings.Corpus:
    return ratings.Corpus(v.games, v.roster.select("event_team_id", "player_id"), v.clubs, _stats(v) if stats else None)


def _replay(v, **options) -> ratings.Replay:
    return ratings.replay_player_elo(*_corpus(v), **options)


@query("r1_player_elo")
def _(v):
    return _replay(v).moves


@query("r1_player_elo_by_components")
def _(v):
    """The same replay in one slice of all days, cut into components of players; the tests hold both plans against a plain fold."""
    return _replay(v, plan="component").moves


# a fold of every season's games, one step per game: the ratings of its clubs as a list, a club's first one from its first division
_POOL = _GAMES + _CLUB + """, one AS (SELECT season, division, game_key, h.club AS home, a.club AS away, home_score, away_score,
    CASE division WHEN 'club-men' THEN 1500.0 WHEN 'college' THEN 1250.0 WHEN 'club-mixed' THEN 1500.0 WHEN 'club-women' THEN 1600.0 ELSE 1250.0 END::DOUBLE AS b,
    CASE division WHEN 'club-men' THEN 260.0 WHEN 'college' THEN 260.0 WHEN 'club-mixed' THEN 220.0 WHEN 'club-women' THEN 160.0 ELSE 200.0 END::DOUBLE AS sc,
    ROW_NUMBER() OVER (PARTITION BY season ORDER BY date, clock, event_id, game_key) AS step FROM games g JOIN clubs h ON h.event_team_id = home_id JOIN clubs a ON a.event_team_id = away_id),
  ids AS (SELECT season, club, arg_min(b, step) AS b, ROW_NUMBER() OVER (PARTITION BY season ORDER BY club) AS i FROM (SELECT season, home AS club, b, step FROM one UNION ALL SELECT season, away, b, step FROM one) GROUP BY season, club),
  steps AS (SELECT o.*, h.i AS hi, a.i AS ai FROM one o JOIN ids h ON h.season = o.season AND h.club = home JOIN ids a ON a.season = o.season AND a.club = away),
  base AS (SELECT season, list(b ORDER BY i) AS r FROM ids GROUP BY season),
  fold(season, step, game_key, expected, r, g) AS (
    SELECT season, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, r, list_transform(r, lambda x: 0::BIGINT) FROM base
    UNION ALL
    SELECT f.season, s.step, s.game_key, x.e,
      list_transform(f.r, lambda q, i: q + CASE WHEN i = s.hi THEN x.d * (1 + 50.0 / (10 + f.g[i])) WHEN i = s.ai THEN -x.d * (1 + 50.0 / (10 + f.g[i])) ELSE 0 END),
      list_transform(f.g, lambda q, i: q + CASE WHEN i = s.hi OR i = s.ai THEN 1 ELSE 0 END)
    FROM fold f JOIN steps s ON s.season = f.season AND s.step = f.step + 1,
    LATERAL (SELECT 1 / (1 + pow(10, (f.r[s.ai] - f.r[s.hi]) / s.sc)) AS e, 48.0 * CASE WHEN s.home_score = s.away_score THEN 1.0 ELSE ln(1 + abs(s.home_score - s.away_score)) / ln(8.0) END
      * (CASE WHEN s.home_score > s.away_score THEN 1.0 WHEN s.home_score < s.away_score THEN 0.0 ELSE 0.5 END - 1 / (1 + pow(10, (f.r[s.ai] - f.r[s.hi]) / s.sc))) AS d) x)"""


@query("r2_team_elo_reset", _POOL + " SELECT game_key, ROUND(expected, 6) AS expected FROM fold WHERE step > 0")
def _(v):
    moves = ratings.replay_team_elo(v.games, v.clubs, kind="reset").moves
    return moves.select("game_key", F.round("expected", 6).alias("expected"))


_CARRY = _POOL.replace("PARTITION BY season ORDER BY", "ORDER BY").replace("SELECT season, club, arg_min", "SELECT 0 AS season, club, arg_min").replace("GROUP BY season, club)", "GROUP BY club)").replace("h.season = o.season AND ", "").replace("a.season = o.season AND ", "").replace("SELECT o.*, h.i AS hi", "SELECT o.* REPLACE (0 AS season), h.i AS hi")


@query("r2_team_elo_carry", _CARRY + " SELECT game_key, ROUND(expected, 6) AS expected FROM fold WHERE step > 0")
def _(v):
    return ratings.replay_team_elo(v.games, v.clubs, kind="carry").moves.select("game_key", F.round("expected", 6).alias("expected"))


@query("r3_glicko2")
def _(v):
    return ratings.replay_glicko2(*_corpus(v)).state


@query("r4_walk_forward")
def _(v):
    """The rating difference before every game, from the earlier days of its season."""
    return ratings.walk_forward(v.games, v.clubs)


@query("r4_batch_teams")
def _(v):
    return ratings.rate_teams_batch(v.games, v.clubs)


_DIFF = "SELECT (home_score - away_score) * 15.0 + game_key % 40 AS diff, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE 0.5 END AS outcome FROM games"
_LOSS = "AVG(-(outcome * ln(p) + (1 - outcome) * ln(1 - p)))"


@query("r6_fit_scale", _GAMES + f""", d AS ({_DIFF}), c AS (SELECT s, ROUND({_LOSS}, 12) AS loss FROM (SELECT outcome, s, LEAST(GREATEST(1 / (1 + pow(10, -diff / s)), 1e-12), 1 - 1e-12) AS p FROM d, (SELECT unnest(range(50, 1501, 25))::DOUBLE AS s)) GROUP BY s),
  b AS (SELECT s AS top FROM c ORDER BY loss, s LIMIT 1), f AS (SELECT DISTINCT GREATEST(30.0, top + k)::DOUBLE AS s FROM b, (SELECT unnest([0, -24, -19, -14, -9, -4, 1, 6, 11, 16, 21]) AS k)),
  e AS (SELECT s, ROUND({_LOSS}, 12) AS loss FROM (SELECT outcome, s, LEAST(GREATEST(1 / (1 + pow(10, -diff / s)), 1e-12), 1 - 1e-12) AS p FROM d, f) GROUP BY s)
  SELECT s AS scale, ROUND(loss, 9) AS loss FROM e ORDER BY e.loss, s LIMIT 1""")
def _(v):
    h, a = F.col("home_score"), F.col("away_score")
    d = v.games.select(((h - a) * 15.0 + F.col("game_key") % 40).alias("diff"), measures.outcome(h, a).alias("outcome"))
    return ratings.fit_scale(d).select("scale", F.round("loss", 9).alias("loss"))


@query("r7_config_sweep")
def _(v):
    configs = [ratings.EloConfig(k=k, tau=t) for k in (24.0, 48.0) for t in (150.0, 500.0)]
    return ratings.sweep(*_corpus(v, False), configs)


@query("r7a_descent")
def _(v):
    """The moves of a descent over two options."""
    axes = [("k", [24.0, 72.0]), ("tau", [150.0])]
    _, moves = ratings.descend(*_corpus(v, False), axes, (1995, 1998), passes=1)
    return v.spark.createDataFrame([(i, axis, float(x), gain) for i, (axis, x, gain) in enumerate(moves)], "step int, axis string, value double, gain double")


# predictions of a fixed rating, to score in both engines
_PRED = _GAMES + ", pred AS (SELECT game_key, event_id, season, division, date, 1 / (1 + pow(10, ((game_key * 7) % 21 - 10) / 20.0)) AS expected, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE 0.5 END AS outcome FROM games)"
_SCORES = """COUNT(*) AS n, ROUND(AVG(CASE WHEN (expected > 0.5 AND outcome = 1) OR (expected < 0.5 AND outcome = 0) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, ROUND(AVG(pow(expected - outcome, 2)), 9) AS brier,
  ROUND(AVG(-(outcome * ln(LEAST(GREATEST(expected, 1e-12), 1 - 1e-12)) + (1 - outcome) * ln(1 - LEAST(GREATEST(expected, 1e-12), 1 - 1e-12)))), 9) AS log_loss"""


def _pred(v) -> DataFrame:
    e = 1 / (1 + F.pow(F.lit(10.0), ((F.col("game_key") * 7) % 21 - 10) / 20.0))
    return v.games.select("game_key", "event_id", "season", "division", "date", e.alias("expected"), measures.outcome(F.col("home_score"), F.col("away_score")).alias("outcome"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("accuracy", "brier", "log_loss")})


@query("m1_metrics_cube", _PRED + f" SELECT season, division, {_SCORES} FROM pred GROUP BY CUBE (season, division)")
def _(v):
    return _rounded(metrics.cube(_pred(v)))


@query("m2_scorecard", _PRED + f""", s AS (SELECT 'all' AS slice, * FROM pred UNION ALL SELECT 'val', * FROM pred WHERE season BETWEEN 1997 AND 1998 UNION ALL SELECT 'test', * FROM pred WHERE season BETWEEN 1999 AND 2000
  UNION ALL SELECT 'test ' || division, * FROM pred WHERE season BETWEEN 1999 AND 2000 UNION ALL SELECT '2001', * FROM pred WHERE season = 2001) SELECT slice, {_SCORES} FROM s GROUP BY slice""")
def _(v):
    return _rounded(metrics.scorecard(_pred(v), (1997, 1998), (1999, 2000), 2001))


_CUM = []
for _k in range(8):
    _CUM.append((_CUM[-1][0] + _CUM[-1][1] / _k, _CUM[-1][1] / _k) if _k else (2.718281828459045**-1, 2.718281828459045**-1))


@query("m4_paired_bootstrap", _PRED + f""", ds AS (SELECT game_key, -(outcome * ln(GREATEST(expected, 1e-12)) + (1 - outcome) * ln(GREATEST(1 - expected, 1e-12))) + (outcome * ln(GREATEST(other, 1e-12)) + (1 - outcome) * ln(GREATEST(1 - other, 1e-12))) AS d
    FROM (SELECT *, 0.5 * expected + 0.25 AS other FROM pred)),
  h AS (SELECT d, pair, md5('0|' || game_key || '|' || pair) AS h FROM ds, (SELECT unnest(range(1000)) AS pair)),
  u AS (SELECT d, 2 * pair + i AS draw, ('0x' || substr(h, 1 + 16 * i, 13))::BIGINT / 4503599627370496.0 AS u FROM h, (SELECT unnest([0, 1]) AS i)),
  w AS (SELECT d, draw, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c, _ in _CUM)} AS w FROM u), m AS (SELECT draw, SUM(w * d) / SUM(w) AS m FROM w GROUP BY draw)
  SELECT ROUND(AVG(m), 9) AS mean, ROUND(quantile_cont(m, 0.05), 9) AS low, ROUND(quantile_cont(m, 0.95), 9) AS high FROM m""")
def _(v):
    a = _pred(v)
    out = metrics.paired_bootstrap(a, a.withColumn("expected", 0.5 * F.col("expected") + 0.25))
    return out.select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("m5_objective", _PRED + f", s AS (SELECT division, {_SCORES.replace('ROUND(AVG(-', '(AVG(-').replace(', 9) AS log_loss', ') AS log_loss')} FROM pred GROUP BY division) SELECT ROUND(SUM(n * log_loss) / SUM(n), 9) AS objective FROM s")
def _(v):
    return metrics.objective(_pred(v)).select(F.round("objective", 9).alias("objective"))


# a rating that both engines compute: 1000 + a hash-like spread of the key
def _ratings(v) -> DataFrame:
    return v.roster.groupBy("player_id").agg(F.count("*").alias("games")).select("player_id", (1000 + (F.col("player_id") * 7919) % 1000).cast("double").alias("rating"), "games")


_RATINGS = ", rated AS (SELECT player_id, (1000 + (player_id * 7919) % 1000)::DOUBLE AS rating, COUNT(*) AS games FROM v_roster GROUP BY player_id)"


@query("w1_rank_players", _RATINGS + """ SELECT CAST(player_id AS VARCHAR) AS player, rating, games, round_even(rating - 1.645 * sqrt(470.0 * 470.0 / games + 2401.0), 1) AS lo90, round_even(rating + 1.645 * sqrt(470.0 * 470.0 / games + 2401.0), 1) AS hi90,
  ROW_NUMBER() OVER (ORDER BY rating DESC, CAST(player_id AS VARCHAR) DESC) AS rank FROM rated WHERE games >= 5""")
def _(v):
    return rankings.rank_players(_ratings(v).select(F.col("player_id").cast("string").alias("player"), "rating", "games"))


@query("w2_last_appearance", " SELECT player_id, (max({'s': start_date, 't': event_team_id})).s AS start_date, (max({'s': start_date, 't': event_team_id})).t AS event_team_id FROM v_roster JOIN v_event USING (event_id) GROUP BY player_id")
def _(v):
    return rankings.last_appearance(v.roster, v.event)


_WHEN = {"completed": f"end_date <= DATE '{AS_OF}'", "upcoming": f"(end_date >= DATE '{AS_OF}' OR (end_date IS NULL AND start_date >= DATE '{AS_OF}'))"}
for _basis, _order in (("completed", "start_date DESC"), ("upcoming", "start_date")):

    @query(f"w3_latest_rosters_{_basis}", _CLUB + f""", x AS (SELECT e.season, e.division, club, event_team_id, start_date, end_date FROM v_team t JOIN clubs USING (event_team_id) JOIN v_event e ON e.event_id = t.event_id WHERE e.season = {AS_OF[:4]})
      SELECT season, division, club, event_team_id, start_date FROM x WHERE {_WHEN[_basis]} QUALIFY ROW_NUMBER() OVER (PARTITION BY division, club ORDER BY {_order}, event_team_id DESC) = 1""")
    def _(v, basis=_basis):
        return rankings.latest_rosters(v.team, v.clubs, v.event, AS_OF, int(AS_OF[:4]), basis)


_STRENGTH = _CLUB + _RATINGS + """, st AS (SELECT event_team_id, SUM(exp((rating - top) / 500) * rating) / SUM(exp((rating - top) / 500)) AS strength, COUNT(*) AS n
    FROM (SELECT event_team_id, rating, MAX(rating) OVER (PARTITION BY event_team_id) AS top FROM v_roster JOIN rated USING (player_id)) GROUP BY event_team_id),
  best AS (SELECT division, club, event_team_id, n, strength FROM (SELECT *, MAX(n) OVER (PARTITION BY division, club) AS most FROM st JOIN clubs USING (event_team_id) JOIN v_team USING (event_team_id))
    WHERE n >= 0.8 * most QUALIFY ROW_NUMBER() OVER (PARTITION BY division, club ORDER BY ROUND(strength, 9) DESC, event_team_id) = 1)"""


def _best(v) -> DataFrame:
    strength = rankings.team_strength(v.roster.select("event_team_id", "player_id"), _ratings(v).select("player_id", "rating"))
    return rankings.best_rosters(strength, v.team, v.clubs)


@query("w4_best_rosters", _STRENGTH + " SELECT division, club, event_team_id, n, ROUND(strength, 6) AS strength FROM best")
def _(v):
    return _best(v).withColumn("strength", F.round("strength", 6))


@query("w6_team_table", _STRENGTH + " SELECT division, club, round_even(strength, 1) AS strength, n, ROW_NUMBER() OVER (PARTITION BY division ORDER BY ROUND(strength, 9) DESC, club DESC) AS rank FROM best")
def _(v):
    return rankings.team_table(_best(v))


_CODE = "CASE division WHEN 'club-men' THEN 0 WHEN 'college' THEN 1 WHEN 'club-mixed' THEN 3 WHEN 'club-women' THEN 4 WHEN 'college-women' THEN 5 ELSE 0 END"


@query("w7_division_masks", f""", r AS (SELECT player_id, r.season, r.division, start_date, {_CODE} AS code FROM (SELECT player_id, event_id, season, division FROM v_roster) r JOIN (SELECT event_id, start_date FROM v_event) USING (event_id)),
  now AS (SELECT player_id, division, code, division IN ('club-men', 'club-mixed', 'club-women') AS club, COUNT(*) AS n, MAX(start_date) AS latest FROM r
    WHERE season = (SELECT MAX(season) FROM r x WHERE x.player_id = r.player_id) GROUP BY ALL),
  kept AS (SELECT player_id, code FROM now QUALIFY NOT club OR ROW_NUMBER() OVER (PARTITION BY player_id, club ORDER BY n DESC, latest DESC, code) = 1)
  SELECT player_id, divisions, divisions_now FROM (SELECT player_id, bit_or(1::BIGINT << code) AS divisions FROM r GROUP BY 1) JOIN (SELECT player_id, bit_or(1::BIGINT << code) AS divisions_now FROM kept GROUP BY 1) USING (player_id)""")
def _(v):
    return rankings.division_masks(v.roster.select("player_id", "event_id", "season", "division").join(v.event.select("event_id", "start_date"), "event_id"))


# the home club's rating after each game of its season
_POINTS = _POOL + """, points AS (SELECT s.home AS subject, f.season, g.date AS day, f.game_key AS seq, ROUND(f.r[s.hi], 3) AS rating
  FROM fold f JOIN steps s ON s.season = f.season AND s.step = f.step JOIN games g ON g.game_key = f.game_key WHERE f.step > 0)"""


def _team_moves(v) -> DataFrame:
    return v.kept("team_moves", lambda: ratings.replay_team_elo(v.games, v.clubs, kind="reset").moves)


def _points(v) -> DataFrame:
    club = v.clubs.select(F.col("event_team_id").alias("home_id"), F.col("club").alias("subject"))
    rows = v.games.join(club, "home_id").join(_team_moves(v).select("event_id", "game_key", "home_after"), ["event_id", "game_key"])
    return rows.select("subject", "season", F.col("date").alias("day"), F.col("game_key").alias("seq"), F.round("home_after", 3).alias("rating"))


@query("w11_season_snapshot", _POINTS + " SELECT subject, season, arg_max(rating, {'d': day, 's': seq}) AS rating, COUNT(*) AS n_points FROM points GROUP BY subject, season")
def _(v):
    return rankings.season_snapshot(_points(v))


@query("w12_point_deltas", _POINTS + " SELECT subject, day, seq, rating, rating - LAG(rating) OVER (PARTITION BY subject ORDER BY day, seq) AS delta FROM points")
def _(v):
    return rankings.point_deltas(_points(v))


_FIX = f""", fix AS (SELECT event_id, game_key, stage, date, home_id, away_id, home_score, away_score, status = 'Final' AND home_score + away_score > 0 AS done,
    ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY date NULLS LAST, CASE WHEN time IS NULL THEN 10000 ELSE date_part('hour', strptime(time, '%I:%M %p')) * 60 + 15 END, slot, game_key) AS ord FROM v_game),
  c_games AS (SELECT event_id, ord, {_RANK} AS rank, home_id, away_id, CASE WHEN home_score > away_score THEN home_id WHEN away_score > home_score THEN away_id END AS win FROM fix WHERE {_KIND} = 'champ' AND done),
  c_slots AS (SELECT event_id, ord, team, ROW_NUMBER() OVER (PARTITION BY event_id, team ORDER BY ord, side) AS nth
    FROM (SELECT event_id, ord, home_id AS team, 0 AS side FROM c_games WHERE rank = 0 AND win IS NOT NULL UNION ALL SELECT event_id, ord, away_id, 1 FROM c_games WHERE rank = 0 AND win IS NOT NULL)),
  c_semis AS (SELECT event_id, win AS team, COUNT(*) AS n FROM c_games WHERE rank = 1 AND win IS NOT NULL GROUP BY ALL),
  c_sizes AS (SELECT event_id, ord, SUM((COALESCE(n, 0) >= nth)::INT) AS more FROM c_slots LEFT JOIN c_semis USING (event_id, team) GROUP BY ALL),
  champs AS (SELECT event_id, win AS champion FROM c_games JOIN c_sizes USING (event_id, ord) WHERE rank = 0 AND win IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY more DESC, ord) = 1)"""
# a final's tree has the semi-finals that its teams won, each used once; the demo has no champion's quarter-finals that would go further


# times of several spellings and slots of several digits
_TIME = "CASE game_key % 6 WHEN 0 THEN time WHEN 1 THEN replace(time, ' AM', 'am') WHEN 2 THEN '8:15p' WHEN 3 THEN '13:0' || (game_key % 10) WHEN 4 THEN '9:00 AM ET' ELSE 'noon' END"
_MINUTES = f"""CASE WHEN regexp_matches({_TIME}, '^\\s*\\d{{1,2}}:\\d{{2}}') THEN (regexp_extract({_TIME}, '^\\s*(\\d{{1,2}}):', 1)::INT % 12 + CASE WHEN regexp_matches({_TIME}, '^\\s*\\d{{1,2}}:\\d{{2}}\\s*[Pp]') THEN 12 ELSE 0 END) * 60
    + regexp_extract({_TIME}, ':(\\d{{2}})', 1)::INT ELSE 10000 END"""
_SLOT = "CASE game_key % 3 WHEN 0 THEN 'F' || (game_key % 12) WHEN 1 THEN 'A1-B' || (game_key % 12) END"


def _spelled(v) -> DataFrame:
    k, one = F.col("game_key"), F.lit(":0")
    time = F.when(k % 6 == 0, F.col("time")).when(k % 6 == 1, F.replace("time", F.lit(" AM"), F.lit("am"))).when(k % 6 == 2, "8:15p").when(k % 6 == 3, F.concat(F.lit("13"), one, (k % 10).cast("string"))).when(k % 6 == 4, "9:00 AM ET").otherwise("noon")
    slot = F.when(k % 3 == 0, F.concat(F.lit("F"), (k % 12).cast("string"))).when(k % 3 == 1, F.concat(F.lit("A1-B"), (k % 12).cast("string")))
    return v.game.withColumns({"time": time, "slot": slot})


@query("f_minutes_and_slots", f"SELECT game_key, {_MINUTES}::INT AS minutes, COALESCE(TRY_CAST(regexp_replace({_SLOT}, '\\D', '', 'g') AS BIGINT), 1000000000) AS slot FROM v_game")
def _(v):
    return _spelled(v).select("game_key", measures.minutes_of_day(F.col("time")).alias("minutes"), measures.slot_number(F.col("slot")).alias("slot"))


@query("t1_fixtures", f"""SELECT event_id, game_key, stage, date, home_id, away_id, home_score, away_score, status = 'Final' AND home_score + away_score > 0 AS done,
  ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY date NULLS LAST, {_MINUTES}, COALESCE(TRY_CAST(regexp_replace({_SLOT}, '\\D', '', 'g') AS BIGINT), 1000000000), game_key) AS ord FROM v_game""")
def _(v):
    return tournaments.fixtures(_spelled(v))


@query("t6_champions", _FIX + " SELECT * FROM champs")
def _(v):
    return tournaments.champions(tournaments.fixtures(v.game))


# trees of the demo's labels have two rounds at most
_SLOTS = _FIX + f""", k_all AS (SELECT event_id, {_KIND} AS kind, {_RANK} AS rank, game_key, ord, home_id, away_id, CASE WHEN home_score > away_score THEN home_id ELSE away_id END AS win FROM fix WHERE {_KIND} IS NOT NULL AND done AND home_score <> away_score),
  k AS (SELECT *, MIN(rank) OVER (PARTITION BY event_id, kind) AS inmost, ROW_NUMBER() OVER (PARTITION BY event_id, kind, rank, win ORDER BY ord) AS nth FROM k_all),
  roots AS (SELECT event_id, kind, inmost, game_key, ord, home_id, away_id, ROW_NUMBER() OVER (PARTITION BY event_id, kind ORDER BY ord) AS n FROM k WHERE rank = inmost),
  top AS (SELECT event_id, kind, inmost, CASE WHEN inmost = 0 THEN n ELSE 1 END::BIGINT AS tree, 0::BIGINT AS depth, CASE WHEN inmost = 0 THEN 0 ELSE n - 1 END::BIGINT AS slot, game_key, ord, home_id, away_id FROM roots),
  asks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, kind, team ORDER BY tree, slot) AS nth
    FROM (SELECT event_id, kind, inmost, tree, 2 * slot AS slot, home_id AS team FROM top UNION ALL SELECT event_id, kind, inmost, tree, 2 * slot + 1, away_id FROM top)),
  fed AS (SELECT a.event_id, a.kind, a.tree, 1::BIGINT AS depth, a.slot, k.game_key, k.ord FROM asks a LEFT JOIN k ON k.event_id = a.event_id AND k.kind = a.kind AND k.rank = a.inmost + 1 AND k.win = a.team AND k.nth = a.nth),
  slots AS (SELECT event_id, kind, tree, depth, slot, game_key, ord FROM top UNION ALL (SELECT * FROM fed QUALIFY COUNT(game_key) OVER (PARTITION BY event_id, kind, tree) > 0))"""


@query("t3_bracket_slots", _SLOTS + " SELECT * FROM slots")
def _(v):
    return tournaments.bracket_slots(tournaments.fixtures(v.game))


@query("t3_bracket_order", _SLOTS + """, t AS (SELECT event_id, kind, tree, COUNT(game_key) AS n_games, MIN(MIN(ord)) OVER (PARTITION BY event_id, kind) AS first FROM slots GROUP BY event_id, kind, tree)
  SELECT event_id, kind, tree, n_games, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY CASE kind WHEN 'champ' THEN 0 WHEN '3rd' THEN 1 WHEN '9th' THEN 1 WHEN '13th' THEN 1 ELSE 2 END,
    CASE kind WHEN '3rd' THEN 3 WHEN '9th' THEN 9 WHEN '13th' THEN 13 ELSE 0 END, n_games DESC, first, tree) AS position FROM t""")
def _(v):
    return tournaments.bracket_order(tournaments.bracket_slots(tournaments.fixtures(v.game)))


@query("t7_bracket_trees", """, chain AS (SELECT o_orderkey AS game, CASE WHEN o_orderkey % 64 > 1 THEN o_orderkey - o_orderkey % 64 + (o_orderkey % 64) // 2 END AS next FROM v_order),
  walk(game, root, hops) AS (SELECT game, game, 0::BIGINT FROM chain WHERE next IS NULL UNION ALL SELECT c.game, w.root, w.hops + 1 FROM chain c JOIN walk w ON c.next = w.game)
  SELECT game, root, hops FROM walk""")
def _(v):
    k = F.col("o_orderkey")
    return tournaments.bracket_trees(v.order.select(k.alias("game"), F.when(k % 64 > 1, k - k % 64 + F.floor((k % 64) / 2)).alias("next")))


# series of the demo's names: year, division words and what follows a dash are out, edition numbers at the end too
_SERIES = """CASE WHEN name LIKE 'National%' THEN 'national championship' WHEN name LIKE 'U.S.%' THEN 'u s open' WHEN name LIKE 'Metro%' THEN 'metro regionals' WHEN name LIKE 'Lake%' THEN 'lake sectionals'
  WHEN name LIKE 'Pacific%' THEN 'pacific conference open' WHEN name LIKE 'Men%' THEN lower(name) ELSE 'cup' END"""


@query("t8_series", f""", s AS (SELECT event_id, name, {_SERIES} AS series FROM v_event),
  b AS (SELECT s.event_id, s.series, season, trim(regexp_replace(s.name, '\\s*\\b(19|20)\\d{{2}}\\b\\s*', ' ', 'g'), ' -–') AS bare FROM s JOIN v_event USING (event_id)),
  c AS (SELECT series, bare, COUNT(*) n, MIN({{'s': season, 'e': event_id}}) f FROM b GROUP BY ALL), l AS (SELECT series, bare AS label FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY n DESC, length(bare), f) = 1)
  SELECT event_id, series, label, COUNT(*) OVER (PARTITION BY series) AS n_events FROM s JOIN l USING (series)""")
def _(v):
    return tournaments.series(v.event)


_TIER = "CASE WHEN name LIKE 'National%' OR name LIKE 'U.S. Open%' THEN 4 WHEN name LIKE '%Regionals%' THEN 3 WHEN name LIKE '%Sectionals%' THEN 2 WHEN name LIKE '%Conference%' THEN 1 ELSE 0 END::INT"
_STATE = "CASE event_id % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'OH' WHEN 2 THEN 'TX' ELSE 'VA' END"
_FACTS = _FIX + f""", has AS (SELECT event_id, bool_or(done) AS played FROM fix WHERE event_id % 8 <> 0 GROUP BY event_id),
  facts AS (SELECT event_id, name, season, division, start_date, COALESCE(n, 0) AS n_teams, {_TIER} AS tier, 'Town, ' || {_STATE} AS place, champion
  FROM v_event LEFT JOIN (SELECT event_id, COUNT(*) n FROM v_team GROUP BY 1) USING (event_id) LEFT JOIN champs USING (event_id) LEFT JOIN has USING (event_id)
  WHERE played OR (played IS NULL AND start_date >= DATE '{AS_OF}'))"""


def _facts(v) -> DataFrame:
    n = F.col("event_id") % 4
    state = F.when(n == 0, "CA").when(n == 1, "OH").when(n == 2, "TX").otherwise("VA")
    fix = tournaments.fixtures(v.game)
    return tournaments.event_facts(v.event.withColumns({"city": F.lit("Town"), "state": state}), v.team, tournaments.champions(fix), fix.where("event_id % 8 <> 0"), AS_OF)


@query("t9_event_facts", _FACTS + " SELECT * FROM facts")
def _(v):
    return _facts(v)


@query("w13_event_list", _FACTS + " SELECT * FROM facts WHERE division LIKE 'college' AND season = 1998 AND tier = 0 AND place LIKE '%CA' AND lower(name) LIKE '%cup%' ORDER BY n_teams DESC, event_id LIMIT 400")
def _(v):
    return rankings.event_list(_facts(v), division="college", season=1998, tier=0, state="CA", text="cup", order="size")


@query("f_regions", f""" SELECT event_id, {_STATE} AS state, CASE WHEN division LIKE 'college%' THEN CASE {_STATE} WHEN 'CA' THEN 'Southwest' WHEN 'OH' THEN 'Ohio Valley' WHEN 'TX' THEN 'South Central' ELSE 'Atlantic Coast' END
  ELSE CASE {_STATE} WHEN 'CA' THEN 'Southwest' WHEN 'OH' THEN 'Great Lakes' WHEN 'TX' THEN 'South Central' ELSE 'Mid-Atlantic' END END AS region FROM v_event""")
def _(v):
    n = F.col("event_id") % 4
    place = F.concat(F.lit("Town, "), F.when(n == 0, "CA").when(n == 1, "OH").when(n == 2, "TX").otherwise("VA"))
    return v.event.select("event_id", names.state_of(place).alias("state"), names.region_of(F.col("division"), place).alias("region"))


_STAND = _FIX + """, si AS (SELECT event_id, stage, home_id AS team, away_id AS rival, home_score AS own, away_score AS other FROM fix WHERE done AND stage LIKE 'Pool%' UNION ALL SELECT event_id, stage, away_id, home_id, away_score, home_score FROM fix WHERE done AND stage LIKE 'Pool%'),
  ta AS (SELECT event_id, stage, team, SUM((own > other)::INT)::BIGINT AS wins, SUM(own - other)::BIGINT AS diff, SUM(own)::BIGINT AS points FROM si GROUP BY ALL),
  he AS (SELECT s.event_id, s.stage, s.team, SUM((own > other)::INT)::BIGINT AS head FROM si s JOIN ta a ON a.event_id = s.event_id AND a.stage = s.stage AND a.team = s.team JOIN ta b ON b.event_id = s.event_id AND b.stage = s.stage AND b.team = s.rival WHERE a.wins = b.wins GROUP BY ALL),
  stand AS (SELECT event_id, stage, team, wins, diff, points, COALESCE(head, 0) AS head, ROW_NUMBER() OVER (PARTITION BY event_id, stage ORDER BY wins DESC, COALESCE(head, 0) DESC, diff DESC, points DESC, team) AS place FROM ta LEFT JOIN he USING (event_id, stage, team))"""


@query("t11_standings", _STAND + " SELECT * FROM stand")
def _(v):
    return tournaments.standings(tournaments.fixtures(v.game))


# pools of the demo: numbered by their letters, the last one played later
_POOLED = _STAND + """, numbered AS (SELECT event_id, stage, DENSE_RANK() OVER (PARTITION BY event_id ORDER BY stage) AS pool, stage = 'Pool D' AS later FROM (SELECT DISTINCT event_id, stage FROM v_game WHERE stage LIKE 'Pool%')),
  pooled AS (SELECT event_id, pool, team, wins, diff, points, head, place, later FROM stand JOIN numbered USING (event_id, stage))"""


def _pooled(v) -> DataFrame:
    fix = tournaments.fixtures(v.game)
    labelled = v.game.where(F.col("stage").startswith("Pool"))
    numbers = labelled.select("event_id", "stage").distinct().withColumn("pool", F.dense_rank().over(W.partitionBy("event_id").orderBy("stage")).cast("long"))
    pools = labelled.join(numbers, ["event_id", "stage"]).select("event_id", "pool", "game_key", (F.col("stage") == "Pool D").alias("later"))
    return tournaments.pool_standings(fix, pools)


@query("t11_pool_standings", _POOLED + " SELECT * FROM pooled")
def _(v):
    return _pooled(v)


@query("t12_seeds", _POOLED + " SELECT event_id, team, pool, place, chr((64 + pool)::INT) || place AS seed FROM pooled WHERE NOT later QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id, team ORDER BY pool) = 1")
def _(v):
    return tournaments.seeds(_pooled(v))


@query("t12_recovered_seeds")
def _(v):
    """Seeds from the pools that who met whom tells."""
    fix = tournaments.fixtures(v.game)
    return tournaments.seeds(tournaments.pool_standings(fix, written(tournaments.recover_pools(fix), "pools")))


@query("t13_club_records", _FIX + _CLUB + """, si AS (SELECT event_id, home_id AS team, away_id AS rival, home_score AS own, away_score AS other FROM fix WHERE done UNION ALL SELECT event_id, away_id, home_id, away_score, home_score FROM fix WHERE done)
  SELECT event_id, a.club, SUM((own > other)::INT)::BIGINT AS wins, SUM((own < other)::INT)::BIGINT AS losses FROM si JOIN clubs a ON a.event_team_id = team JOIN clubs b ON b.event_team_id = rival WHERE a.club <> b.club GROUP BY ALL""")
def _(v):
    return tournaments.club_records(tournaments.fixtures(v.game), v.clubs)


@query("t2_recover_pools")
def _(v):
    return tournaments.recover_pools(tournaments.fixtures(v.game))


_FIELD = _POINTS + """, q AS (SELECT DISTINCT c.club, start_date AS day, e.event_id FROM v_team t JOIN clubs c USING (event_team_id) JOIN v_event e ON e.event_id = t.event_id),
  p AS (SELECT subject AS club, day, MAX(rating) AS rating FROM points GROUP BY ALL),
  known AS (SELECT q.club, q.day, q.event_id, p.rating FROM q ASOF LEFT JOIN p ON q.club = p.club AND p.day < q.day),
  raw AS (SELECT event_id, division, name, AVG(rating) AS mean, COUNT(*) AS n FROM known JOIN v_event USING (event_id) WHERE rating IS NOT NULL GROUP BY ALL),
  scores AS (SELECT event_id, division, name, n, round_even((n * mean + 6 * MEDIAN(mean) OVER (PARTITION BY division)) / (n + 6), 1) AS score FROM raw),
  limits AS (SELECT division, s, round_even(c + 2 * (s - c) / 3, 1) AS a, round_even(c + (s - c) / 3, 1) AS b, round_even(c, 1) AS c FROM
    (SELECT division, COALESCE(MIN(CASE WHEN lower(name) LIKE '%national championship%' THEN score END), MAX(score)) AS s, MEDIAN(score) AS c FROM scores GROUP BY division))"""


def _known(v) -> DataFrame:
    p = _points(v).select(F.col("subject").alias("club"), "day", "rating")
    asked = v.team.select("event_team_id", "event_id").join(v.clubs, "event_team_id").join(v.event.select("event_id", F.col("start_date").alias("day")), "event_id").select("club", "day", "event_id").distinct()
    return trends.last_before(p, asked)


@query("fs1_last_before", _FIELD + " SELECT * FROM known")
def _(v):
    return _known(v)


@query("fs2_field_strength", _FIELD + " SELECT * FROM scores")
def _(v):
    return trends.field_strength(_known(v), v.event)


@query("fs3_cutoffs", _FIELD + " SELECT * FROM limits")
def _(v):
    return trends.cutoffs(trends.field_strength(_known(v), v.event))


@query("fs4_letters", _FIELD + " SELECT event_id, division, score, CASE WHEN score >= s THEN 'S' WHEN score >= a THEN 'A' WHEN score >= b THEN 'B' WHEN score >= c THEN 'C' ELSE 'D' END AS letter FROM scores JOIN limits USING (division)")
def _(v):
    scores = trends.field_strength(_known(v), v.event)
    return trends.graded(scores, trends.cutoffs(scores))


_SEASONS = _POINTS + ", sn AS (SELECT 'club' AS kind, subject, season, arg_max(rating, {'d': day, 's': seq}) AS rating FROM points GROUP BY subject, season)"


def _seasons(v) -> DataFrame:
    return rankings.season_snapshot(_points(v)).select(F.lit("club").alias("kind"), "subject", "season", "rating")


@query("h4_trends", _SEASONS + """, r AS (SELECT *, RANK() OVER (PARTITION BY kind, season ORDER BY rating DESC) AS k FROM sn)
  SELECT kind, subject, MAX(rating) AS peak, arg_max(season, {'r': rating, 's': -season}) AS peak_season, COUNT(*) AS n_seasons FROM sn WHERE subject IN (SELECT subject FROM r WHERE k <= 25) GROUP BY kind, subject""")
def _(v):
    return trends.trends(_seasons(v))


@query("h4_medians", _SEASONS + " SELECT kind, season, MEDIAN(rating) AS median, COUNT(*) AS n FROM sn GROUP BY kind, season")
def _(v):
    return trends.medians(_seasons(v))


@query("h7_event_club_index", _FIX + _CLUB + " SELECT DISTINCT event_id, club FROM (SELECT event_id, home_id AS event_team_id FROM fix UNION SELECT event_id, away_id FROM fix) JOIN clubs USING (event_team_id)")
def _(v):
    return trends.event_club_index(tournaments.fixtures(v.game), v.clubs)


@query("h9_club_names", _CLUB + " SELECT club, arg_max(display_name, {'d': start_date, 't': event_team_id}) AS display_name FROM v_team t JOIN clubs USING (event_team_id) JOIN v_event e ON e.event_id = t.event_id GROUP BY club")
def _(v):
    rows = v.team.select("event_team_id", "event_id", "display_name").join(v.clubs, "event_team_id").join(v.event.select("event_id", "start_date"), "event_id")
    return trends.club_names(rows)


@query("h10_club_stints", _NAMED + """, x AS (SELECT *, CASE WHEN LAG(club) OVER w = club THEN 0 ELSE 1 END AS new FROM named WINDOW w AS (PARTITION BY player_id ORDER BY start_date, event_team_id)),
  y AS (SELECT *, SUM(new) OVER (PARTITION BY player_id ORDER BY start_date, event_team_id)::BIGINT AS stint FROM x)
  SELECT player_id, stint, MIN(club) AS club, MIN(start_date) AS since, MAX(start_date) AS until, COUNT(*) AS n_events FROM y GROUP BY player_id, stint""")
def _(v):
    return trends.club_stints(v.named.select("player_id", "start_date", "event_team_id", "club"))


@query("w14_season_roster", _CLUB + " SELECT division, club, season, player_id, COUNT(DISTINCT event_id) AS n_events FROM v_roster JOIN clubs USING (event_team_id) GROUP BY ALL")
def _(v):
    return rankings.season_roster(v.roster, v.clubs)


@query("a3_validate_events", """ SELECT event_id, COUNT(*) AS n_games, SUM((status = 'Final')::INT)::BIGINT AS n_final, SUM((home_score = away_score)::INT)::BIGINT AS n_draws, SUM((time IS NULL)::INT)::BIGINT AS n_no_time,
  COUNT(DISTINCT (home_id, away_id)) AS n_pairings FROM v_game GROUP BY event_id""")
def _(v):
    return api.validate_events(v.game)


@query("a5_roster_state", """, r AS (SELECT DISTINCT event_team_id FROM v_roster WHERE player_id % 3 <> 0 OR event_id % 2 = 0), n AS (SELECT event_id, COUNT(*) AS n_teams, COUNT(r.event_team_id) AS n_rosters FROM v_team t LEFT JOIN r USING (event_team_id) GROUP BY event_id)
  SELECT event_id, n_teams, n_rosters, CASE WHEN n_rosters = n_teams THEN 'public' WHEN n_rosters > 0 THEN 'partial' ELSE 'unavailable' END AS state FROM n""")
def _(v):
    return api.roster_state(v.team, v.roster.where("player_id % 3 <> 0 or event_id % 2 = 0"))


_CODES = ", coded AS (SELECT *, 'code' || event_id % 90 AS event_code FROM v_event), refs AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN event_id % 2 = 0 THEN 'event' ELSE 'division' END AS entity_type, url AS source_id, event_id::VARCHAR AS local_key, url AS source_url, sha1(url) AS payload_hash FROM v_event)"


def _coded(v) -> DataFrame:
    return v.event.withColumn("event_code", F.concat(F.lit("code"), (F.col("event_id") % 90).cast("string")))


def _refs(v) -> DataFrame:
    k = F.col("event_id")
    return v.event.select(F.when(k % 3 == 0, "a").otherwise("b").alias("source"), F.when(k % 2 == 0, "event").otherwise("division").alias("entity_type"), F.col("url").alias("source_id"), k.cast("string").alias("local_key"), F.col("url").alias("source_url"), F.sha1("url").alias("payload_hash"))


@query("q1_events_page", _CODES + """ SELECT * FROM coded WHERE season = 1998 AND event_id IN (SELECT event_id FROM v_team WHERE lower(display_name) LIKE '%team 1%') AND event_id IN (SELECT event_id FROM v_game WHERE status = 'Final')
  AND event_id::VARCHAR IN (SELECT local_key FROM refs WHERE source = 'b') ORDER BY start_date DESC, event_id LIMIT 50 OFFSET 10""")
def _(v):
    return api.events_page(_coded(v), v.game, v.team, _refs(v), offset=10, season=1998, team="team 1", played=True, source="b").nodes


@query("q1_events_total", _CODES + """ SELECT COUNT(*) AS total_count, COUNT(*) > 10 + 3 AS has_next_page FROM coded WHERE event_code = 'code21' AND event_id IN (SELECT event_id FROM v_game WHERE status <> 'Final')""")
def _(v):
    return api.events_page(_coded(v), v.game, v.team, first=3, offset=10, event_code="code21", played=False).total


@query("q2_games_page", _CODES + """ SELECT g.event_id, game_key, date, time, h.display_name AS home_name, a.display_name AS away_name, home_score, away_score FROM v_game g LEFT JOIN v_team h ON h.event_team_id = home_id LEFT JOIN v_team a ON a.event_team_id = away_id
  WHERE status = 'Final' AND g.event_id IN (SELECT event_id FROM coded WHERE division = 'college') ORDER BY date NULLS LAST, time NULLS LAST, game_key LIMIT 100 OFFSET 20""")
def _(v):
    return api.games_page(v.game, v.team, _coded(v), first=100, offset=20, division="college", played=True).nodes


@query("q2_games_total", " SELECT COUNT(*) AS total_count, COUNT(*) > 100 AS has_next_page FROM v_game WHERE event_id IN (SELECT event_id FROM v_event WHERE season = 1997)")
def _(v):
    return api.games_page(v.game, v.team, v.event, first=100, season=1997).total


@query("q5_games_by_event", " SELECT event_id, game_key, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY date NULLS LAST, time NULLS LAST, game_key) AS r FROM v_game QUALIFY r BETWEEN 2 AND 4")
def _(v):
    return api.games_by_event(v.game, offset=1)


# season lines of a professional league from the order lines: player = supplier, team = nation of the order's customer
_PRO = """, pro AS (SELECT l_suppkey AS pro_id, o_custkey % 12 AS team_id, CAST(year(odate) AS INT) AS year, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS points_played, SUM(CAST(l_quantity AS BIGINT) % 7 - 3)::BIGINT AS quality
    FROM lineitem JOIN v_order ON l_orderkey = o_orderkey GROUP BY ALL), links AS (SELECT s_suppkey AS pro_id, s_suppkey + 1000 AS player_id FROM supplier WHERE s_suppkey % 3 <> 0)"""


def _pro(v) -> tuple[DataFrame, DataFrame]:
    read = lambda t: v.spark.read.parquet(f"{v.sf_dir}/{t}.parquet")
    rows = read("lineitem").join(v.order, F.col("l_orderkey") == F.col("o_orderkey"))
    q = F.col("l_quantity").cast("long")
    pro = rows.groupBy(F.col("l_suppkey").alias("pro_id"), (F.col("o_custkey") % 12).alias("team_id"), F.year("odate").alias("year")).agg(F.sum(q).alias("points_played"), F.sum(q % 7 - 3).alias("quality"))
    links = read("supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("pro_id"), (F.col("s_suppkey") + 1000).alias("player_id"))
    return pro, links


@query("s4_season_stats", _PRO + """, w AS (SELECT *, SUM(points_played) OVER x AS total, COUNT(*) OVER x AS n FROM pro WINDOW x AS (PARTITION BY team_id, year)),
  y AS (SELECT *, COUNT(*) OVER (PARTITION BY team_id, year) AS linked FROM w JOIN links USING (pro_id) WHERE total > 0 AND n >= 2)
  SELECT team_id, make_date(year, 9, 1) AS end_date, player_id, ROUND(points_played * n / total::DOUBLE, 6) AS usage, ROUND(quality / 3.0, 6)::DOUBLE AS quality FROM y WHERE linked >= 2""")
def _(v):
    return corpus.load_season_stat_events(*_pro(v)).withColumns({"usage": F.round("usage", 6), "quality": F.round("quality", 6)})


_EXACT = "trim(regexp_replace(lower(nfc_normalize(name)), '\\s+', ' ', 'g'))"


@query("i17_name_overlap", _NAMED + _KEYED + f""", u AS (SELECT 'exact' AS key, {_EXACT} AS name, division, season, identity, ambiguous FROM keyed UNION ALL SELECT 'folded', norm, division, season, identity, ambiguous FROM keyed),
  a AS (SELECT DISTINCT key, name, season FROM u WHERE division = 'college'), b AS (SELECT key, name, COUNT(DISTINCT identity) = 1 AND NOT bool_or(ambiguous) AS one FROM u WHERE division <> 'college' GROUP BY ALL),
  s AS (SELECT DISTINCT key, name FROM a JOIN (SELECT DISTINCT key, name, season FROM u WHERE division <> 'college') USING (key, name, season))
  SELECT key, COUNT(*) AS shared, COALESCE(SUM(one::INT), 0)::BIGINT AS unique, COALESCE(SUM((one AND (key, name) IN (SELECT (key, name) FROM s))::INT), 0)::BIGINT AS same_season FROM (SELECT DISTINCT key, name FROM a) JOIN b USING (key, name) GROUP BY key""")
def _(v):
    rows = _keyed(v).select("name", "division", "season", "identity", "ambiguous", F.col("norm").alias("folded")).distinct()
    keyed = identity.with_keys(written(rows, "keyed"), "name", exact=names.exact_name_key)
    return identity.name_overlap(keyed.where("division = 'college'"), keyed.where("division <> 'college'"))


_DETAIL = """, d AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, season, 'all' AS division, lower(replace(name, ' ', '')) AS key FROM v_event)"""


@query("i20_mapping_candidates", _DETAIL + " SELECT season, division, key, d.id, e.id AS other_id FROM d JOIN d e USING (season, division, key) WHERE d.source <> e.source AND d.id < e.id")
def _(v):
    n = F.col("event_id") % 3
    source = F.when(n == 0, "a").when(n == 1, "b").otherwise("c")
    return identity.mapping_candidates(v.event.select(F.col("event_id").alias("id"), source.alias("source"), "season", F.lit("all").alias("division"), F.lower(F.replace("name", F.lit(" "), F.lit(""))).alias("key")))


@query("t4_published_brackets", f""", b AS (SELECT event_id, CASE WHEN game_key % 3 = 0 THEN NULL ELSE game_key % 3 END AS bracket, (game_key % 4)::INT AS round, CASE WHEN event_id % 2 = 0 THEN (1 + game_key % 2)::INT END AS place, stage FROM v_game),
  r AS (SELECT event_id, bracket, SUM((round = 0)::INT) AS roots, MIN(CASE WHEN round = 0 THEN stage END) AS stage, MIN(place) AS place, COUNT(*) AS n_games FROM b WHERE bracket IS NOT NULL GROUP BY ALL)
  SELECT event_id, bracket, CASE WHEN place = 1 THEN 'champ' WHEN place = 2 THEN '2nd' ELSE COALESCE({_KIND}, 'champ') END AS kind, n_games FROM r WHERE roots = 1""")
def _(v):
    return tournaments.published_brackets(_published(v))


def _published(v) -> DataFrame:
    k = F.col("game_key")
    return v.game.select("event_id", F.when(k % 3 != 0, k % 3).alias("bracket"), (k % 4).cast("int").alias("round"), F.when(F.col("event_id") % 2 == 0, (1 + k % 2).cast("int")).alias("place"), "stage", "game_key")


@query("r9_decay_grid")
def _(v):
    return ratings.decay_grid(*_corpus(v, False)[:3], [0.0, 0.2], [0.0, 0.3], [90])


@query("r10_period_comparison")
def _(v):
    return ratings.period_comparison(*_corpus(v, False)[:3])


@query("t3_label_brackets")
def _(v):
    return tournaments.label_brackets(tournaments.fixtures(v.game))


@query("t5_decompose")
def _(v):
    return tournaments.decompose(tournaments.fixtures(v.game))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best players by player Elo with 90 % bounds."""
    state = _replay(Views(spark, sf_dir)).state
    return rankings.rank_players(state.select("player", "rating", "games"), min_games=3).orderBy("rank").limit(25)


@query("s25_page_links", " SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))) AS n_links FROM pages")
def _(v):
    pages = v.spark.read.parquet(f"{v.sf_dir}/pages.parquet")
    links = tables.extract_page_rows(pages).where("kind = 'link'").groupBy("page_id").agg(F.countDistinct("target").alias("n"))
    return pages.select("page_id").join(links, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_links"))


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Builds the demo's views and the tables that several queries share, which are kept from then on."""
    v = Views(spark, sf_dir)
    for name in VIEWS:
        view(spark, sf_dir, name)
    for table in (v.clubs, v.spelled, _team_moves(v)):
        table.limit(1).count()
