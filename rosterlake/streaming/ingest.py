"""Structured Streaming: versioned deliveries of events, stat lines held back, team Elo in event-time order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rosterlake.operators.ratings import EloConfig, Pool

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_ingest(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps the deliveries of a stream of games (ST1); ``current_events`` reads the table from them.

    A batch is one folder of a log at ``path`` and is written whole again if it
    runs again. A row's ``version`` orders the deliveries of its event; without
    such a column the batch's number does.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch if "version" in batch.columns else batch.withColumn("version", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_events(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of each event's highest version over the logs (and compacted tables) at ``paths`` (ST1).

    An older delivery that comes late changes nothing, and its placeholders stay
    away. Rows of one version may be spread over batches; where a game stands in
    several, the one of the highest batch counts, so that deliveries may come in
    any order and more than once. A null version is older than all others.
    """
    parts = [spark.read.option("basePath", p).parquet(p) for p in paths]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    if "batch" not in rows.columns:
        rows = rows.withColumn("batch", F.lit(-1))
    rows = rows.withColumn("_v", F.coalesce(F.col("version").cast("long"), F.lit(-(2**63))))
    last = rows.groupBy("event_id").agg(F.max("_v").alias("_v"))
    own = W.partitionBy("event_id", "game_key").orderBy(F.desc("batch"))
    kept = rows.join(last, ["event_id", "_v"]).withColumn("_n", F.row_number().over(own)).where("_n = 1")
    return kept.drop("_v", "_n", "batch")


def compact_events(spark: SparkSession, out: str, *paths: str, parts: int = 64) -> None:
    """Writes ``current_events`` as ``parts`` files dealt by event, which may stand for the logs from then on."""
    current_events(spark, *paths).repartition(parts, "event_id").sortWithinPartitions("event_id", "game_key").write.mode("overwrite").parquet(out)


def deferred_stats(stats: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stat lines of a team at an event once the stream has passed the event's last day (ST2), in append mode.

    stats: (event_team_id, ended timestamp, player_id, usage, quality). Lines
    that come more than ``late`` after the stream has passed their day are
    dropped by the watermark. ``acts_from`` is the first day on which they count.
    """
    lines = F.sort_array(F.collect_list(F.struct("player_id", "usage", "quality"))).alias("lines")
    days = stats.withWatermark("ended", late).groupBy(F.window("ended", "1 day").alias("day"), "event_team_id").agg(lines)
    return days.select("event_team_id", F.col("day.end").cast("date").alias("acts_from"), "lines")


RATED = "season int, division string, game_key long, expected double"
PENDING = "at long, game_key long, home string, away string, home_score int, away_score int"


class _TeamElo(StatefulProcessor):
    """The clubs of one season and division: their ratings, and the games that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.teams = handle.getMapState("teams", "team string", "rating double, games double")
        self.passed = handle.getValueState("passed", "at long")
        self.cfg = EloConfig(involvement_credit=False, stat_transfer_beta=0.0, roster_shrink=0.0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = (pdf["played"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            columns = (pdf[c].tolist() for c in ("game_key", "home_club", "away_club", "home_score", "away_score"))
            self.pending.appendList(list(zip(at, *columns)))
            for t in set(at):
                self.handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first timer of a batch takes all that the watermark has passed; nothing that early can come any more
        if self.passed.exists() and expiredTimerInfo.getExpiryTimeInMs() <= self.passed.get()[0]:
            return
        now, rest, due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), [], []
        self.passed.update((now,))
        for r in self.pending.get():
            (due if r[0] <= now else rest).append(tuple(r))
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        pool, (season, division), out = Pool(self.cfg), key, []
        start = self.cfg.division_bases.get(division, self.cfg.base_rating)
        for club in sorted({c for r in due for c in r[2:4]}):
            if self.teams.containsKey((club,)):
                i = pool.numbers([club], start, 0)
                pool.rating[i], pool.games[i] = self.teams.getValue((club,))
        for _, game_key, home, away, hs, as_ in sorted(due, key=lambda r: r[:2]):
            out.append((season, division, game_key, pool.game([home], [away], hs, as_, division, 0, 0)[0]))
        for r in pool.table().itertuples():
            self.teams.updateValue((r.player,), (float(r.rating), float(r.games)))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RATED.split(", ")])

    def close(self) -> None:
        pass


def streaming_team_elo(games: DataFrame, delay: str = "7 days") -> DataFrame:
    """Chances of the home club of each game, from ratings of its own season and division, in append mode (ST3).

    games: (season, division, game_key, played timestamp, home_club, away_club,
    home_score, away_score). A pool keeps its games until the watermark, the
    latest ``played`` of the stream less ``delay``, has passed them; then a timer
    takes them in order of time and key. So deliveries may be out of order by up
    to ``delay``; games that come later still are dropped by the watermark. State
    is the pool's clubs and the games of the delay. The state store is RocksDB.
    """
    games.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = games.withWatermark("played", delay).select("season", "division", "game_key", "played", "home_club", "away_club", "home_score", "away_score")
    return rows.groupBy("season", "division").transformWithStateInPandas(_TeamElo(), RATED, "append", "EventTime")
