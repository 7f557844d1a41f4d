"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parts into which the rows of one key are dealt where a key may be frequent.
SALTS = 1024
#: A key with more rows is frequent, and how many frequent keys are broadcast at most.
OFTEN = 512
HOT_KEYS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, the warehouse folder serves on a cluster, and a
    temporary folder of this process with a local master (tests, a laptop).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="rosterlake-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rosterlake-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no earlier work, and two
    readers of the table do not compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rosterlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: whatever else a table carries cannot clash with an operator's own columns."""
    return df.select(*[df[n].alias(n) for n in names])


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with a table of few rows a key, where one key may have any share of the rows.

    Rows are salted by a hash of all their columns. The distinct pairs of key and
    salt, ``salts`` a key at most, take the table's columns first and bring them
    to the rows, so a task of the large join reads one part in ``salts`` of a
    frequent key. Columns of ``table`` other than the key must not occur in ``rows``.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    pairs = salted.select(*key, "_salt").distinct().join(table, key)
    return salted.join(pairs, [*key, "_salt"]).drop("_salt")


def counted_join(rows: DataFrame, table: DataFrame, key: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with a written table of few rows a key, whose column ``n`` says how many rows a key has.

    The part of the table with keys of more than OFTEN rows is broadcast after
    its rows were counted; if there are more than HOT_KEYS, all rows are salted.
    """
    hot = table.where(F.col(n) > OFTEN)
    count = hot.limit(HOT_KEYS + 1).count()
    if not count:
        return rows.join(table, key)
    if count > HOT_KEYS:
        return spread_join(rows, table, key)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(table.where(F.col(n) <= OFTEN), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")) if large else None
    if large:
        out = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a").select("a", "b", "m")
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two columns ``a`` and ``b`` of one ordered type. The result has
    one row ``(node, component)`` for every node other than the smallest of its
    component; ``component`` is that smallest node. Every round is written to
    the shared folder, and the number of edges never grows.
    """
    now = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if not new[0] or tuple(new) == mark:
            break
        mark = tuple(new)
        now = materialise(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def ranked(df: DataFrame, by: list[str], order: list[Column], buckets: int, out: str) -> DataFrame:
    """Gapless positions from 0 within each group ``by``, without a task that holds a whole group.

    Rows are dealt to ``buckets`` buckets by a hash of all columns, numbered
    inside each (group, bucket) and shifted by the sizes of the buckets before
    it. The table of sizes has groups x buckets rows at most. Equal rows may
    exchange their numbers.
    """
    from pyspark.sql import Window as W

    names = df.columns
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    inner = W.partitionBy(*by, "_b").orderBy(*order)
    numbered = dealt.withColumn("_r", F.row_number().over(inner) - 1)
    return numbered.join(starts, [*by, "_b"]).select(*names, (F.col("_s") + F.col("_r")).cast("long").alias(out))
