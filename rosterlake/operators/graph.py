"""Tables cut from their lineage, and connected components by joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in that of ``spark.checkpoint.dir``.

    Where that is unset, the warehouse folder serves on a cluster and a temporary
    folder with a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = tempfile.mkdtemp(prefix="rosterlake-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rosterlake-checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a fresh folder."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for edges (a, b): every node with the smallest node it is joined to.

    Each round takes the smallest label among a node and its neighbours and
    then the label's own label, so paths shorten by halves.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("l")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        new = labels.join(near, "a").select("a", F.least("l", "m").alias("n"), "l")
        jump = new.select(F.col("a").alias("n"), F.col("n").alias("nn"))
        new = written(new.join(jump, "n").select("a", F.least("n", "nn").alias("l"), (F.least("n", "nn") != F.col("l")).alias("moved")), "labels")
        if not new.where("moved").limit(1).count():
            return new.select(F.col("a").alias("node"), F.col("l").alias("component"))
        labels = new.drop("moved")
    raise RuntimeError("components did not settle")
