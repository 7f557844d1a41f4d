"""Mixing sources to target weights by Poisson replication.

A source of ``size`` bytes with a share ``w`` of the mixture is repeated at the
mean rate ``total * w / size``. Each document draws how often it is taken by
inverting the Poisson distribution of that mean at a number that a hash of seed
and id gives, is exploded by the count, and all copies are shuffled globally by
a hash of id and copy. The same document gets the same draw in every run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import materialise

SEED = 7
POWER = 0.5
SMALL = 100_000
DIRECT = 700.0  # exp(-rate) of much larger rates underflows


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def chances_around_mode(rate: float) -> tuple[int, list[float]]:
    """A count below which the Poisson chance is negligible, and the cumulative chances from there on.

    Chances are built from the mode outwards in logarithms and scaled to a sum of 1.
    """
    mode, reach = int(rate), int(12 * rate**0.5 + 30)
    least = max(0, mode - reach)
    up = np.cumsum(np.log(rate) - np.log(np.arange(mode + 1, mode + reach + 1)))
    down = np.cumsum(np.log(np.arange(mode, least, -1)) - np.log(rate))
    c = np.cumsum(np.exp(np.concatenate([down[::-1], [0.0], up])))
    return least, (c / c[-1]).tolist()


def _around_mode():
    @F.pandas_udf("least long, cdf array<double>")
    def run(rate: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chances_around_mode(r) if r > DIRECT else (0, []) for r in rate], columns=["least", "cdf"])

    return run


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total_bytes: int | None = None) -> DataFrame:
    """Per source: rows, bytes, its rate and the cumulative Poisson chances ``cdf`` of ``least`` copies and more, up to a negligible rest.

    Rates up to ``DIRECT`` are summed from no copies on, larger ones around the mode.

    Without ``weights`` a source's target share is its size to the power
    ``POWER``. Sources missing from ``weights`` get 0. ``total_bytes``, the
    expected size of the mixture, is that of the input by default. A null source
    is a source; its key is null. A source whose texts hold no bytes at all has
    nothing to give to the mixture: its rate is 0, and its rows are left out.
    """
    size = docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    if weights is None:
        size = size.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(POWER)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        cases = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        size = size.withColumn("weight", F.coalesce(*cases, F.lit(0.0)))
    sums = size.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weights"))
    size = size.crossJoin(F.broadcast(sums))  # one row
    total = F.lit(total_bytes) if total_bytes is not None else F.col("all_bytes")
    rate = F.when((F.col("bytes") > 0) & (F.col("all_weights") > 0), total * (F.col("weight") / F.col("all_weights")) / F.col("bytes")).otherwise(0.0)
    size = size.withColumn("rate", rate.cast("double"))
    some = F.least(F.col("rate"), F.lit(DIRECT))
    last = F.ceil(some + 12 * F.sqrt(some) + 30).cast("int")
    grow = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-F.col("rate")).alias("p"), F.array(F.exp(-F.col("rate"))).alias("c")),
        lambda a, k: F.struct((a["p"] * F.col("rate") / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * F.col("rate") / k)).alias("c")),
        lambda a: a["c"],
    )
    size = size.withColumn("far", _around_mode()("rate"))
    cdf = F.when(F.col("rate") <= DIRECT, grow).otherwise(F.col("far.cdf"))
    return size.select("source", "rows", "bytes", "rate", F.col("far.least").alias("least"), cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total_bytes: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: the input's columns, with ``copy_no`` from 0, ``n_copies`` and ``shuffle_key``, in shuffled order.

    Needs the columns doc_id, text and source. Null texts count as empty, a null
    id as an empty string in the draw; rows of the same id, repeated ones too,
    draw the same count. Input columns named like one of the three added ones are
    replaced; all others may have any name. A rate may have any size. An empty
    table gives an empty result.
    """
    table = materialise(rates(docs, weights, total_bytes), "rates")
    kept = [c for c in docs.columns if c not in ("copy_no", "n_copies", "shuffle_key")]
    row = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"))  # the input's names stay apart from those used here
    doc = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    row = row.withColumn("given", F.col("row.source")).withColumn("u", unit(F.lit(str(seed)), doc))
    by = table.select("source", "least", "cdf", "rows")
    if table.count() <= SMALL:
        drawn = row.join(F.broadcast(by), F.col("given").eqNullSafe(F.col("source")))
    else:  # at most SMALL sources hold one in SMALL of all rows or more; they are broadcast, the rest is shuffled
        often = F.col("rows") * SMALL >= table.agg(F.sum("rows")).first()[0]
        hot = F.broadcast(by.where(often))
        drawn = row.join(hot, F.col("given").eqNullSafe(F.col("source")))
        rest = row.join(hot, F.col("given").eqNullSafe(F.col("source")), "left_anti")
        drawn = drawn.unionByName(rest.join(by.where(~often), F.col("given").eqNullSafe(F.col("source"))))
    drawn = drawn.withColumn("n_copies", (F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).cast("int")).where("n_copies > 0")
    out = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed + 1)), doc, F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long")
    out = out.select(*[F.col("row").getField(c).alias(c) for c in kept], "copy_no", "n_copies", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the mixture of all ``documents`` with square-root weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs)


#: The same mixture in DuckDB.
SQL = f"""
WITH RECURSIVE size AS (
  SELECT source, SUM(strlen(COALESCE(text, '')))::BIGINT AS bytes FROM documents GROUP BY source
), share AS (
  SELECT source, CASE WHEN bytes > 0 THEN (SELECT SUM(bytes) FROM size)::DOUBLE
    * (pow(bytes::DOUBLE, {POWER}) / (SELECT SUM(pow(bytes::DOUBLE, {POWER})) FROM size)) / bytes ELSE 0.0 END AS rate FROM size
), chance(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM share
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM chance WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), cdf AS (
  SELECT source, list(c) AS cs FROM chance GROUP BY source
), drawn AS (
  SELECT d.*, list_count(list_filter(cs, lambda c: c <=
    ('0x' || substr(md5('{SEED}|' || COALESCE(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0))::INTEGER AS n_copies
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
), copies AS (
  SELECT *, UNNEST(range(n_copies))::INTEGER AS copy_no FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copy_no, n_copies,
  ('0x' || substr(md5('{SEED + 1}|' || COALESCE(doc_id::VARCHAR, '') || '|' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""
