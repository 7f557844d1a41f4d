"""Sharding by balanced label propagation, with DataFrame functions only.

Documents of a group (equal texts) are linked, and nothing else links them, so a
group is a clique and labels are propagated group by group. Every linked document
starts in a shard that a hash names. In each round a group counts its documents'
shards and wants to gather in the one with most votes, or in as many as its size
needs; a shard grants wishes from the largest group down as long as their running
sum stays within its quota, and the groups whose wishes are all granted move.
Rounds go on until one settles no group: what is then left fits nowhere as a
whole. Such groups are cut into the room that is left, and documents that nothing
links to others fill every shard up to its exact number of rows.

Tables that a task or the driver holds whole have one row per shard, size class
and hash bucket; groups and documents stay distributed. A text's documents are
dealt over salts wherever a table joins them by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.common import SALTS, materialise, only, ranked, text_or_empty

SHARDS = 40
ROUNDS = 20
BUCKETS = 1024
GRANT_BUCKETS = 64


def _wishes(linked: DataFrame, quota: DataFrame) -> DataFrame:
    """(g, label, q, class, from, upto): how many documents each open group wants in which shard, and their span of the group.

    Shards with room for the whole group come first, by votes; a group that fits
    in none takes the roomiest ones. A shard without room left is not wanted.
    """
    votes = linked.groupBy("g", "label").agg(F.count("*").alias("votes"))
    sizes = votes.groupBy("g").agg(F.sum("votes").alias("m"), F.map_from_entries(F.collect_list(F.struct("label", "votes"))).alias("by"))
    all_ = sizes.crossJoin(F.broadcast(quota.where("room > 0").agg(F.sort_array(F.collect_list(F.struct("label", "room"))).alias("shards"))))  # one row
    liked = F.transform(
        "shards",
        lambda s: F.struct(
            F.greatest(F.col("m") - s["room"], F.lit(0)).alias("lacks"),
            (-F.coalesce(F.element_at("by", s["label"]), F.lit(0))).alias("votes"),
            F.xxhash64("g", s["label"]).alias("h"),
            s["label"].alias("label"),
            s["room"].alias("room"),
        ),
    )
    ordered = all_.select("g", "m", F.array_sort(liked).alias("s"))
    spans = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<label:int,from:bigint,upto:bigint>>").alias("out")),
        lambda a, s: F.when(a["at"] >= F.col("m"), a).otherwise(
            F.struct(
                F.least(F.col("m"), a["at"] + s["room"]).alias("at"),
                F.concat(a["out"], F.array(F.struct(s["label"].alias("label"), a["at"].alias("from"), F.least(F.col("m"), a["at"] + s["room"]).alias("upto")))).alias("out"),
            )
        ),
        lambda a: a["out"],
    )
    one = ordered.select("g", "m", F.explode(spans).alias("w")).select("g", "m", "w.label", "w.from", "w.upto")
    return one.withColumn("q", F.col("upto") - F.col("from")).withColumn("class", F.floor(F.log2(F.col("m").cast("double"))).cast("int"))


def _granted(wishes: DataFrame, quota: DataFrame) -> DataFrame:
    """The wishes that fit a shard's room, taken in order of size class, hash bucket, size and group, up to the first that does not fit.

    Sums are taken per (shard, class, bucket) first; inside the one bucket in
    which a shard's room ends the wishes are summed one by one.
    """
    place = ["label", "class", "bucket"]
    dealt = wishes.withColumn("bucket", F.pmod(F.xxhash64("g", F.lit(5)), F.lit(GRANT_BUCKETS)).cast("int"))
    sums = dealt.groupBy(*place).agg(F.sum("q").alias("asked"))  # shards x size classes x buckets
    before = W.partitionBy("label").orderBy(F.desc("class"), "bucket").rowsBetween(W.unboundedPreceding, -1)
    edges = sums.join(F.broadcast(quota), "label").withColumn("start", F.coalesce(F.sum("asked").over(before), F.lit(0)))
    edges = edges.where("start < room").select(*place, "start", "room")
    own = W.partitionBy(*place).orderBy(F.desc("m"), "g").rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.join(edges, place).withColumn("end", F.col("start") + F.sum("q").over(own))
    return summed.where(F.col("end") <= F.col("room")).drop("bucket", "start", "room", "end")


def propagate(linked: DataFrame, shards: int, quota: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Labels of the linked documents (columns key, g, salt, m, the size of the group): ``key``, ``g``, ``label``.

    ``quota`` has (label, room). Groups of half a shard and more settle first,
    then those of an eighth, of a 64th and the rest, so that small ones do not
    take the room that a large one needs in one piece. A group settles once all
    its wishes are granted; what it takes is gone for the next round. The rounds
    of a phase end at the latest when one settles no group; the groups left
    then stay where they were.
    """
    start = linked.withColumn("label", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(shards)).cast("int"))
    whole = quota.agg(F.max("room")).first()[0] or 0
    phase = F.when(F.col("m") * 2 >= whole, 0).when(F.col("m") * 8 >= whole, 1).when(F.col("m") * 64 >= whole, 2).otherwise(3)
    start = materialise(start.withColumn("phase", phase), "labels")
    room, out = quota, None
    for (p,) in sorted(start.select("phase").distinct().collect()):  # four at most
        labels, room = _settled(start.where(F.col("phase") == p).select("key", "g", "salt", "label"), room, rounds)
        out = labels if out is None else out.unionByName(labels)
    return out if out is not None else start.select("key", "g", "label")


def _settled(now: DataFrame, room: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Labels (key, g, label) after the rounds of one phase, and the room left."""
    done: DataFrame | None = None
    for _ in range(rounds):
        wishes = materialise(_wishes(now, room), "wishes")
        granted = _granted(wishes, room)
        full = granted.groupBy("g").agg(F.sum("q").alias("got"), F.first("m").alias("m")).where("got = m").select("g")
        plan = materialise(granted.join(full, "g").select("g", "m", "label", "from", "upto"), "plan")
        if plan.isEmpty():  # also where no room is left
            break
        one = plan.groupBy("g").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("upto", "label"))).alias("spans"))  # at most a span per shard
        parts = now.select("g", "salt").distinct().join(one, "g")
        told = materialise(now.join(parts, ["g", "salt"], "left"), "told")
        single = told.where("size(spans) = 1").select("key", "g", "salt", F.get("spans", 0)["label"].alias("label"))
        several = ranked(told.where("size(spans) > 1").select("key", "g", "salt"), ["g"], [F.col("key")], BUCKETS, "place")
        several = several.join(parts.where("size(spans) > 1").select("g", "salt", "spans"), ["g", "salt"])
        several = several.select("key", "g", "salt", F.element_at(F.filter("spans", lambda s: s["upto"] > F.col("place")), 1)["label"].alias("label"))
        moved = materialise(single.unionByName(several), "moved")
        done = moved if done is None else done.unionByName(moved)
        now = told.where("spans is null").select("key", "g", "salt", "label")
        taken = plan.groupBy("label").agg(F.sum(F.col("upto") - F.col("from")).alias("took"))
        room = materialise(room.join(taken, "label", "left").select("label", F.greatest(F.col("room") - F.coalesce("took", F.lit(0)), F.lit(0)).alias("room")), "room")
        if now.isEmpty():
            break
    left = now.select("key", "g", "label")
    return (left if done is None else left.unionByName(done.select("key", "g", "label"))), room


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: the shards' counts are at most one apart, and slots run
    from 0 without gaps. ``grown_shard`` is null under this law. Null texts
    count as empty and are equal to each other and to empty texts. Null ids and
    repeated rows are rows like any others. Fewer documents than shards leave
    some shards empty; an empty table gives an empty result; other columns are
    ignored.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
    )
    # rows repeated as a whole get keys and salts of their own, so that they do not meet in one task; the table written below fixes them
    rows = rows.withColumn("key", F.xxhash64("doc_id", "g", F.monotonically_increasing_id())).withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SALTS)).cast("int"))
    rows = materialise(rows, "rows")
    n = rows.count()
    spark = docs.sparkSession
    want = [n // shards + (s < n % shards) for s in range(shards)]
    quota = spark.range(shards).select(F.col("id").cast("int").alias("label"), F.element_at(F.lit(want), F.col("id").cast("int") + 1).cast("long").alias("room"))
    salted = rows.groupBy("g", "salt").agg(F.count("*").alias("n"))
    parts = salted.join(salted.groupBy("g").agg(F.sum("n").alias("m")), "g").select("g", "salt", "m")  # SALTS rows a group at most
    alone = F.col("m") == 1
    sized = materialise(rows.join(parts, ["g", "salt"]), "sized")
    linked = sized.where(~alone).select("key", "g", "salt", "m")
    labels = propagate(linked.distinct(), shards, quota, rounds)
    names = ["doc_id", "size", "text_crc32"]
    placed = sized.where(~alone).select("key", "g", *names).join(labels.select("key", "g", "label"), ["key", "g"]).select(*names, "label")
    placed = materialise(ranked(placed, ["label"], [F.col("doc_id")], BUCKETS, "slot"), "placed")
    fits = F.col("slot") < F.element_at(F.lit(want), F.col("label") + 1)
    kept = placed.where(fits)
    got = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per shard
    free, edges = [want[s] - got.get(s, 0) for s in range(shards)], [0]
    for x in free:
        edges.append(edges[-1] + x)
    rest = placed.where(~fits).select(*names).unionByName(sized.where(alone).select(*names))
    rest = ranked(rest, [], [F.col("doc_id")], BUCKETS, "r")
    to = F.size(F.filter(F.lit(edges[1:]), lambda e: e <= F.col("r")))
    start = F.element_at(F.lit([got.get(s, 0) - edges[s] for s in range(shards)]), F.col("label") + 1)
    rest = rest.withColumn("label", to).withColumn("slot", (F.col("r") + start).cast("long"))
    out = kept.select(*names, "label", "slot").unionByName(rest.select(*names, "label", "slot"))
    return out.select(*names, F.lit("rows").alias("law"), F.col("label").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all ``documents`` in 40 shards."""
    return shard(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
