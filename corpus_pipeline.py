"""Preparing a training corpus in five stages, each by one operator of rosterlake.llm.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents,
doc_id, text, lang, source and n_chars; the last one returns the pieces of the
packed sequences. ``sf_dir`` names the folder of the tables; no stage needs more
than what its predecessor kept.

Language and packing cannot be told in SQL, so ``ORACLE_SQL`` is None; the tests
hold every stage against a brute-force version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import jaccard, langid, mixing, packing, simhash, suffix
from rosterlake.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.4
SHINGLE = 5

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays open; fills in a missing language.

    Null and empty texts have no letters and go. Documents without an id and rows
    repeated as a whole are judged like any others; further columns are dropped.
    Where no document has a language nothing can be learned, and all go. An
    empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    judged = langid.predict(docs, langid.train(docs))
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates on five-word shingles.

    Linked are fingerprints of at most 3 differing bits, and texts whose sets of
    shingles have a similarity of 0.8 or more.

    Documents without an id come after all others. Of rows that are equal in
    every column one stays.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text", "lang", "source", "n_chars").alias("row")
    )
    keyed = docs.select(*COLUMNS).withColumn("_key", key)
    texts = keyed.select(F.col("_key").alias("doc_id"), "text")
    rows = jaccard.read(texts, SHINGLE)
    groups = simhash.grouped(rows.select("doc_id", "fp"), more=jaccard.links(texts, rows, SHINGLE))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    parts = keyed.select("_key.*", *COLUMNS).dropDuplicates(["none", "id", "row"])
    return parts.join(first, ["none", "id", "row"], "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that stand in more than one place out of the texts; documents stay, with new lengths.

    A null text counts as empty and stays, as do texts shorter than the strings;
    rows repeated as a whole are each other's copies and lose their long texts.
    Documents without an id are cut like any others; an empty table stays empty.
    """
    cut = suffix.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights, in shuffled order.

    A null source is a source of its own; null texts count as empty, and a
    source without any bytes is left out. Rows of the same id, or without one,
    draw the same count. An empty table stays empty.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens.

    A null or empty text is one token long. Documents without an id and repeated
    rows are packed like any others; an empty table gives no sequence.
    """
    import public_tokenizers

    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
