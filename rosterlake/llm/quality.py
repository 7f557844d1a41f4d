"""Line-first cleaning with DataFrame functions only.

Each line is judged on its own: too much odd punctuation, a row of navigation
links, a boilerplate phrase, a word stuttered four times in a row. Lines that
fail are removed, and a document that loses too much of its text this way is
rejected.

Boilerplate is told by phrases alone. Lines that stand in many documents are no
sign of it here: every line of a clean text with copies or near copies does, and
such texts are for the near-duplicate operators to thin out, not to reject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import only, text_or_empty

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "#*$%&|<>!?.,;:=_~^+@/\\[]{}()\"'"
WINDOW = 8

#: Phrases of licence notices, page furniture and consent banners, in lower case.
BOILERPLATE = [
    "all rights reserved", "licensed under", "this work is licensed", "released under the",
    "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
    "enable javascript", "click here", "sign up for our newsletter", "subscribe to our newsletter",
    "skip to content", "share this article", "powered by",
]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")


def boilerplate(text: Column) -> Column:
    """Whether one of the phrases stands in a text or a line."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in BOILERPLATE])


def line_fails(line: Column, odd_share: float = 0.15, odd_least: int = 4, bars: int = 2) -> Column:
    """Whether a line is to go for odd punctuation, navigation or stutter."""
    odd = _count(line, PUNCTUATION)
    solid = F.length(F.translate(line, WHITE, ""))
    punctuation = (odd >= odd_least) & (odd > odd_share * solid)
    navigation = F.size(F.split(line, " [|>»·] ")) > bars
    stutter = line.rlike(r"(?<!\S)(\S++)(?:\s+\1(?!\S)){3}")
    return punctuation | navigation | stutter


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, its lines ``_lines`` and the base measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows are found inside the row: windows are told apart by 64-bit
    hashes of their words' hashes, and only texts with equal ones are sorted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.split("text", "\n").alias("_lines"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("_h"))
    solid = F.filter("_lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        "doc_id",
        "text",
        "_lines",
        "_h",
        solid.alias("_solid"),
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("_solid") - F.size(F.array_distinct("_solid"))).cast("long")).drop("_solid")
    follow = [lambda i, k=k: F.get("_h", i + k) for k in range(1, WINDOW)]
    windows = F.transform(F.slice("_h", 1, F.size("_h") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[f(i) for f in follow]))
    rows = rows.withColumn("_w", F.when(F.size("_h") >= WINDOW, windows).otherwise(F.array().cast("array<long>"))).drop("_h")
    rows = rows.withColumn("_same", F.size("_w") > F.size(F.array_distinct("_w")))
    pairs = F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("_p", F.when(F.col("_same"), F.array_sort(pairs))).drop("_w", "_same")
    last = F.size("_p") - 1
    again = F.filter(
        "_p",
        lambda x, k: ((k > 0) & (F.get("_p", k - 1)["h"] == x["h"])) | ((k < last) & (F.get("_p", k + 1)["h"] == x["h"])),
    )
    rows = rows.withColumn("_at", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("_p")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5) -> DataFrame:
    """One row per document: the measures, ``cleaned_text`` and the verdict ``kept``.

    ``base_failed`` holds for fewer than 20 words or if words in repeated 8-word
    windows make up over 30 % of the words. Otherwise a document is kept unless
    its failing lines hold more than ``most_lost`` of its characters other than
    white space. ``lines_removed`` and ``chars_kept`` say what cleaning did.
    Null and empty texts have no words and fail. Null ids and repeated rows stay
    rows of their own; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = measured(docs, id_col, text_col)
    # lines are searched for phrases only where the whole text has one
    plain = F.filter("_lines", lambda x: ~line_fails(x))
    rows = rows.withColumn("_good", F.when(boilerplate(F.col("text")), F.filter("_lines", lambda x: ~(line_fails(x) | boilerplate(x)))).otherwise(plain))
    rows = rows.withColumn("cleaned_text", F.array_join("_good", "\n")).withColumn("lines_removed", (F.size("_lines") - F.size("_good")).cast("long"))
    rows = rows.withColumn("chars_kept", F.length(F.translate("cleaned_text", WHITE, "")).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("chars_kept") >= (1 - most_lost) * F.col("word_chars"))
    return rows.withColumn("kept", kept).drop("_good", "_lines", "text")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: measures and verdicts of all ``documents``."""
    return clean(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")).drop("cleaned_text")
