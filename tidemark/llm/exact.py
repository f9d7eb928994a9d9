"""Exact deduplication: a two-pass Bloom filter parts texts that may repeat from those that cannot.

Pass one sends each task's text hashes (not the texts) to a filter that knows which values came twice. Pass two lets
rows that cannot repeat go straight to the result; only the rest shuffle, by the full SHA-256 of the normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bits
from tidemark.llm.common import ROW_KEY, SPACE, attach, reliable, row_key, staying


def normal(text: Column) -> Column:
    """A text without any ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and the row's key.

    Of texts equal after normalising, the row with the most code points stays, then the smallest id (null ids last); of
    rows that repeat with their id exactly one stays. Null texts count as empty and equal each other. An empty table gives
    an empty result. Extra columns are left out."""
    text = F.col(text_col)
    digests = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias(ROW_KEY), F.unhex(F.sha2(normal(text).cast("binary"), 256)).alias("sha"), F.coalesce(F.length(text), F.lit(0)).alias("chars"))
    # numbering a table that is already kept gives each row the same number whenever a task runs again
    rows = reliable(digests).withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("sha"))
    n = rows.count()
    may_repeat = bits.among(rows.select("h"), n, "twice")
    rows = reliable(rows.withColumn("maybe", may_repeat("h")).drop("h"))
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), "id", "row"))
    groups = rows.filter("maybe").groupBy("sha").agg(F.count("*").alias("size"), best.alias("best"))
    groups = reliable(groups.filter("size > 1").select("sha", "size", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row")))
    alone = rows.filter("not maybe").withColumns({"size": F.lit(None).cast("long"), "keep": F.lit(None).cast(docs.schema[id_col].dataType), "keep_row": F.lit(None).cast("long")})
    found = alone.unionByName(attach(rows.filter("maybe"), groups, "sha", "size", n))
    single = F.col("size").isNull()
    return found.select(F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), ROW_KEY)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return staying(docs, decisions(docs, id_col, text_col).select(ROW_KEY, "kept"), id_col, text_col)
