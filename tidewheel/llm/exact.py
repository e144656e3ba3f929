"""Exact dedup: 128-bit content hash groups, smallest id kept, bytes compared inside each group.

Texts are grouped by the pair (hash, normalised text), so two texts that share a hash never share a
group: the grouping compares their bytes. Map-side aggregation leaves one copy of a text for each task,
whatever the size of its group. Rows then find their group by SHA-256, which is taken once of each row and
once more of each text of a group; only groups of two rows or more are joined, and adaptive execution
splits a hot key. Two texts of one SHA-256, of which one has copies, would stop the query with an error.

Edge cases: a null text counts as empty; texts are compared whole, whatever their length; equal texts with
null ids keep an id that isn't null if there is one; of rows that repeat the smallest id exactly one stays
(a tie that no column decides); an empty table gives an empty result. exact_dedup reads no other columns;
keep_first returns all columns of docs, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.shared import materialise, one_of_each, without

#: White space of the ASCII range, as the contract lists it.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed=content_hash) -> DataFrame:
    """Groups of two rows or more: _sha, keep_id, group_size. hashed: may be weak, as in tests."""
    rows = docs.select(F.col(key).alias("_id"), normalised(F.col(text)).alias("_norm")).withColumn("_hash", hashed(F.col("_norm")))
    groups = rows.groupBy("_hash", "_norm").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select(F.unhex(F.sha2("_norm", 256)).alias("_sha"), "keep_id", "group_size")
    same = F.count(F.lit(1)).over(Window.partitionBy("_sha"))
    checked = F.when(same > 1, F.raise_error(F.lit("two texts share a digest")).cast("long")).otherwise(F.col("group_size"))
    return materialise(groups.withColumn("group_size", checked))


def judged(docs: DataFrame, key: str, text: str, hashed=content_hash) -> DataFrame:
    """One row for each row of docs: _id, _h (of the text as it is), keep_id, group_size, kept, text_sha256."""
    groups = duplicate_groups(docs, key, text, hashed)
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256")).withColumn("_sha", F.unhex("text_sha256"))
    joined = rows.join(groups, "_sha", "left").select(
        "_id", "_h", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    nth = F.row_number().over(Window.partitionBy("_id", "text_sha256", "keep_id").orderBy("_h"))
    return joined.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")) & (nth == 1))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed=content_hash) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256."""
    return judged(docs, key, text, hashed).select(F.col("_id").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. A row is told by its id and its text's 64-bit hash."""
    rows = judged(docs, key, text).groupBy("_id", "_h").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_times"))
    rows = materialise(rows.where("not _stays or _times > 1"))
    own = [F.col(key), F.xxhash64(text)]
    left = without(docs, rows.where("not _stays").select("_id", "_h"), own, ["_id", "_h"])
    return one_of_each(left, rows.where("_stays").select("_id", "_h"), own, ["_id", "_h"])
