r"""License scans by diagonal voting.

The rolling word 2-grams of every text are joined with those of fixed templates. A match of template
word t at text word w votes for the diagonal w - t. A base phrase stands where its diagonal has all
its votes. Longer templates merge neighbouring diagonals (words put in or left out shift them), and a merged span
counts once enough of the template's 2-grams have voted for it, each counted once however often it stands
in the span, and the span is no longer than its template by half. Votes compare the words behind the hashes,
so a collision has none. A longer template's score counts the votes of a merged span that is a copy or has a
vote behind which the next two words agree as well: a common word pair alone scores nothing.

Edge cases: a null text is empty: no words, no places, empty labels, score 0; texts are scanned whole, and a
long one's votes meet in one group; spans of several labels may share words and all count; repeated rows have
rows of their own; an empty table gives an empty result; columns but key and text are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.shared import lower_for_matching

#: The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the method, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}
#: Words: runs of anything but ASCII characters that are neither letters (lower case by then) nor digits.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals at most so far apart merge; a merged span needs this share of its template's votes.
NEAR, SHARE = 3, 0.6
#: Words from a template's matching word on that have to agree somewhere in a span for a score below SHARE.
LOOK = 4
#: Characters of templates up to which their 2-grams are sent to every executor; more meet the texts in a join.
MOST_BROADCAST = 1 << 22


def template_grams(spark: SparkSession, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """A row for each 2-gram of each template: its size is fixed by the templates."""
    rows = []
    for is_base, named in ((True, {v: k for k, v in base.items()}), (False, templates)):
        for label, phrase in named.items():
            words = phrase.split()
            if len(words) < 2:
                raise ValueError("a template needs two words at least")
            for i in range(len(words) - 1):
                ahead = [] if is_base else words[i + 2 : i + LOOK]
                rows.append((label, is_base, len(words), i, words[i], words[i + 1], " ".join(ahead), len(ahead)))
    df = spark.createDataFrame(rows, "t_label string, t_base boolean, t_len int, t_pos int, t_w0 string, t_w1 string, t_ahead string, t_look int")
    return df.withColumn("t_hash", F.xxhash64("t_w0", "t_w1"))


def words_of(text: Column) -> Column:
    """The words of a text, in order. Each match of regexp_extract_all copies its matcher; split makes the words alone."""
    return F.array_remove(F.split(lower_for_matching(F.coalesce(text, F.lit(""))), BETWEEN), "")


def license_votes(docs: DataFrame, key: str, text: str, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """Matching 2-grams, and for each row of docs one row without a template (pos -1)."""
    rows = docs.select(F.col(key).alias("_id"), F.monotonically_increasing_id().alias("_row"), words_of(F.col(text)).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w").cast("long"))
    grams = rows.select("_id", "_row", "_n", "_w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("_w") - 2, F.lit(-1)))).alias("pos"))
    at = F.col("pos")
    small = sum(len(p) for p in [*base, *templates.values()]) <= MOST_BROADCAST
    if not small:  # what a shuffle carries is a few words, not the text
        grams, at = grams.withColumn("_w", F.when(at >= 0, F.slice("_w", at + 1, F.lit(LOOK)))), F.lit(0)
    w = lambda i: F.get("_w", at + i)
    grams = grams.withColumn("_hash", F.when(F.col("pos") >= 0, F.xxhash64(w(0), w(1))))
    t = template_grams(docs.sparkSession, base, templates)
    t = F.broadcast(t) if small else t
    agree = (F.col("_hash") == F.col("t_hash")) & (w(0) == F.col("t_w0")) & (w(1) == F.col("t_w1"))
    firm = (F.col("t_look") == 0) | (F.array_join(F.slice(F.col("_w"), at + 3, F.col("t_look")), " ") == F.col("t_ahead"))
    return grams.join(t, agree, "left").where("pos = -1 or t_label is not null").select("_id", "_row", "_n", "pos", "t_label", "t_base", "t_len", "t_pos", firm.alias("firm"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first and last word)."""
    votes = license_votes(docs, key, text, base, templates).repartition("_row")
    diagonals = votes.groupBy("_row", "_id", "_n", "t_label", "t_base", "t_len", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("firm").alias("firm"))
    along = Window.partitionBy("_row", "t_label").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    starts = F.when(gap.isNull() | F.coalesce(F.col("t_base"), F.lit(True)) | (gap > NEAR), 1).otherwise(0)
    spans = diagonals.withColumn("_new", starts).withColumn("_span", F.sum("_new").over(along))
    spans = spans.groupBy("_row", "_id", "_n", "t_label", "t_base", "t_len", "_span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("firm").alias("firm"))
    share = F.least(F.lit(1.0), F.col("votes") / (F.col("t_len") - 1))
    # A span that reaches much farther than its template is no copy of it.
    fits = (F.col("last") - F.col("first") + 2) <= F.col("t_len") * 1.5 + NEAR
    good = F.col("t_label").isNotNull() & F.when(F.col("t_base"), F.col("votes") == F.col("t_len") - 1).otherwise((share >= SHARE) & fits)
    spans = spans.withColumn("_good", good).withColumn("_share", share)
    is_base = F.col("_good") & F.col("t_base")
    found = spans.groupBy("_row", "_id", "_n").agg(
        F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("t_label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_good"), F.col("t_label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("t_base"), F.when(F.col("_good"), 1.0)).when(F.col("t_label").isNotNull() & (F.col("_good") | F.col("firm")), F.col("_share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("_good"), F.struct("first", (F.col("last") + 1).alias("last"), F.col("t_label").alias("label"))))).alias("spans"))
    return found.select(F.col("_id").alias(key), F.col("_n").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
