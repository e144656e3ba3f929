"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

A budget of tokens falls through a tree of levels (domain, language, source). At each node the children
share it by weight; a child that can't use its share (its subtree's tokens times the epochs allowed) takes
all it has, and its siblings share the rest by weight. Only what a whole family can't use reaches the
node's own siblings, for a node's capacity is its subtree's. This water filling has a closed form by
window sums: children in order of capacity / weight, the level is the largest of
(budget - capacities before) / (weights from here on).

A leaf with allowance a and t tokens takes each document floor(a / t) times; the next epoch adds the
longest prefix, in that epoch's seeded order, whose tokens fit the rest. The prefix's end is found from
sums over 4,096 hash buckets a leaf and running sums inside one bucket, so no leaf meets in one task;
documents then compare themselves with their leaf's end, without being shuffled.

Edge cases: null level values form a node of their own; a null text has the end token's one token; texts of
any length count whole; repeated ids stand or fall together, and a prefix ends before the first document that
doesn't fit, so ties in the order can't arise between different ids; an empty table gives an empty result.
The columns of docs stay, whatever their names, but for one named epoch, which the result's replaces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.shared import materialise, others

NONE = "(none)"
#: Leaves up to this many are sent to every executor (counted first); more meet the documents in a join.
MOST_BROADCAST = 10_000


def utf8_tokens(text: Column) -> Column:
    """An estimate of a text's tokens: a quarter of its bytes, and an end token."""
    return (F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4) + 1).cast("long")


def ranged_domain(source: Column, width: int) -> Column:
    """The letters that begin a source's name and its number by ranges: src7 and src9 are of src-1 if width is 5."""
    number = F.regexp_extract(source, "^[A-Za-z]*([0-9]{1,9})", 1)
    return F.coalesce(F.concat(F.regexp_extract(source, "^([A-Za-z]*)", 1), F.lit("-"), F.coalesce(F.floor(F.when(number != "", number.cast("long")) / width).cast("string"), F.lit(""))), F.lit(NONE))


def _weight(level: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.items():
        if w <= 0:
            raise ValueError("weights must be positive")
        out = F.when(level == value, F.lit(float(w))).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: Sequence[str], budget: str = "_budget", capacity: str = "_capacity", weight: str = "_weight") -> DataFrame:
    """Adds _share to children that carry their parent's budget."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    along = by.orderBy(F.col(capacity) / F.col(weight), *[c for c in children.columns if c.startswith("_l")])
    before = F.coalesce(F.sum(capacity).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(weight).over(along.rowsBetween(0, Window.unboundedFollowing))
    df = children.withColumn("_level", (F.col(budget) - before) / after)
    return df.withColumn("_share", F.least(F.col(capacity).cast("double"), F.max("_level").over(by) * F.col(weight))).drop("_level")


def allowances(leaves: DataFrame, n_levels: int, weights: Sequence[Mapping[str, float]], budget: float, epochs: int) -> DataFrame:
    """leaves: _l0.. and _tokens. Adds _allow, whole tokens."""
    names = [f"_l{i}" for i in range(n_levels)]
    above = None
    for i in range(n_levels):
        level = leaves.groupBy(*names[: i + 1]).agg(F.sum("_tokens").alias("_tokens")).withColumn("_capacity", F.col("_tokens") * epochs)
        level = level.withColumn("_weight", _weight(F.col(names[i]), weights[i] if i < len(weights) else {}))
        level = level.withColumn("_budget", F.lit(float(budget))) if above is None else level.join(above, names[:i])
        filled = water_fill(level, names[:i])
        above = filled.select(*names[: i + 1], F.col("_share").alias("_budget"))
        last = filled
    return last.select(*names, "_tokens", F.floor(F.col("_share") + 1e-6).cast("long").alias("_allow"))


def seeded_order(key: Column, epoch: Column, seed: int) -> Column:
    """32 hexadecimal digits by which an epoch orders its documents."""
    return F.md5(F.concat_ws("|", F.lit(seed), epoch, F.coalesce(key.cast("string"), F.lit(NONE))))


def mix(docs: DataFrame, levels: Sequence[Column], weights: Sequence[Mapping[str, float]], share: float, key: str = "doc_id", tokens: Column | None = None, epochs: int = 2, seed: int = 0) -> DataFrame:
    """Adds epoch to the rows of docs that it takes, a row for each time; share: the budget, of all tokens."""
    n = len(levels)
    names = [f"_l{i}" for i in range(n)]
    tokens = utf8_tokens(F.col("text")) if tokens is None else tokens
    named = [F.coalesce(x.cast("string"), F.lit(NONE)).alias(c) for c, x in zip(names, levels, strict=True)]
    placed = docs.select(F.struct(*others(docs, "epoch")).alias("_row"), F.col(key).alias("_key"), *named, tokens.alias("_t"))
    narrow = materialise(placed.select("_key", *names, "_t"))
    leaves = materialise(narrow.groupBy(*names).agg(F.sum("_t").alias("_tokens")))
    total, n_leaves = leaves.agg(F.sum("_tokens"), F.count(F.lit(1))).first()
    small = n_leaves <= MOST_BROADCAST
    hint = F.broadcast if small else (lambda x: x)
    plan = allowances(leaves, n, weights, share * (total or 0), epochs)
    plan = materialise(plan.withColumn("_full", F.floor(F.col("_allow") / F.col("_tokens"))).withColumn("_rest", F.col("_allow") - F.col("_full") * F.col("_tokens")))

    rows = narrow.join(hint(plan), names).withColumn("_order", seeded_order(F.col("_key"), F.col("_full"), seed)).withColumn("_bucket", F.substring("_order", 1, 3))
    sums = rows.groupBy(*names, "_bucket", "_rest").agg(F.sum("_t").alias("_sum"))
    along = Window.partitionBy(*names).orderBy("_bucket")
    upto = sums.withColumn("_upto", F.sum("_sum").over(along)).withColumn("_before", F.col("_upto") - F.col("_sum"))
    # The first bucket that doesn't fit whole holds the prefix's end.
    ends = upto.where("_upto > _rest").groupBy(*names).agg(F.min(F.struct("_bucket", "_before")).alias("_cut")).select(*names, F.col("_cut._bucket").alias("_bucket"), F.col("_cut._before").alias("_before"))
    ends = materialise(ends)
    inside = rows.join(hint(ends), [*names, "_bucket"]).withColumn("_running", F.col("_before") + F.sum("_t").over(Window.partitionBy(*names, "_bucket").orderBy("_order")))
    last = inside.where("_running <= _rest").groupBy(*names).agg(F.max("_order").alias("_last"))
    plan = plan.join(ends.select(*names, F.col("_bucket").alias("_cut")), names, "left").join(last, names, "left")
    plan = materialise(plan.select(*names, "_full", F.coalesce("_last", F.when(F.col("_cut").isNotNull(), F.col("_cut")).otherwise(F.lit("g"))).alias("_last")))
    # Without a document of the cut bucket the prefix ends before it: its three digits sort before its orders.
    chosen = placed.join(hint(plan), names)
    times = F.col("_full") + F.when(seeded_order(F.col("_key"), F.col("_full"), seed) <= F.col("_last"), 1).otherwise(0)
    chosen = chosen.withColumn("_times", F.least(times, F.lit(epochs))).where("_times > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))).alias("_epoch")).select("_row.*", F.col("_epoch").alias("epoch"))
