"""N-gram Jaccard join: exact, by prefix filters under several global token orders.

A document is its set of word shingles, each a 64-bit hash. Two sets with Jaccard t or more share at
least ceil(t * size) shingles, so under every global order their prefixes of size - ceil(t * size) + 1
shingles meet, and prefixes longer by l - 1 meet in l places. Three orders are used, and a pair must pass
all before its texts are compared:

1. by hash: a document with fewer than l shingles of its longer prefix in any other document can have no
   partner and leaves here (most documents do);
2. rarest first, among the longer prefix: its l - 1 most frequent shingles fall away, the rest are the
   buckets in which pairs meet;
3. by another hash: the two prefixes must meet.

Parity sketches of 512 bits, whose difference never exceeds the sets', spare most remaining comparisons.

Equal sets are one class from the start: a class is a node with a number of its own. In each bucket all
members are held against its smallest node first, a number of pairs in proportion to the members; verified
links make components, and only members of different components that still share a bucket are compared
after that, so a group of copies costs no pair within it. Those buckets are dealt out by bands of set size,
as sets of far sizes can't link, and bands of more than BLOCK members by salted blocks. Connectivity is
whole; links inside a component that it doesn't need are neither compared nor counted there. jaccard_links and
jaccard_pairs hold all members of a bucket against each other instead, by the same bands and blocks, and give
every link. Components come from minimum labels with pointer jumping, on tables in the shared folder.

Edge cases: ASCII letters are lowered and ASCII white space separates words; texts are read whole, whatever
their length; a text with fewer words than a shingle is one shingle; a null text, or one without words, has
none and links with nothing; rows of equal texts (repeated rows too) are in one component; several texts
under one id are nodes of their own; null ids take no part in links and keep a null component; an empty
table gives an empty result. keep_one alone reads other columns; it returns all columns of
docs, whatever their names, and of repeated rows of one id and text it keeps one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh128_digest

from tidewheel.llm.shared import KeyFilter, matching, materialise, one_of_each, without
from tidewheel.session import ship

#: Words remembered by a worker before it forgets them all.
MOST_WORDS = 100_000
#: Members of a bucket's band that one block of the second pass holds.
BLOCK = 2048
#: Bits of a parity sketch: two sets differ in as many shingles at least as their sketches do in bits.
SKETCH = 512


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection on 64 bits for each salt (the finaliser of splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - width + 1, 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for i in range(min(width, len(words))):
        out = _mixed(out + h[i : i + n], i + 1)
    return np.unique(out)


@dataclass(frozen=True)
class Threshold:
    """Jaccard of at least num / den; extra: how much longer than need be the first order's prefix is, in parts of it."""

    num: int
    den: int
    extra: float

    def least(self, n: int) -> int:
        """The smallest size of a partner, and of the overlap."""
        return (self.num * n + self.den - 1) // self.den

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def places(self, n: int) -> int:
        """Places in which longer prefixes meet; it doesn't fall with n."""
        return min(int(self.prefix(n) * self.extra) + 2, self.least(n))

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and self.den * both >= self.num * (len(a) + len(b) - both)


def describe(docs: DataFrame, key: str, text: str, width: int, t: Threshold) -> DataFrame:
    """For each row: row (a number), key, h (of its text), n (shingles), sig (of the set), first (prefix by hash), keep, need, other (prefix by another hash, 32 bits each), sketch (parities)."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    fields = (("n", T.LongType()), ("sig", T.BinaryType()), ("first", T.ArrayType(T.LongType())), ("keep", T.IntegerType()), ("need", T.IntegerType()), ("other", T.ArrayType(T.IntegerType())), ("sketch", T.ArrayType(T.LongType())))
    schema = T.StructType([*rows.schema.fields[:3], *(T.StructField(n, kind) for n, kind in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ns, sigs, firsts, keeps, needs, others, sketches = [], [], [], [], [], [], []
                for x in part.column(3):
                    s = shingles(x.as_py(), width)
                    n = len(s)
                    ns.append(n)
                    sigs.append(xxh128_digest(s.tobytes()))
                    if t.least(n + 1) > n:  # only an equal set can be near enough
                        firsts.append(None)
                        keeps.append(0)
                        needs.append(0)
                        others.append(None)
                        sketches.append(None)
                        continue
                    p, places, need = t.prefix(n), t.places(n), t.places(t.least(n))
                    longer = min(p + places - 1, n)
                    firsts.append(s[np.argpartition(_mixed(s, 101), longer - 1)[:longer]].view(np.int64))
                    keeps.append(longer - need + 1)
                    needs.append(need)
                    b = _mixed(s, 202)
                    others.append((np.partition(b, p - 1)[:p] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                    sketches.append(np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(keeps, pa.int32()), pa.array(needs, pa.int32()), pa.array(others, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["row", "key", "h", *(n for n, _ in fields)])

    return rows.mapInArrow(run, schema)


def distinct_sets(sets: DataFrame) -> DataFrame:
    """A node for each distinct set that may have a partner: its first row, whose number names it, and the smallest key of its rows."""
    fields = F.struct(F.col("row").alias("node"), "key", "h", "n", "keep", "need", F.size("first").alias("longer"), "other", "sketch")
    classes = sets.where(F.col("key").isNotNull() & (F.col("need") > 0)).groupBy("sig").agg(F.min_by(fields, "row").alias("r"), F.min("key").alias("smallest"))
    return classes.select("sig", "smallest", "r.*")


def buckets(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, node, n: the places where pairs can meet."""
    postings = sets.where("need > 0 and key is not null").select(F.col("row").alias("node"), F.explode("first").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    hits = postings.join(shared, "token").join(nodes.select("node", "n", "keep", "need", "longer"), "node")
    of = Window.partitionBy("node")
    hits = hits.withColumn("found", F.count(F.lit(1)).over(of)).withColumn("nth", F.row_number().over(of.orderBy("df", "token")))
    # Shingles that no other document has come first in the second order; they meet nobody.
    return hits.where("found >= need and nth <= keep - (longer - found)").select("token", "node", "n")


def _near_sizes(a: str, b: str, t: Threshold):
    return F.least(a, b) * t.den >= F.greatest(a, b) * t.num


def _near_sketches(a: str, b: str, sizes: str, t: Threshold):
    """False only for sets whose symmetric difference is too large: it has a parity bit's worth at least for each differing bit."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH // 64)])
    return bits * (t.den + t.num) <= F.expr(sizes) * (t.den - t.num)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, t: Threshold) -> DataFrame:
    """Of the pairs (a, b) of nodes: those that pass the third order and whose texts are near enough."""
    pairs = materialise(pairs)
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("key", "h", "n", "other", "sketch")])
    pass_all = F.arrays_overlap("other_a", "other_b") & _near_sketches("sketch_a", "sketch_b", "n_a + n_b", t)
    first = matching(side("a"), ["a"], pairs.select("a"), ["a"]).join(pairs, "a").alias("l")
    second = matching(side("b"), ["b"], pairs.select("b"), ["b"]).alias("r")
    pairs = materialise(first.join(second, (F.col("l.b") == F.col("r.b")) & pass_all).select("a", "l.b", "key_a", "h_a", "key_b", "h_b"))

    def texts(x: str) -> DataFrame:
        rows = docs.select(F.col(key).alias(f"key_{x}"), F.xxhash64(text).alias(f"h_{x}"), F.col(text).alias(f"text_{x}"))
        return matching(rows, [f"key_{x}", f"h_{x}"], pairs.select(f"key_{x}", f"h_{x}"), [f"key_{x}", f"h_{x}"])

    full = texts("a").join(pairs, ["key_a", "h_a"]).join(texts("b"), ["key_b", "h_b"])
    schema = T.StructType([full.schema["a"], full.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            good = []
            names = batch.schema.names
            ta, tb = batch.column(names.index("text_a")), batch.column(names.index("text_b"))
            for i in range(batch.num_rows):
                b = tb[i].as_py()
                if last[0] != b:
                    last = (b, shingles(b, width))
                good.append(t.links(shingles(ta[i].as_py(), width), last[1]))
            yield pa.RecordBatch.from_arrays([batch.column(names.index(n)) for n in ("a", "b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialise(full.select("a", "b", "text_a", "text_b").mapInArrow(run, schema).distinct())


def merged_buckets(rest: DataFrame) -> DataFrame:
    """token, band, into: bands of buckets that become one under their smallest node's number.

    rest: token, p (smallest node of the bucket), node, band, own (band of the node's size, band or the one below).
    The bands of all buckets with one smallest node are merged if their distinct members make no more pairs than
    the buckets do one by one, so pairs are never lost and comparisons never grow.
    """
    here = F.col("own") == F.col("band")
    sizes = rest.groupBy("token", "p", "band").agg(F.count_if(here).alias("l"), F.count(F.lit(1)).alias("r"))
    apart = sizes.groupBy("p", "band").agg(F.sum(F.col("l") * F.col("r")).alias("apart"), F.count(F.lit(1)).alias("buckets")).where("buckets > 1")
    members = rest.groupBy("p", "band", "node").agg(F.max(here).alias("here"))
    together = members.groupBy("p", "band").agg((F.count_if("here") * F.count(F.lit(1))).alias("together"))
    fewer = apart.join(together, ["p", "band"]).where("together <= apart").select("p", "band")
    return sizes.join(fewer, ["p", "band"]).select("token", "band", F.col("p").alias("into"))


def across_components(placed: DataFrame, nodes: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b) of members (token, node, n, comp) of different components that share a bucket, without those its smallest node has met.

    A band holds sizes within den / num of each other, so partners are in one band or in neighbouring ones.
    The larger side is dealt over blocks, the smaller one is sent to each of them. The sketches stand in the
    join's condition, so few pairs leave it. Buckets are merged first where that spares comparisons: near copies
    share most of their buckets, and a pair would leave the join once for each.
    """
    open_ = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("node").alias("p"), F.count(F.lit(1)).alias("c")).where("x <> y and c > 2").select("token", "p")
    band = F.floor(F.log("n") / math.log(t.den / t.num * (1 + 1e-6))).cast("int") if t.num < t.den else F.col("n").cast("int")
    rest = materialise(placed.join(open_, "token").where("node <> p").select("token", "p", "node", "n", "comp", band.alias("own")))
    rest = rest.withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    rest = rest.join(merged_buckets(rest), ["token", "band"], "left")
    rest = rest.select(F.coalesce("into", "token").alias("token"), "band", "own", "node", "n", "comp").distinct()
    rest = materialise(rest.join(nodes.select("node", "sketch"), "node"))
    left = rest.where("own = band")
    blocks = left.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    left = left.join(blocks, ["token", "band"], "left").withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks", "own")
    right = rest.join(blocks, ["token", "band"], "left")
    right = right.select("token", "band", "own", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), F.col("sketch").alias("sketch_b"))
    left, right = left.alias("x"), right.alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block"))
    once = (F.col("own") < F.col("x.band")) | (F.col("node") > F.col("other"))
    near = met & once & (F.col("comp") != F.col("comp_b")) & _near_sizes("n", "m", t) & _near_sketches("sketch", "sketch_b", "n + m", t)
    return left.join(right, near).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """key, component: the smallest key that links (a, b) reach, for each key that has a link."""
    both = links.select("a", "b").union(links.select("b", "a"))
    both = materialise(both.distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("key") == F.col("a")).select("key", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        # Pointer jumping: a component's own label is at least as small.
        step = materialise(step)
        up = step.select(F.col("key").alias("component"), F.col("component").alias("top"))
        jumped = materialise(step.join(up, "component", "left").select("key", F.least("component", "top").alias("component"), "was"))
        labels = jumped.select("key", "component")
        if jumped.where("component <> was").isEmpty():
            return labels


def prepared(docs: DataFrame, key: str, text: str, width: int, t: Threshold) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sets of docs, their nodes, the buckets, and the links of each bucket's members with its smallest node."""
    sets = materialise(describe(docs, key, text, width, t))
    nodes = materialise(distinct_sets(sets))
    meet = materialise(buckets(sets, nodes))
    pivots = meet.groupBy("token").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.col("p.node").alias("b"), F.col("p.n").alias("m"))
    stars = meet.join(pivots, "token").where((F.col("node") != F.col("b")) & _near_sizes("n", "m", t)).select(F.col("node").alias("a"), "b").distinct()
    return sets, nodes, meet, verified(stars, nodes, docs, key, text, width, t)


def classes_of(sets: DataFrame) -> DataFrame:
    """sig, rep (smallest key), c (rows) of each class of equal sets."""
    return sets.where("n > 0 and key is not null").groupBy("sig").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("c"))


def with_classes(sets: DataFrame, known: DataFrame) -> DataFrame:
    """key, h, n of each row, with the columns of its class, if it has one that is known."""
    out = sets.select("key", "h", "n", F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("sig")).alias("sig"))
    return out.join(materialise(known), "sig", "left")


def labelled(docs: DataFrame, key: str, text: str, width: int, t: Threshold) -> DataFrame:
    """key, h, n, component for each row of docs."""
    sets, nodes, meet, links = prepared(docs, key, text, width, t)
    found = components(links)
    placed = meet.join(found.withColumnRenamed("key", "node"), "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("comp"))
    more = verified(across_components(placed, nodes, t), nodes, docs, key, text, width, t)
    found = found if more.isEmpty() else components(reduce(DataFrame.union, [links, more]))

    # A component is named by the smallest key of its classes.
    linked = found.join(nodes.select(F.col("node").alias("key"), F.col("smallest").alias("own"), "sig"), "key").select("sig", "own", "component")
    names = linked.groupBy("component").agg(F.min("own").alias("named"))
    linked = linked.join(names, "component").select("sig", "named")
    known = classes_of(sets).join(linked, "sig", "left").where("c > 1 or named is not null").select("sig", F.coalesce("named", "rep").alias("component"))
    out = with_classes(sets, known)
    return out.select("key", "h", "n", F.coalesce("component", "key").alias("component"))


def class_links(docs: DataFrame, key: str, text: str, width: int, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """The sets of docs, and every link between their classes, both ways: sig, other, each a class."""
    sets, nodes, meet, links = prepared(docs, key, text, width, t)
    # With a component to each node, all members that share a bucket are held against each other.
    apart = meet.withColumn("comp", F.col("node"))
    links = links.union(verified(across_components(apart, nodes, t), nodes, docs, key, text, width, t)).distinct()
    side = lambda x, sig: nodes.select(F.col("node").alias(x), F.col("sig").alias(sig))
    pairs = materialise(links.join(side("a", "sig"), "a").join(side("b", "other"), "b").select("sig", "other"))
    return sets, pairs.union(pairs.select("other", "sig"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10, extra: float = 0.25) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id."""
    rows = labelled(docs, key, text, width, Threshold(num, den, extra))
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10, extra: float = 0.25) -> DataFrame:
    """One row for each row of docs: key, n_shingles, class_id (smallest key of equal sets), n_links (other rows it links with, equal sets among them).

    Every pair of classes that may link is compared, so the work grows with the number of links between different texts.
    """
    sets, pairs = class_links(docs, key, text, width, Threshold(num, den, extra))
    classes = materialise(classes_of(sets))
    far = pairs.join(classes.select(F.col("sig").alias("other"), F.col("c").alias("far")), "other").groupBy("sig").agg(F.sum("far").alias("far"))
    known = classes.join(far, "sig", "left").where("c > 1 or far is not null").select("sig", "rep", (F.col("c") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    out = with_classes(sets, known)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("rep", "key").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10, extra: float = 0.25) -> DataFrame:
    """class_a, class_b: every link between classes of equal sets, by their smallest keys; class_id of jaccard_links says who is a member."""
    sets, pairs = class_links(docs, key, text, width, Threshold(num, den, extra))
    names = materialise(classes_of(sets).select("sig", "rep"))
    named = pairs.join(names.withColumnRenamed("rep", "class_a"), "sig").join(names.select(F.col("sig").alias("other"), F.col("rep").alias("class_b")), "other")
    return named.where("class_a < class_b or class_a = class_b and sig < other").select("class_a", "class_b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10, extra: float = 0.25) -> DataFrame:
    """The rows of docs whose id is their component's (rows with a null id, or without words, stay); all their columns."""
    rows = labelled(docs, key, text, width, Threshold(num, den, extra))
    gone = materialise(rows.where(F.col("component") != F.col("key")).select("key", "h").distinct())
    left = without(docs, gone, [F.col(key), F.xxhash64(text)], ["key", "h"])
    again = rows.where("component = key and n > 0").groupBy("key", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "h")
    return one_of_each(left, materialise(again), [F.col(key), F.xxhash64(text)], ["key", "h"])
