r"""URL filters on a sorted digest array.

Rules are (verdict, host, path). Their keys host + path become 64-bit xxhash digests in a sorted file
that every Python worker memory-maps; beside it stand the full strings. A url asks for each suffix of
its host at a dot with each rule-path length that its path has; a vectorised binary search finds digests,
and the stored string has to equal the key, so a collision never decides. The longest key wins.

The index is sent to the executors as a file (bounded by MOST_INDEX_BYTES, checked); larger rule sets go
through judge_by_join, where the same keys meet the rules in a shuffled join on the digest.

Edge cases: a null url, or one without "://", has an empty host and path, which no rule fits; urls are read
whole, whatever their length; of fitting keys of one length the smallest decides, and of rules of one key
block; repeated rows are judged alike; an empty table gives no rows. The columns of pages stay, whatever their
names, but for host, path, rule and verdict, which the result's replace.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewheel.llm.shared import ascii_lower, others
from tidewheel.session import ship

#: The contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_INDEX_BYTES = 512 << 20
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def build_index(rules: Iterable[tuple[str, str, str]]) -> np.ndarray:
    """The file's content: a header (rules, bytes of strings, path lengths), digests, string ends, host lengths, verdicts, path lengths, strings."""
    unique: dict[str, tuple[str, str, str]] = {}
    for verdict, host, path in rules:
        if unique.get(host + path, ("",))[0] != "block":
            unique[host + path] = (verdict, host, path)
    if any(not host for _, host, _ in unique.values()):
        raise ValueError("a rule needs a host")
    ordered = sorted((xxh64_intdigest(k.encode()), k, v) for k, v in unique.items())
    keys = [k.encode() for _, k, _ in ordered]
    blob = b"".join(keys)
    lengths = sorted({len(v[2]) for _, _, v in ordered})
    parts = [
        np.array([len(ordered), len(blob), len(lengths)], "<u8"), np.array([d for d, _, _ in ordered], "<u8"), np.cumsum([len(k) for k in keys], dtype="<u8") if keys else np.zeros(0, "<u8"),
        np.array([len(v[1].encode()) for _, _, v in ordered], "<u8"), np.array([v[0] == "allow" for _, _, v in ordered], "<u8"), np.array(lengths, "<u8")]
    return np.frombuffer(b"".join(p.tobytes() for p in parts) + blob, "u1")


class RuleIndex:
    """A memory-mapped index."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        n, size, n_lengths = (int(x) for x in raw[:24].view("<u8"))
        table = raw[24 : 24 + 8 * (4 * n + n_lengths)].view("<u8")
        self.digests, self.ends, self.hosts, self.allow = (table[i * n : (i + 1) * n] for i in range(4))
        self.lengths = [int(x) for x in table[4 * n :]]
        self.blob = raw[len(raw) - size :]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        keys, owners = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            fitting = [path[:k] for k in self.lengths if k <= len(path)]
            suffix = host
            while True:
                keys += [suffix + p for p in fitting]
                owners += [i] * len(fitting)
                _, dot, suffix = suffix.partition(".")
                if not dot:
                    break
                if not suffix:
                    break
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        if not keys or not len(self.digests):
            return rules, verdicts
        probes = np.fromiter((xxh64_intdigest(k.encode()) for k in keys), "u8", len(keys))
        at = np.searchsorted(self.digests, probes)
        hits = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probes)
        for h in hits:
            key, owner = keys[h], owners[h]
            for j in range(int(at[h]), len(self.digests)):  # rules whose digests collide stand side by side
                if self.digests[j] != probes[h]:
                    break
                stored = self.blob[int(self.ends[j - 1]) if j else 0 : int(self.ends[j])].tobytes().decode()
                if stored == key and (rules[owner] is None or (-len(key), key) < (-len(rules[owner]), rules[owner])):
                    rules[owner], verdicts[owner] = key, "allow" if self.allow[j] else "block"
        return rules, verdicts


_OPEN: dict[str, RuleIndex] = {}


def _judged(name: str, default: str):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = _OPEN.get(name) or _OPEN.setdefault(name, RuleIndex(SparkFiles.get(name)))
        for hosts, paths in batches:
            rules, verdicts = index.judge(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": pd.Series(rules, dtype=object), "verdict": pd.Series([v or default for v in verdicts], dtype=object)})

    return F.pandas_udf(run, "rule string, verdict string")


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to the rows of pages."""
    ship(pages.sparkSession)
    rules = list(rules)
    if sum(len(h) + len(p) + 40 for _, h, p in rules) > MOST_INDEX_BYTES:
        return judge_by_join(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), url, default)
    name = f"tidewheel-rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="tidewheel-")  # the driver serves the file from here as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    build_index(rules).tofile(os.path.join(folder, name))
    pages.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    rows = _split(pages, url).withColumn("_judged", _judged(name, default)("host", "path"))
    return rows.select("_row.*", "host", "path", "_judged.rule", "_judged.verdict")


def _split(pages: DataFrame, url: str) -> DataFrame:
    return pages.select(F.struct(*others(pages, "host", "path", "rule", "verdict")).alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """judge_urls for rule sets of any size: every distinct (host, path) is judged once, by a join on digests."""
    rows = _split(pages, url)
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    lengths = F.broadcast(rules.agg(F.collect_set(F.length("path")).alias("_lengths")))  # one row, an entry for each length of a path
    asked = rows.where("host <> ''").select("host", "path").distinct().join(lengths, F.lit(True))
    asked = asked.select("host", "path", F.explode(suffixes).alias("_suffix"), F.filter("_lengths", lambda k: k <= F.length("path")).alias("_fit")).select("host", "path", "_suffix", F.explode("_fit").alias("_k"))
    asked = asked.withColumn("_key", F.concat("_suffix", F.expr("left(path, _k)"))).withColumn("_digest", F.xxhash64("_key"))
    keys = rules.groupBy(F.concat("host", "path").alias("rule")).agg(F.max("verdict").alias("_v")).withColumn("_d", F.xxhash64("rule"))  # block is greater than allow
    found = asked.join(keys, (asked["_digest"] == keys["_d"]) & (asked["_key"] == keys["rule"]))
    best = found.groupBy("host", "path").agg(F.min_by(F.struct("rule", "_v"), F.struct(-F.length("rule"), "rule")).alias("_best"))
    return rows.join(best, ["host", "path"], "left").select("_row.*", "host", "path", "_best.rule", F.coalesce("_best._v", F.lit(default)).alias("verdict"))
