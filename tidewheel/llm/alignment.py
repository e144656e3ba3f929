r"""Cross-tokenizer alignment: where the tokens of two tokenizers meet, overlap and go together, by relations.

The alignment (`align`) works on token rows: posexplode gives a row for each token, a windowed sum of byte lengths
its end, an equi-join of both sides on (text, end) the places where tokens of both end, a running count of these
cuts the group. An end occurs once a side, so the full join is a grouping of both sides' rows by (text, end), which
keeps the texts where they are; a join by two columns would move all tokens twice more. Sorted by their ends, the stretches between neighbouring ends of either
side lie in one token of each side, and each overlapping pair has exactly one such stretch: so the range join
for links is a running value, linear in the tokens, however long a group is.

Texts share most of their words, and both tokenizers treat a word on its own: the byte-level one cuts its text
at such places before it merges, and no piece of the other holds the characters on both sides. So texts are cut
there into units, and tokens are made and aligned once for each distinct unit. Texts of one task make chunks of
about CHUNK units, inside which a unit goes by its number. Results come back by chunk: documents meet the
results of their chunk's units, to count each pair's documents and then to add up numbers and join strings. If a
piece of the second tokenizer goes over a cut, a whole text is one unit.

A pair's count is over all documents that have tokens: one for each row of docs, repeated rows too.

Edge cases: texts that are null, empty, or that either tokenizer's tokens don't spell have no tokens: zeros and
an empty string; special tokens' strings are plain text; a long text is one row and one list of unit numbers,
and a long unit (a text without spaces) is aligned by its tokens' rows; repeated rows have rows of their own;
an empty table gives an empty result; columns but key and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewheel.llm.shared import materialise, release, release_part, written
from tidewheel.session import ship

#: Units of a chunk, about: its numbered units are one worker's dictionary, and their results one task's hash table.
CHUNK = 1 << 22
#: Documents of a row of unit numbers.
ROWS = 256
#: A letter, and the marks before which a text may be cut if they follow one.
LETTER, MARK = r"[^\W\d_²³¹]", ".,;:!?"
_RUN = rf"[{MARK}]*[^\s{MARK}]*(?:(?<!{LETTER})[{MARK}]+[^\s{MARK}]*)*"
#: A unit begins at a mark after a letter, at a space or a new line that stands alone between others, or after that new line.
UNIT = re.compile(rf"(?:\n(?=\S)| ?(?=\S){_RUN}|\s+{_RUN})(?:(?![ \n]\S)\s+{_RUN})*")
#: The character that stands for a space in pieces.
SPACE = "▁"
#: Pairs whose counts are sent to every executor; more meet the links in a join.
MOST_BROADCAST = 1 << 20
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_CACHE: dict = {}


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def tokenizers(paths: tuple[str, str]):
    """Two functions from a list of strings, which begin where a text (with its space) may be cut, to their ids; and their ids' bytes."""
    if paths not in _CACHE:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(paths[0], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_a = {i: b for b, i in ranks.items()}
        pieces = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(pieces.id_to_piece, range(len(pieces))))]
        lead = len(pieces.encode("\n"))  # a new line in front takes the space that the model adds, and joins no piece

        def ids_b(units: list[str]) -> list[list[int]]:
            return [ids[lead:] for ids in pieces.encode(["\n" + u for u in units], num_threads=1)]

        _CACHE[paths] = (lambda units: [fast.encode_ordinary(u) for u in units]), ids_b, bytes_a, bytes_b
    return _CACHE[paths]


def cuts_apart(path: str) -> bool:
    """Whether no piece of the model goes over a place where UNIT cuts."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [pieces.id_to_piece(i) for i in range(len(pieces)) if not pieces.is_byte(i) and not pieces.is_control(i) and not pieces.is_unknown(i)]
    over = re.compile(rf"\n|[^{SPACE}]{SPACE}|{LETTER}[{MARK}]")
    return not any(over.search(p) for p in plain) and pieces.encode("\n") == pieces.encode("\n\n")[:-1]


def _numbered(docs: DataFrame, key: str, text: str, apart: bool, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows of up to ROWS documents (_p, _keys, _sizes and _seq: the numbers in chunk _p of all their units, as compressed bytes), and the chunks' units (_p, _u, _unit)."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    own = rows.schema["_key"].dataType
    fields = [T.StructField("_kind", T.IntegerType()), T.StructField("_p", T.LongType()), T.StructField("_keys", T.ArrayType(own)), T.StructField("_sizes", T.ArrayType(T.IntegerType())), T.StructField("_seq", T.BinaryType()), T.StructField("_u", T.IntegerType()), T.StructField("_unit", T.StringType())]
    schema = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Numbers(dict):
            def __missing__(self, unit: str) -> int:
                self[unit] = at = len(self)
                return at

        def made(n: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["_p"] = pa.array([part] * n, pa.int64())
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def closed() -> Iterator[pa.RecordBatch]:
            units = pa.array(list(numbers), pa.string())
            for lo in range(0, len(units), 1 << 16):
                some = units[lo : lo + (1 << 16)]
                yield made(len(some), _kind=pa.array([1] * len(some), pa.int32()), _u=pa.array(range(lo, lo + len(some)), pa.int32()), _unit=some)

        part = TaskContext.get().partitionId() << 32
        numbers, met = Numbers(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                texts = batch.column(1).slice(lo, ROWS).to_pylist()
                each = [(UNIT.findall(" " + x) if apart else [" " + x]) if x else [] for x in texts]
                seq = np.fromiter((numbers[u] for units in each for u in units), "<i4", sum(map(len, each)))
                keys = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0).slice(lo, ROWS)).cast(schema.field("_keys").type)
                yield made(1, _kind=pa.array([0], pa.int32()), _keys=keys, _sizes=pa.array([list(map(len, each))], schema.field("_sizes").type), _seq=pa.array([pa.compress(seq.tobytes(), "zstd", asbytes=True)], pa.binary()))
                met += len(seq)
                if met >= chunk:
                    yield from closed()
                    numbers, met = Numbers(), 0
                    part += 1
        if numbers:
            yield from closed()

    both = materialise(rows.mapInArrow(run, T.StructType(fields)), "_kind")
    return both.where("_kind = 0").select("_p", "_keys", "_sizes", "_seq"), both.where("_kind = 1").select("_p", "_u", "_unit")


TOKENS = "array<struct<id int, len int>>"


def _tokenised(units: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """units: _unit. Adds a and b (tokens' ids and byte lengths), or null where the tokens don't spell the unit."""

    def listed(ids: list[list[int] | None], lens: list[list[int] | None]) -> pa.Array:
        flat = pa.StructArray.from_arrays([pa.array([i for x in ids if x for i in x], pa.int32()), pa.array([i for x in lens if x for i in x], pa.int32())], names=["id", "len"])
        offsets, at = [], 0
        for x in ids:
            offsets.append(at if x is not None else None)
            at += len(x or ())
        return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_a, make_b, bytes_a, bytes_b = tokenizers(paths)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                texts = part.column(0).to_pylist()
                columns = [part.column(0)]
                sides = []
                for make, spelt in ((make_a, bytes_a), (make_b, bytes_b)):
                    ids = make(texts)
                    sides.append((ids, [[spelt[i] for i in x] for x in ids]))
                fine = [all(b"".join(said[k]) == raw for _, said in sides) for k, raw in enumerate(t.encode() for t in texts)]
                for ids, said in sides:
                    columns.append(listed([x if ok else None for x, ok in zip(ids, fine, strict=True)], [[len(b) for b in x] if ok else None for x, ok in zip(said, fine, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=["_unit", "a", "b"])

    return units.mapInArrow(run, f"_unit string, a {TOKENS}, b {TOKENS}")


def align(texts: DataFrame) -> DataFrame:
    """texts: _t (a key of its own), a and b (the tokens of each side: id and byte length, together as many bytes).

    One row for each _t that has tokens: n_a, n_b, n_groups, groups (the string of ids), links (an a id in the
    upper and a b id in the lower 32 bits, in the order of the text; one for each overlapping pair of tokens).
    """
    texts = texts.where("size(a) > 0").repartition("_t")
    sides = texts.select("_t", F.posexplode(F.array("a", "b")).alias("_side", "_tokens"))
    tokens = sides.select("_t", "_side", F.posexplode("_tokens").alias("_i", "_x")).select("_t", "_side", "_i", F.col("_x.id").alias("_id"), F.col("_x.len").alias("_len"))
    running = Window.partitionBy("_t", "_side").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    ended = tokens.withColumn("_end", F.sum("_len").over(running))
    ends = ended.groupBy("_t", "_end").agg(F.max(F.when(F.col("_side") == 0, F.col("_id"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_id"))).alias("_b"))
    # From the last end back: the token that covers the stretch before an end is the last one met, and a cut opens a group.
    back = Window.partitionBy("_t").orderBy(F.desc("_end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    over = lambda c: F.last(c, ignorenulls=True).over(back).cast("long")
    ends = ends.select("_t", "_end", "_a", "_b", F.sum(cut.cast("int")).over(back).alias("_g"), (over("_a") * (1 << 32) + over("_b")).alias("_link"))
    steps = F.sort_array(F.collect_list(F.struct("_end", "_a", "_b", "_link")))
    whole = ends.groupBy("_t").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.max("_g").alias("n_groups"), steps.alias("_s"))

    def side(own: str, other: str) -> Column:
        """The ids of each group: an end that the other side shares ends a group."""
        ids = F.transform(F.filter("_s", lambda x: x[own].isNotNull()), lambda x: F.concat(x[own].cast("string"), F.when(x[other].isNull(), ",").otherwise(";")))
        return F.split(F.rtrim(F.array_join(ids, ""), F.lit(";")), ";")

    groups = F.array_join(F.zip_with(side("_a", "_b"), side("_b", "_a"), lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    return whole.select("_t", "n_a", "n_b", "n_groups", groups.alias("groups"), F.col("_s._link").alias("links"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(before, sizes) + np.repeat(starts, sizes)


def _by_number(units: pa.Table, documents: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of each row of documents: keys, how many units each has, and where each unit stands in the table of units (-1: nowhere, as it has no tokens)."""
    numbers = units["_u"].to_numpy()
    for keys, sizes, seq in zip(documents["_keys"], documents["_sizes"], documents["_seq"], strict=True):
        sizes = np.array(sizes.as_py(), np.int64)
        flat = np.frombuffer(pa.decompress(seq.as_py(), int(4 * sizes.sum()), "zstd"), "<i4") if sizes.sum() else np.zeros(0, np.int32)
        at = np.full(1 + max(flat.max(initial=-1), numbers.max(initial=-1)), -1, np.int64)
        at[numbers] = np.arange(len(units))
        yield keys.values, sizes, at[flat]


def _spelt(sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which documents have tokens: some units, and all of them with tokens."""
    missing = np.bincount(np.repeat(np.arange(len(sizes)), sizes), places < 0, len(sizes)) if len(places) else np.zeros(len(sizes))
    return (sizes > 0) & (missing == 0)


def _held(documents: pa.Table, units: pa.Table) -> pa.Table:
    """How many of the chunk's documents hold each pair."""
    if not len(documents) or not len(units):
        return pa.table({"_link": pa.array([], pa.int64()), "_n": pa.array([], pa.int64())})
    lists = pa.concat_arrays(units["_links"].chunks)
    links, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    own_sizes = np.diff(lists.offsets.to_numpy())
    own_starts = np.cumsum(own_sizes) - own_sizes
    counts = np.zeros(len(links), np.int64)
    for _, sizes, places in _by_number(units, documents):
        of = np.repeat(np.arange(len(sizes)), sizes)
        fine = _spelt(sizes, places)[of]
        once = np.unique(of[fine] * len(units) + places[fine])
        of, unit = once // len(units), once % len(units)
        pairs = np.unique(np.repeat(of, own_sizes[unit]) * len(links) + code[_ranges(own_starts[unit], own_sizes[unit])])
        counts += np.bincount(pairs % len(links), minlength=len(links))
    return pa.table({"_link": links, "_n": counts})


def _summed(schema: pa.Schema):
    """A document's numbers are its units' sums, its string their strings in order."""

    def run(documents: pa.Table, units: pa.Table) -> pa.Table:
        given = {c: units[c].to_numpy().astype(np.int64) for c in RESULTS if c != "n_links"}
        given["n_links"] = given["n_a"] + given["n_b"] - given["n_groups"]  # a stretch ends with a token of either side
        values, strings, out = [given[c] for c in RESULTS], units["groups"].to_pylist(), []
        for keys, sizes, places in _by_number(units, documents) if len(documents) else ():
            fine, before = _spelt(sizes, places), np.concatenate([[0], np.cumsum(sizes)])
            columns = []
            for v in values:
                sums = np.concatenate([[0], np.cumsum(v[places])]) if len(v) else np.zeros(len(places) + 1, np.int64)
                columns.append(np.where(fine, sums[before[1:]] - sums[before[:-1]], 0))
            said = ["" if not ok else hashlib.sha256(";".join(map(strings.__getitem__, places[a:b].tolist())).encode()).hexdigest() for ok, a, b in zip(fine, before[:-1], before[1:], strict=True)]
            out.append(pa.RecordBatch.from_arrays([keys.cast(schema.field(0).type), *map(pa.array, columns), pa.array(said)], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def align_tokenizers(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    if key.lower() in (*RESULTS, "groups_sha256"):
        raise ValueError(f"{key} is the name of a result column")
    ship(docs.sparkSession)
    paths = paths or tokenizer_paths()
    mark = written()
    rows, units = _numbered(docs, key, text, cuts_apart(paths[1]), chunk)
    tokens = materialise(_tokenised(units.select("_unit").distinct(), paths).withColumn("_t", F.monotonically_increasing_id()))
    units = materialise(units.join(tokens.select("_unit", "_t"), "_unit").select("_p", "_u", "_t"))
    aligned = materialise(align(tokens.select("_t", "a", "b")))
    release(mark + 1, mark + 2)  # from here on units go by number, so their strings and tokens can go
    release_part(mark, "_kind=1")

    def by_chunk(results: DataFrame):
        """Documents and their units' results, of each chunk."""
        results = units.join(results, "_t").withColumnRenamed("_p", "_chunk").drop("_t")
        return rows.groupBy("_p").cogroup(results.groupBy("_chunk"))

    held = by_chunk(aligned.select("_t", F.array_distinct("links").alias("_links"))).applyInArrow(_held, "_link long, _n long")
    counts = materialise(held.groupBy("_link").agg(F.sum("_n").alias("_n")))
    a = F.shiftright("_link", 32)
    top = counts.groupBy(a.alias("_a")).agg(F.max("_n").alias("_top"))
    counts = materialise(counts.join(top, a == F.col("_a")).select("_link", "_n", (F.col("_n") == F.col("_top")).alias("_best")))
    counts = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    told = aligned.select("_t", F.explode("links").alias("_link")).join(counts, "_link")
    told = told.groupBy("_t").agg(F.sum("_n").alias("count_sum"), F.count_if("_best").cast("int").alias("n_best"))
    numbers = aligned.select("_t", *[F.col(c).cast("int").alias(c) for c in ("n_a", "n_b", "n_groups")], "groups").join(told, "_t")

    own = T.StructField(key, docs.schema[key].dataType)
    schema = T.StructType([own, *(T.StructField(c, T.LongType()) for c in RESULTS), T.StructField("groups_sha256", T.StringType())])
    return by_chunk(numbers).applyInArrow(_summed(to_arrow_schema(schema)), schema)
