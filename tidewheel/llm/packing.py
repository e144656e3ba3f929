"""Packing by powers of two: a document's tokens are cut into pieces of 2048 and then of falling powers of
two, so every piece is a sequence of its own, with no padding at all and no sequence that crosses documents.

Sequences of equal length share a bucket: each task numbers the sequences of each bucket, so a bucket's ids
are one range (bucket, then task, then place), and every `batch_tokens / length` of them form a batch. Texts
become ids on the executors in one pass without a shuffle; a task's last batch of a bucket may be short.
The ranks give the same ids as the tokenizer file, faster; texts that hold a special token's string go
through the tokenizer file itself.

Edge cases: a null text is empty and gives its end token alone; a text is cut whole, whatever its length, in
one worker's memory; repeated rows give pieces of their own, in the order they are read; an empty table gives
no pieces; other columns are not carried, and a key named like a result column is an error.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.session import ship

LONGEST = 2048
END_ID = 1
#: Tokens of a whole batch.
BATCH_TOKENS = 1 << 16
#: A sequence's id is bucket, task and place: bits from BUCKET_BIT on, from TASK_BIT on, and below.
BUCKET_BIT, TASK_BIT = 58, 33
#: Result columns besides the key.
RESULTS = (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("bucket", T.IntegerType()), ("sequence_id", T.LongType()), ("batch_id", T.LongType()))

_CACHE: dict = {}


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str, ranks_path: str):
    """text -> ids of the tokenizer file; one for each worker."""
    found = _CACHE.get((json_path, ranks_path))
    if found is None:
        import public_tokenizers
        import tiktoken

        with open(json_path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full: list = []  # the tokenizer file takes much memory, and few texts need it

        def found(text: str) -> list[int]:
            if any(s in text for s in special):
                if not full:
                    from tokenizers import Tokenizer

                    full.append(Tokenizer.from_file(json_path))
                return full[0].encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _CACHE[(json_path, ranks_path)] = found
    return found


def pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; lengths are powers of two, the longest first."""
    out = [(at, longest) for at in range(0, n - n % longest, longest)]
    at = n - n % longest
    size = longest >> 1
    while at < n:
        if n - at >= size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, paths: tuple[str, str] | None = None, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row for each piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (log2 of length), sequence_id, batch_id, offset."""
    if longest < 1 or longest & (longest - 1) or longest >= 1 << 32:
        raise ValueError("the longest sequence must be a power of two below 2**32")
    if batch_tokens < longest:
        raise ValueError("a batch holds one of the longest sequences at least")
    if key.lower() in {n for n, _ in RESULTS} | {"offset"}:
        raise ValueError(f"{key} is the name of a result column")
    ship(docs.sparkSession)
    json_path, ranks_path = paths or tokenizer_paths()
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema["_key"], *(T.StructField(n, t) for n, t in RESULTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        task = TaskContext.get().partitionId() << TASK_BIT
        met = [0] * longest.bit_length()
        for batch in batches:
            keys = batch.column(0)
            for lo in range(0, batch.num_rows, 512):
                own, start, length, ids, total, buckets, sequence, batched = [], [], [], [], [], [], [], []
                for i in range(lo, min(lo + 512, batch.num_rows)):
                    all_ids = np.array([*encode(batch.column(1)[i].as_py()), END_ID], "<u4")
                    for at, size in pieces(len(all_ids), longest):
                        bucket = size.bit_length() - 1
                        first = bucket << BUCKET_BIT | task
                        own.append(i)
                        start.append(at)
                        length.append(size)
                        ids.append(all_ids[at : at + size].tobytes())
                        total.append(len(all_ids))
                        buckets.append(bucket)
                        sequence.append(first | met[bucket])
                        batched.append(first | met[bucket] // (batch_tokens >> bucket))
                        met[bucket] += 1
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(own, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(buckets, pa.int32()), pa.array(sequence, pa.int64()), pa.array(batched, pa.int64())],
                    names=["_key", *(n for n, _ in RESULTS)])

    return rows.mapInArrow(run, schema).withColumn("offset", F.lit(0).cast("long")).withColumnRenamed("_key", key)
