"""Operator 9, packing into optimal length buckets.

A text's tokens (byte-level BPE of a vocabulary file, read through the tiktoken library) and one end make a sequence; a text of more than
MAX_TOKENS gives several. The global histogram of lengths (at most MAX_TOKENS rows, so it fits the driver) goes through dynamic programming, which
chooses the BUCKETS upper bounds that waste the fewest padding tokens. Inside a bucket, sequences are dealt to shards of about
SHARD_TOKENS by a hash of their place, and every shard is cut into batches of BUDGET padded tokens, all full but a shard's last. Each
sequence carries its tokens.

Defined cases: a null or empty text is one sequence, the end alone; null doc_ids and repeated rows are sequences of their own, dealt like any
other (places, not ids, decide); an empty table gives no batches. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.llm.textkit import chunks, mapped, written

MAX_TOKENS, BUCKETS, BUDGET, SHARD_TOKENS = 4096, 16, 65_536, 8_000_000
_ENCODINGS: dict[str, object] = {}


def encoding(path: str) -> tuple[object, int]:
    """The encoding of a vocabulary file at a path, loaded once in a process, and the id of the end: the first that is free."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("tarnwell", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
    return _ENCODINGS[path]


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding; lengths ascending, counts positive.

    waste[j]: the least padding of the first j + 1 lengths with the buckets so far; the last of those is a bound.
    """
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    waste = lengths * rows[1:] - tokens[1:]
    cut = []
    for _ in range(1, min(buckets, n)):
        before = np.concatenate([[0], waste])  # before[i]: the first i lengths
        now, at = np.empty(n, np.int64), np.empty(n, np.int64)
        for j in range(n):
            own = before[: j + 1] + lengths[j] * (rows[j + 1] - rows[: j + 1]) - (tokens[j + 1] - tokens[: j + 1])
            at[j] = np.argmin(own)
            now[j] = own[at[j]]
        cut.append(at)
        waste = now
    bounds, j = [], n - 1
    for at in [*cut[::-1], np.zeros(n, np.int64)]:
        if j < 0:
            break
        bounds.append(int(lengths[j]))
        j = int(at[j]) - 1
    return bounds[::-1]


def sequences(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, part, n_tokens, ids (little-endian, 16 bits each, 32 in larger vocabularies) and place of each sequence; no shuffle.

    place is a number of its own for each sequence, by task and order: it holds once the result is written.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoding(path)
        kind = "<u2" if end < 1 << 16 else "<u4"
        place = TaskContext.get().partitionId() << 36
        for batch in batches:
            for b in chunks(batch):
                said = model.encode_ordinary_batch([t or "" for t in b.column("text").to_pylist()], num_threads=1)
                row, part, size, ids = [], [], [], []
                for i, x in enumerate(said):
                    x.append(end)
                    whole = np.array(x, kind)
                    for k in range(0, len(x), max_tokens):
                        row.append(i)
                        part.append(k // max_tokens)
                        size.append(min(max_tokens, len(x) - k))
                        ids.append(whole[k : k + max_tokens].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(part, pa.int32()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.arange(place, place + len(row)))], ["doc_id", "part", "n_tokens", "ids", "place"])
                place += len(row)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, part int, n_tokens long, ids binary, place long")


def packed(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, part, n_tokens, bound (the bucket's padded length), shard, batch (within bucket and shard) and ids of each sequence.

    path: a vocabulary file that all workers have. Sequences are written once and shuffled once.
    """
    rows = written(sequences(docs, path, max_tokens), "sequences")
    histogram = sorted(tuple(r) for r in rows.groupBy("n_tokens").count().collect())  # at most max_tokens rows
    lengths, counts = (np.array([r[i] for r in histogram], np.int64) for i in (0, 1))
    bounds = best_bounds(lengths, counts, buckets)
    bound, shards = F.lit(None).cast("long"), F.lit(1)
    for low, b in reversed(list(zip([0, *bounds], bounds, strict=False))):
        inside = F.col("n_tokens") <= b
        own = (lengths > low) & (lengths <= b)
        bound = F.when(inside, F.lit(b).cast("long")).otherwise(bound)
        shards = F.when(inside, max(1, -(-int((counts * lengths)[own].sum()) // shard_tokens))).otherwise(shards)
    mixed = F.xxhash64("place")
    dealt = rows.select("*", bound.alias("bound"), F.pmod(mixed, shards.cast("long")).alias("shard"))
    nth = F.row_number().over(Window.partitionBy("bound", "shard").orderBy(mixed, "place"))
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bound")))
    return dealt.withColumn("batch", F.floor((nth - 1) / size)).select("doc_id", "part", "n_tokens", "bound", "shard", "batch", "ids")


def vocabulary() -> str:
    """The vocabulary file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9 over all of documents."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
