"""Operator 1, document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; every window of w consecutive hashes keeps its smallest,
the rightmost of equal ones, with its position. Two texts that share k + w - 1 consecutive code points
share a kept hash; matches shorter than k are never seen.

Defined cases: a null text is empty; an empty text has an empty fingerprint; a text shorter than k has one
hash, of the whole text; with fewer than w hashes the whole text is one window. Likeness is the Dice
coefficient of the two multisets of kept hashes: 1 for two empty ones, 0 for one empty one. Documents follow each other by
doc_id, nulls first, equal ids by their texts' hashes, then texts; a lone document follows itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.textkit import U64, mapped, mix64

#: Code points in a gram and hashes in a window; both powers of two, so that doubling steps reach them. So short that about
#: two hashes for nine code points stay and a shared passage of 15 code points is always met.
GRAM, WINDOW = 8, 8
#: Digits of fingerprints in a batch of results, about.
BATCH_CHARS = 4_000_000
_BASE = 0x5851F42D4C957F2D
_LEAST = -(1 << 63)


def gram_hashes(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Finalised 32-bit rolling hashes of all k-grams (k a power of two), built by doubling."""
    h = points.astype(U64) + U64(1)
    if len(h) < k:
        if not len(h):
            return np.zeros(0, np.uint32)
        total = 0
        for c in h.tolist():
            total = (total * _BASE + c) & 0xFFFFFFFFFFFFFFFF
        h = np.array([total ^ len(h) << 56], U64)
    else:
        step, power = 1, _BASE
        while step < k:
            h = h[:-step] * U64(power) + h[step:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            step *= 2
    return (mix64(h) >> U64(32)).astype(np.uint32)


def winnow(hashes: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Positions of the rightmost smallest hash of every window of w (a power of two), each once, ascending."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    # smaller hash first, then the larger position: one 64-bit key makes the choice a plain minimum
    key = hashes.astype(U64) << U64(32) | U64(0xFFFFFFFF) - np.arange(n, dtype=U64)
    step = 1
    while step < w:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    at = (U64(0xFFFFFFFF) - (key & U64(0xFFFFFFFF))).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def fingerprint(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, by position."""
    hashes = gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    at = winnow(hashes, w)
    return hashes[at], at


def as_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hex digits for each kept hash: hash and position, 8 digits each."""
    return np.stack(print_, axis=1).astype(">u4").tobytes().hex()


def from_text(digits: str) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of as_text."""
    both = np.frombuffer(bytes.fromhex(digits), ">u4").reshape(-1, 2)
    return both[:, 0].astype(np.uint32), both[:, 1].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sorted multisets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    ua, ca = _counted(a)
    ub, cb = _counted(b)
    at = np.searchsorted(ub, ua)
    at[at == len(ub)] = 0
    hit = ub[at] == ua
    both = int(np.minimum(ca[hit], cb[at[hit]]).sum())
    return 2.0 * both / (len(a) + len(b))


def _counted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[first], np.diff(np.append(first, len(a)))


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<long> and positions array<long> of each text; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t or "", k, w) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([p[i].tolist() for p in prints], pa.list_(pa.int64())) for i in (0, 1))],
                ["doc_id", "hashes", "positions"],
            )

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, hashes array<long>, positions array<long>")


def with_followers(docs: DataFrame) -> DataFrame:
    """doc_id, text, dealt by ranges of doc_id and sorted, each range closed by a copy of what follows it.

    Columns: part (range), copy (0, or 1 for a row that belongs to the following range), id, doc_id, text. Each
    text is shuffled once; only boundaries, a few numbers for each range, reach the driver. A doc_id (or none) that fills several
    ranges is a boundary several times over: its rows are dealt by their texts' hashes to as many ranges, in the hashes' order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id")).withColumn("at", F.col("id").cast("double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = Counter(rows.approxQuantile("at", [i / parts for i in range(1, parts)], 1 / (8 * parts))) if parts > 1 else Counter()
    cuts = sorted(found) or [0.0]
    # a double beyond 2**53 may be several ids, which then stay together
    wide = [1, *(found[c] if abs(c) < 2.0**53 or c == _LEAST else 1 for c in cuts)]
    rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket").transform(rows)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    begin, last = F.array(*map(F.lit, accumulate([0, *wide[:-1]]))), F.array(*map(F.lit, wide))
    i = F.col("bucket").cast("int")
    part, key = begin[i], F.lit(0).cast("long")
    if max(wide) > 1:
        own = (F.col("at") == F.array(*map(F.lit, [-float("inf"), *cuts]))[i]) & (F.col("doc_id").isNull() | (F.col("at") > -(2.0**53)))
        nth = F.floor((text_hash.cast("double") / 2.0**64 + 0.5) * last[i])
        part, key = part + F.when(own, F.least(nth, last[i] - 1)).otherwise(last[i] - 1), text_hash
    rows = rows.withColumn("part", part.cast("int")).withColumn("key", key)
    firsts = sorted((r["part"], r["first"]["id"], r["first"]["key"]) for r in rows.groupBy("part").agg(F.min(F.struct("id", "key")).alias("first")).collect())
    # the range before each (in a circle) also gets this range's first document
    before = [(first, of, firsts[j - 1][0]) for j, (_, first, of) in enumerate(firsts)]
    also = spark.createDataFrame(before, "id long, key long, before int")  # a row for each range
    both = rows.join(F.broadcast(also), ["id", "key"], "left")
    own = F.struct(F.col("part"), F.lit(0).alias("copy"))
    more = F.struct(F.col("before").alias("part"), F.lit(1).alias("copy"))
    both = both.select("id", "doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, more))).alias("to"))
    both = both.select("to.part", "to.copy", "id", text_hash.alias("hash"), "doc_id", "text")
    return both.repartitionById(sum(wide), F.col("part")).sortWithinPartitions("part", "copy", "id", "hash", "text")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    out: list[tuple] = []
    size = 0
    for b in batches:
        for part, copy, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text")), strict=True):
            text = text or ""
            if held is None and copy:
                continue  # a second copy that ties with the first
            own = fingerprint(text)
            hashes = np.sort(own[0])
            if held is not None:
                _, was_id, was, was_own, was_hashes = held
                cut = len(was) // 4
                edited = was[: len(was) - cut] + text[:cut]
                other = fingerprint(edited)
                out.append((was_id, len(was), hashlib.sha256(edited.encode()).hexdigest(), as_text(was_own), as_text(other), likeness(was_hashes, np.sort(other[0])), likeness(was_hashes, hashes)))
                size += len(out[-1][3]) + len(out[-1][4])
            held = None if copy else (part, doc_id, text, own, hashes)
            if size >= BATCH_CHARS:
                yield _rows(out)
                out, size = [], 0
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness, as op1's contract has it."""
    return mapped(with_followers(docs), _follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1 over all of documents."""
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))




#: Polynomial hashes of 8 code points, mixed; the least of 8 with its rightmost place; counts of kept hashes joined.
_U, _PAST, _32 = "UHUGEINT", f"{1 << 64}::UHUGEINT", f"{1 << 32}::UBIGINT"
_POWERS = [f"{pow(_BASE, k, 1 << 64)}::{_U}" for k in range(GRAM)]
_POLY = " ".join(f"WHEN {n} THEN {' + '.join(f'c{j} * {_POWERS[n - 1 - j]}' for j in range(n))}" for n in range(1, GRAM + 1))
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, substring(t, 1, n - n // 4) || substring(next_t, 1, n // 4) AS edited FROM e),
x AS (SELECT doc_id, 0 AS kind, t AS s FROM f UNION ALL SELECT doc_id, 1, edited FROM f),
c AS (SELECT doc_id, kind, length(s) AS n, unnest(range(1, length(s) + 1)) AS i, (unicode(unnest(regexp_extract_all(s, '(?s).'))) + 1)::{_U} AS c0 FROM x),
l AS (SELECT *, {", ".join(f"lead(c0, {j}) OVER w AS c{j}" for j in range(1, GRAM))} FROM c WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
h0 AS (SELECT doc_id, kind, i, greatest(n - {GRAM - 1}, 1) AS m, xor(((CASE least(n, {GRAM}) {_POLY} END) % {_PAST})::UBIGINT, CASE WHEN n < {GRAM} THEN n::UBIGINT * {1 << 56}::UBIGINT ELSE 0::UBIGINT END) AS h FROM l WHERE i <= greatest(n - {GRAM - 1}, 1)),
h1 AS (SELECT * REPLACE (((h::{_U} + {0x9E3779B97F4A7C15}::{_U}) % {_PAST})::UBIGINT AS h) FROM h0),
h2 AS (SELECT * REPLACE ((xor(h, h >> 30)::{_U} * {0xBF58476D1CE4E5B9}::{_U} % {_PAST})::UBIGINT AS h) FROM h1),
h3 AS (SELECT * REPLACE ((xor(h, h >> 27)::{_U} * {0x94D049BB133111EB}::{_U} % {_PAST})::UBIGINT AS h) FROM h2),
k AS (SELECT doc_id, kind, i, m, (xor(h, h >> 31) >> 32) * {_32} + ({1 << 32} - i)::UBIGINT AS k FROM h3),
w AS (SELECT doc_id, kind, i, m, min(k) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM k),
q AS (SELECT DISTINCT doc_id, kind, k // {_32} AS h, {(1 << 32) - 1}::UBIGINT - k % {_32} AS place FROM w WHERE i <= greatest(m - {WINDOW - 1}, 1)),
o AS (SELECT doc_id, kind, count(*) AS size, string_agg(format('{{:08x}}{{:08x}}', h, place), '' ORDER BY place) AS digits FROM q GROUP BY ALL),
b AS (SELECT doc_id, kind, h, count(*) AS n FROM q GROUP BY ALL),
pair AS (SELECT doc_id, doc_id AS other, 1 AS kind FROM f UNION ALL SELECT doc_id, next_id, 0 FROM f),
same AS (SELECT pair.doc_id, pair.kind, sum(least(a.n, z.n))::DOUBLE AS n FROM pair JOIN b a ON a.doc_id = pair.doc_id AND a.kind = 0 JOIN b z ON z.doc_id = pair.other AND z.kind = pair.kind AND z.h = a.h GROUP BY ALL),
near AS (SELECT pair.doc_id, pair.kind, CASE WHEN a.size IS NULL OR z.size IS NULL THEN (a.size IS NULL AND z.size IS NULL)::INT::DOUBLE ELSE 2 * coalesce(same.n, 0) / (a.size + z.size)::DOUBLE END AS likeness, z.digits
  FROM pair LEFT JOIN o a ON a.doc_id = pair.doc_id AND a.kind = 0 LEFT JOIN o z ON z.doc_id = pair.other AND z.kind = pair.kind LEFT JOIN same ON same.doc_id = pair.doc_id AND same.kind = pair.kind)
SELECT f.doc_id, f.n AS n_chars, sha256(f.edited) AS edited_sha256, coalesce(o.digits, '') AS fingerprint, coalesce(y.digits, '') AS edited_fingerprint, y.likeness AS near_edited, z.likeness AS near_next
FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.kind = 0 JOIN near y ON y.doc_id = f.doc_id AND y.kind = 1 JOIN near z ON z.doc_id = f.doc_id AND z.kind = 0
"""
