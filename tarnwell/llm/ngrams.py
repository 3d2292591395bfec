"""Operator 10, an interpolated modified Kneser-Ney model of order 2 or 3 (`ORDER`) over the whole training fold.

Spark counts; the model lies in sorted arrays, one set of files for each range of word hashes, in the folder that driver
and executors share, and scoring workers map them into memory:

- words: sorted 64-bit word hashes and counts; a word's id is its place over all ranges;
- pairs: sorted (id before << 32 | id) and counts; what follows each word: how many words once, twice, more often, and in all;
- before: how many different words come before each word.

Each pass adds up what a task has met before shuffling it, packed into one binary row for each range, so that a frequent word or pair
costs a range one entry for each task. Nothing is capped or sampled; the driver gets one row for each range.

Order 3 counts triples in place of pairs and has, instead of pairs as above,

- triple: contexts (id before << 32 | id before that), the words after each with their counts, and how many words follow it once, twice and in all;
- pair: sorted (id before << 32 | id) and how many different words come before that pair (for a text's first token: how often it is one).

Both are dealt by the range of the word before; where that is frequent (`hot`), by the other word too, so that no range gets all of it.
A text's first token has the start alone as its context.

Tokens are words with A-Z in lower case, then one end for each text, which also stands for the start of the next context.

Defined cases: a null or empty text is an end alone; a word or pair never met gets the lower orders' share; with
nothing to learn from, every token has probability 1. A null doc_id counts as an empty string for the fold; repeated rows count as often
as they come. Other columns are ignored. More than 2**32 different words raise: ids have 32 bits.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.textkit import U64, Words, chunks, mapped, mix64, new_folder, sums_by_row

#: The order of op10_scores.
ORDER = 3
#: Tokens that a task adds up before it hands counts on.
HELD = 2_000_000
#: Bytes of text for each range of word hashes, beyond as many ranges as Spark has shuffle partitions; ranges at most.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 20
BEGIN, END = U64(0x1D8AF8E3B1C7F259), U64(0x8E5C2F1B7A94D603)


def held_out() -> Column:
    """The fold that is never learned from: crc32 of doc_id as text, modulo 5, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, the token before each (BEGIN at a text's start) and the place of each text's first token."""
    words = Words(column, lower=True)
    first = words.first + np.arange(words.n_rows + 1)
    out = np.full(len(words.starts) + words.n_rows, END)
    out[np.arange(len(words.starts)) + words.row] = words.hashes()
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first[:-1]] = BEGIN
    return out, before, first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them, by hashing: only the distinct ones are sorted."""
    which, kinds = pd.factorize(keys)
    order = np.argsort(kinds)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return kinds[order], rank[which]


def numbered(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tokens and BEGIN; the place among them of each token, and of the one before it (BEGIN at a text's start)."""
    kinds, at = distinct(np.concatenate([[BEGIN], token]))
    was = at[:-1].copy()
    was[first[:-1]] = at[0]
    return kinds, at[1:], was


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys by byte planes (equal bytes lie together) and counts in the smallest width."""
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    return _squeezed(bytes([kind.itemsize]) + keys.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(kind).tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of pack."""
    raw = zstandard.decompress(raw)
    width = raw[0]
    n = (len(raw) - 1) // (8 + width)
    keys = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 1).reshape(8, n).T).reshape(-1).view("<u8")
    return keys, np.frombuffer(raw, f"<u{width}", n, 1 + 8 * n).astype(np.int64)


def _merged(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(r) for r in raws]
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def save(folder: str, name: str, array: np.ndarray) -> None:
    """An array as a file that appears whole; a task that runs again replaces it with the same."""
    tmp = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with open(tmp, "wb") as f:
        np.save(f, array)
    os.replace(tmp, f"{folder}/{name}.npy")


def save_all(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file, which a worker maps once; it appears whole, as those of save()."""
    head, at = {}, 0
    for key, a in arrays.items():
        head[key] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    tmp = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with open(tmp, "wb") as f:
        f.write(len(raw).to_bytes(8, "little") + raw)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(tmp, f"{folder}/{name}")


def load_all(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of save_all(), mapped."""
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    return {key: np.asarray(raw[(b := 8 + size + at) : b + n * np.dtype(kind).itemsize]).view(kind) for key, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}


def narrow(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, with places and values of those that need more."""
    at = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": at, f"{name}_more": values[at].astype(np.int64)}


def wide(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Counts of narrow() at some places."""
    out = arrays[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = arrays[f"{name}_more"][np.searchsorted(arrays[f"{name}_at"], at[big])]
    return out


def halved(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as their distinct upper halves, where each begins, and all lower halves."""
    group, begin = np.unique(keys >> U64(32), return_index=True)
    begin = np.append(begin, len(keys))
    return {"group": group.astype(np.uint32), "begin": begin.astype(np.min_scalar_type(len(keys))), "low": (keys & U64(0xFFFFFFFF)).astype(np.uint32)}


def within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `want` lie in values[lo:hi], each such range sorted, and where."""
    at, end = lo.astype(np.int64), hi.astype(np.int64)
    open_ = np.flatnonzero(at < end)
    low, size, own = at[open_], (end - at)[open_], want[open_]
    while len(open_):
        half = size >> 1
        less = (values[np.minimum(low + half, len(values) - 1)] < own) & (size > 0)
        low += (half + 1) * less
        size = half - (less & (size & 1 == 0))
        live = size > 0
        # ended searches stay (their places no longer move) until they are many
        if np.count_nonzero(live) < 0.6 * len(live):
            at[open_] = low
            open_, low, size, own = open_[live], low[live], size[live], own[live]
    inside = np.flatnonzero(at < end)
    hit = inside[values[at[inside]] == want[inside]]
    return hit, at[hit]


def triples(context: np.ndarray, word: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct contexts, how many words follow each, those words (sorted within a context) and their counts."""
    kinds, which = np.unique(context, return_inverse=True)
    key = which.astype(U64) << U64(32) | word.astype(U64)
    key, counts = np.unique(key, return_counts=True) if counts is None else summed(key, counts)
    return kinds, np.bincount((key >> U64(32)).astype(np.int64), minlength=len(kinds)), (key & U64(0xFFFFFFFF)).astype(np.uint32), counts


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def pack_triples(context: np.ndarray, size: np.ndarray, word: np.ndarray, counts: np.ndarray) -> bytes:
    """Triples by byte planes; the contexts' upper halves as differences."""
    parts = [np.array([len(context), len(word)], "<u8").tobytes(), _planes(np.diff(context >> U64(32), prepend=U64(0))), _planes(context & U64(0xFFFFFFFF)), _planes(word)]
    for x in (size, counts):
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        parts += [bytes([kind.itemsize]), x.astype(kind).tobytes()]
    return _squeezed(b"".join(parts))


def unpack_triples(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and count of each triple of pack_triples()."""
    raw = zstandard.decompress(raw)
    n, m = np.frombuffer(raw, "<u8", 2).tolist()
    at, halves = 16, []
    for x in (n, n, m):
        halves.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * x, at).reshape(4, x).T).reshape(-1).view("<u4"))
        at += 4 * x
    context = np.cumsum(halves[0].astype(U64), dtype=U64) << U64(32) | halves[1].astype(U64)
    size = np.frombuffer(raw, f"<u{raw[at]}", n, at + 1).astype(np.int64)
    at += 1 + n * raw[at]
    return np.repeat(context, size), halves[2], np.frombuffer(raw, f"<u{raw[at]}", m, at + 1).astype(np.int64)


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that hold for all of them."""

    folder: str
    shards: int
    first: list[int] = field(default_factory=list)  # shards + 1 ids
    total: int = 0  # N
    distinct: int = 0  # V
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    before_total: int = 0
    before_kinds: tuple[int, int, int] = (0, 0, 0)
    order: int = 2
    triple_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    maps: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def array(self, name: str, shard: int) -> np.ndarray | None:
        """A mapped array; None where its range is empty."""
        key = (name, shard)
        if key not in self.maps:
            path = f"{self.folder}/{name}{shard}.npy"
            self.maps[key] = np.load(path, mmap_mode="r") if self.first[shard + 1] > self.first[shard] and os.path.exists(path) else None
        return self.maps[key]

    def of_hash(self, hashes: np.ndarray) -> np.ndarray:
        """The range of each hash."""
        return ((hashes >> U64(32)) * U64(self.shards) >> U64(32)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: never met) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        shard = self.of_hash(hashes)
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            known = self.array("word", s)
            if known is None:
                continue
            own = slice(cut[s], cut[s + 1])
            at = np.searchsorted(known, hashes[own])
            at[at == len(known)] = 0
            hit = known[at] == hashes[own]
            ids[own] = np.where(hit, at + self.first[s], -1)
            counts[own] = np.where(hit, self.array("count", s)[at], 0)
        return ids, counts

    def by_id(self, name: str, ids: np.ndarray, width: int | None = None) -> np.ndarray:
        """Rows of an array with a row for each id; ids sorted, not negative."""
        out = np.zeros((len(ids), width) if width else len(ids), np.int64)
        shard = np.searchsorted(self.first, ids, "right") - 1
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            rows = self.array(name, s)
            if rows is not None:
                out[cut[s] : cut[s + 1]] = rows[ids[cut[s] : cut[s + 1]] - self.first[s]]
        return out

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """Order 3: how many words come before each id; counts after it that are 1, 2, more, and in all. ids sorted, not negative."""
        out = np.zeros((len(ids), 5), np.int64)
        shard = self.range_of(ids)
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            arrays = self.arrays("words", s)
            if arrays is not None:
                own = slice(cut[s], cut[s + 1])
                out[own] = np.stack([wide(arrays, f"{i}", ids[own] - self.first[s]) for i in range(5)], axis=1)
        return out

    def arrays(self, name: str, shard: int) -> dict[str, np.ndarray] | None:
        """The mapped arrays of a file of save_all(); None where there is none."""
        if (name, shard) not in self.maps:
            path = f"{self.folder}/{name}{shard}"
            self.maps[name, shard] = load_all(path) if os.path.exists(path) else None
        return self.maps[name, shard]

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.first, (keys >> U64(32)).astype(np.int64), "right") - 1
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            known = self.array("pair", s)
            if known is None or not len(known):
                continue
            own = slice(cut[s], cut[s + 1])
            at = np.searchsorted(known, keys[own])
            at[at == len(known)] = 0
            out[own] = np.where(known[at] == keys[own], self.array("times", s)[at], 0)
        return out

    def range_of(self, ids: np.ndarray) -> np.ndarray:
        """The range of each id."""
        return np.searchsorted(self.first, ids.astype(np.int64), "right") - 1

    def hot(self, counts: np.ndarray) -> np.ndarray:
        """Which words are so frequent that a range alone should not get all of what they are met with."""
        return counts > self.total // (4 * self.shards)

    def dealt(self, keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The range of each context or pair of order 3, whose upper half is the word before; hot: whether that is."""
        own = self.range_of(keys >> U64(32))
        return np.where(hot, (own + (mix64(keys & U64(0xFFFFFFFF)) % U64(self.shards)).astype(np.int64)) % self.shards, own)

    def found(self, name: str, keys: np.ndarray, hot: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """For each range: its arrays, which of the keys it has, and their places there."""
        shard = self.dealt(keys, hot)
        order = np.argsort(keys)
        # a stable sort of few bits is a radix sort
        order = order[np.argsort(shard[order].astype(np.min_scalar_type(self.shards)), kind="stable")]
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            arrays = self.arrays(name, s)
            if arrays is None:
                continue
            own = order[cut[s] : cut[s + 1]]
            group = np.searchsorted(arrays["group"], (keys[own] >> U64(32)).astype(np.uint32))
            group[group == len(arrays["group"])] = 0
            known = arrays["group"][group] == keys[own] >> U64(32)
            own, group = own[known], group[known]
            hit, at = within(arrays["low"], arrays["begin"][group], arrays["begin"][group + 1], (keys[own] & U64(0xFFFFFFFF)).astype(np.uint32))
            yield arrays, own[hit], at

    def preceded_pairs(self, keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Order 3: how many words come before each pair."""
        out = np.zeros(len(keys), np.int64)
        for arrays, own, at in self.found("pairs", keys, hot):
            out[own] = wide(arrays, "n", at)
        return out

    def thirds(self, keys: np.ndarray, hot: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order 3: counts of words (-1: never met) after contexts, and how many words follow each context once, twice, more often, and in all."""
        times, after = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        for arrays, own, at in self.found("triples", keys, hot):
            lo, end = (arrays["cut"][at + i].astype(np.int64) for i in (0, 1))
            one, two = wide(arrays, "one", at), wide(arrays, "two", at)
            after[own] = np.stack([one, two, end - lo - one - two, wide(arrays, "all", at)], axis=1)
            hit, at = within(arrays["word"], lo, end, words[own])
            times[own[hit]] = wide(arrays, "n", at)
        return times, after

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's probability after those before it, how often it was met in training, and the place of each text's first token."""
        token, _, first = tokens(column)
        kinds, at, at_before = numbered(token, first)
        ids, counts = self.ids(kinds)
        now, was = ids[at], ids[at_before]
        c = counts[at]
        v = self.distinct
        # lower order: how many different words come before the word, over a uniform share for all words and one more
        known = np.flatnonzero(ids >= 0)
        preceded = np.zeros(len(kinds), np.int64)
        after = np.zeros((len(kinds), 4), np.int64)
        if self.order == 3:
            both = self.neighbours(ids[known])
            preceded[known], after[known] = both[:, 0], both[:, 1:]
        else:
            preceded[known] = self.by_id("before", ids[known])
            after[known] = self.by_id("after", ids[known], 4)
        t = max(self.before_total, 1)
        left = sum(d * n for d, n in zip(self.word_discounts, self.before_kinds, strict=True)) if self.before_total else 1.0
        low = (np.maximum(preceded - _discount(preceded, self.word_discounts), 0) + left / (v + 1)) / t
        low = low[at]
        # upper order
        after = after[at_before]
        both = np.flatnonzero((now >= 0) & (was >= 0))
        pair, where = distinct(was[both].astype(U64) << U64(32) | now[both].astype(U64))
        times = np.zeros(len(token), np.int64)
        hot = self.hot(counts)[at_before]
        if self.order == 3:
            hot_pair = np.zeros(len(pair), bool)
            hot_pair[where] = hot[both]
            times[both] = self.preceded_pairs(pair, hot_pair)[where]
        else:
            times[both] = self.pairs(pair)[where]
        n = np.maximum(after[:, 3], 1)
        high = (np.maximum(times - _discount(times, self.pair_discounts), 0) + (after[:, :3] @ np.array(self.pair_discounts)) * low) / n
        p = np.where(after[:, 3] > 0, high, low)
        if self.order == 3:
            earlier = np.roll(was, 1)
            inner = np.ones(len(token), bool)
            inner[first[:-1]] = False
            of = np.flatnonzero(inner & (was >= 0) & (earlier >= 0))
            times, after = self.thirds(was[of].astype(U64) << U64(32) | earlier[of].astype(U64), hot[of], now[of])
            n = np.maximum(after[:, 3], 1)
            high = (np.maximum(times - _discount(times, self.triple_discounts), 0) + (after[:, :3] @ np.array(self.triple_discounts)) * p[of]) / n
            p[of] = np.where(after[:, 3] > 0, high, p[of])
        return p, c, first

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        p, c, first = self.probabilities(column)
        size, row = len(column), np.repeat(np.arange(len(column)), np.diff(first))
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        return {"n_tokens": np.diff(first), "n_known": sums_by_row(c > 0, first), "base_score": np.bincount(row, base, size), "score": np.bincount(row, np.log10(p), size)}


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4; fixed ones where some of these are missing."""
    if (n[:4] <= 0).any():
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k)) for k in (1, 2, 3))


def _blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each range; keys sorted, ranges ascending with them."""
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1]]))
    ends = np.append(cut[1:], len(shard))
    for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([pack(keys[a:b], counts[a:b])], pa.binary())], ["shard", "raw"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[bytes]]:
    shard, raws = -1, []
    for b in batches:
        if b.num_rows:
            shard = b.column("shard")[0].as_py()
            raws += b.column("raw").to_pylist()
    return shard, raws


def _of_kinds(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


_STATS = pa.schema([("shard", pa.int32()), ("stats", pa.list_(pa.int64()))])


def _stats(shard: int, *values: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[int(v) for v in values]], pa.list_(pa.int64()))], schema=_STATS)


def learned(docs: DataFrame, order: int = 2) -> Model:
    """A model of all rows outside the held-out fold, of order 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    rows = docs.where(~held_out()).select("text")
    # ranges follow the input's size, so that what one task merges doesn't grow with the corpus
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // RANGE_BYTES), MOST_RANGES))
    model = Model(new_folder(spark, "ngrams"), shards, [0] * (shards + 1), order=order)

    def words_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.array([BEGIN]), np.zeros(1, np.int64))], 0
        for batch in batches:
            for b in chunks(batch):
                token, _, _ = tokens(b.column("text"))
                kinds, at = distinct(token)
                held.append((kinds, np.bincount(at, minlength=len(kinds))))
                size += len(held[-1][0])
                if size > HELD:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD:
                        yield from _blobs(model.of_hash(held[0][0]), *held[0])
                        held, size = [], 0
        if held:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from _blobs(model.of_hash(keys), keys, counts)

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raws = _gathered(batches)
        if raws:
            keys, counts = _merged(raws)
            save(model.folder, f"word{shard}", keys)
            save(model.folder, f"count{shard}", counts.astype(np.min_scalar_type(int(counts.max()))))
            yield _stats(shard, len(keys), counts.sum(), (counts > 0).sum())

    stats = mapped(mapped(rows, words_met, "shard int, raw binary").repartitionById(shards, F.col("shard")), save_words, "shard int, stats array<long>").collect()
    size = np.zeros(shards, np.int64)
    for r in stats:
        size[r["shard"]] = r["stats"][0]
    model.total, model.distinct = (sum(r["stats"][i] for r in stats) for i in (1, 2))
    model.first = [0, *np.cumsum(size).tolist()]
    if model.first[-1] >= 1 << 32:
        raise ValueError("more than 2**32 different words")

    if order == 3:
        return _with_triples(rows, model)

    def pairs_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from _blobs(np.searchsorted(model.first, (keys >> U64(32)).astype(np.int64), "right") - 1, keys, counts)

        for batch in batches:
            for b in chunks(batch):
                token, before, _ = tokens(b.column("text"))
                kinds, at = np.unique(np.concatenate([token, before]), return_inverse=True)
                ids = model.ids(kinds)[0].astype(U64)[at]
                held.append(np.unique(ids[len(token) :] << U64(32) | ids[: len(token)], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def save_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raws = _gathered(batches)
        if not raws:
            return
        keys, counts = _merged(raws)
        lo, hi = model.first[shard], model.first[shard + 1]
        before = (keys >> U64(32)).astype(np.int64) - lo
        after = np.stack([np.bincount(before, w, hi - lo) for w in (counts == 1, counts == 2, counts > 2, counts)], axis=1).astype(np.int64)
        save(model.folder, f"pair{shard}", keys)
        save(model.folder, f"times{shard}", counts.astype(np.min_scalar_type(int(counts.max()))))
        save(model.folder, f"after{shard}", after)
        word, n = np.unique(keys & U64(0xFFFFFFFF), return_counts=True)
        yield from _blobs(np.searchsorted(model.first, word.astype(np.int64), "right") - 1, word, n)
        # how often counts of 1 to 4 occur, as keys that no word has
        yield from _blobs(np.full(4, shard), (U64(1) << U64(40)) + np.arange(4, dtype=U64), _of_kinds(counts))

    def save_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raws = _gathered(batches)
        if not raws:
            return
        keys, counts = _merged(raws)
        word = keys < U64(1) << U64(40)
        own = np.zeros(model.first[shard + 1] - model.first[shard], np.int64)
        own[keys[word].astype(np.int64) - model.first[shard]] = counts[word]
        save(model.folder, f"before{shard}", own)
        kinds = np.zeros(4, np.int64)
        kinds[(keys[~word] & U64(3)).astype(np.int64)] = counts[~word]
        yield _stats(shard, *kinds, *_of_kinds(own), (own > 2).sum(), own.sum())

    pairs = mapped(mapped(rows, pairs_met, "shard int, raw binary").repartitionById(shards, F.col("shard")), save_pairs, "shard int, raw binary")
    stats = mapped(pairs.repartitionById(shards, F.col("shard")), save_before, "shard int, stats array<long>").collect()
    s = np.array([r["stats"] for r in stats], np.int64).reshape(-1, 10).sum(axis=0)
    model.pair_discounts, model.word_discounts = discounts(s[:4]), discounts(s[4:8])
    model.before_kinds, model.before_total = (int(s[4]), int(s[5]), int(s[8])), int(s[9])
    return model


def _by_range(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range and the places that have it, ascending."""
    order = np.argsort(shard, kind="stable")
    kinds, begin = np.unique(shard[order], return_index=True)
    for s, own in zip(kinds.tolist(), np.split(order, begin[1:]), strict=True):
        yield s, own


_KEPT = "shard int, raw binary, kinds array<long>"


def _with_triples(rows: DataFrame, model: Model) -> Model:
    """What order 3 adds to a model of the words of rows."""
    shards = model.shards

    def triples_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            context, n, word, counts = triples(*(np.concatenate(x) for x in zip(*held, strict=True)))
            shard = model.dealt(context, model.hot(model.by_id("count", (context >> U64(32)).astype(np.int64))))
            for (s, own), (_, mine) in zip(_by_range(shard), _by_range(np.repeat(shard, n)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack_triples(context[own], n[own], word[mine], counts[mine])], pa.binary())], ["shard", "raw"])

        for batch in batches:
            for b in chunks(batch):
                token, _, first = tokens(b.column("text"))
                kinds, at, at_before = numbered(token, first)
                ids = model.ids(kinds)[0].astype(U64)
                now, was = ids[at], ids[at_before]
                earlier = np.roll(was, 1)
                earlier[first[:-1]] = was[first[:-1]]
                held.append((was << U64(32) | earlier, now.astype(np.uint32)))
                size += len(token)
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def save_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raws = _gathered(batches)
        if not raws:
            return
        context, n, word, counts = triples(*(np.concatenate(x) for x in zip(*map(unpack_triples, raws), strict=True)))
        del raws
        # a text's first token, whose context is the start twice, belongs to the pairs
        begin = U64(model.ids(np.array([BEGIN]))[0][0])
        start = context == (begin << U64(32) | begin)
        of, later = np.repeat(context, n), np.repeat(~start, n)
        pair = of & U64(0xFFFFFFFF << 32) | word.astype(U64)
        inner, own = np.unique(pair[later], return_counts=True)
        key, times = summed(np.concatenate([pair[~later], inner]), np.concatenate([counts[~later], own]))
        context, n, word, counts = context[~start], n[~start], word[later], counts[later]
        if len(context):
            row = np.repeat(np.arange(len(context)), n)
            sums = {name: np.bincount(row, w, len(context)).astype(np.int64) for name, w in (("one", counts == 1), ("two", counts == 2), ("all", counts))}
            cut = np.concatenate([[0], np.cumsum(n)])
            arrays = {**halved(context), "cut": cut.astype(np.min_scalar_type(int(cut[-1]))), "word": word, **narrow("n", counts)}
            for name, x in sums.items():
                arrays |= narrow(name, x)
            save_all(model.folder, f"triples{shard}", arrays)
        to = model.dealt(key, model.hot(model.by_id("count", (key >> U64(32)).astype(np.int64))))
        kinds = _of_kinds(counts).tolist()
        for s, own in _by_range(to):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(key[own], times[own])], pa.binary()), pa.array([kinds], pa.list_(pa.int64()))], ["shard", "raw", "kinds"])
            kinds = [0] * 4

    def save_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raws, of_triples = -1, [], np.zeros(4, np.int64)
        for b in batches:
            if b.num_rows:
                shard = b.column("shard")[0].as_py()
                raws += b.column("raw").to_pylist()
                of_triples += np.array(b.column("kinds").to_pylist(), np.int64).sum(axis=0)
        if not raws:
            return
        key, n = _merged(raws)
        save_all(model.folder, f"pairs{shard}", {**halved(key), **narrow("n", n)})
        # how many different words come before a word (0), and the counts after it that are 1, 2, more, and in all (1 to 4)
        was, at = np.unique(key >> U64(32), return_inverse=True)
        word, before = np.unique(key & U64(0xFFFFFFFF), return_counts=True)
        found = [(word, before)] + [(was, np.bincount(at, w, len(was)).astype(np.int64)) for w in (n == 1, n == 2, n > 2, n)]
        for what, (ids, values) in enumerate(found):
            yield from _blobs(model.range_of(ids), U64(what) << U64(40) | ids, values)
        yield from _blobs(np.full(8, shard), (U64(7) << U64(40)) + np.arange(8, dtype=U64), np.concatenate([_of_kinds(n), of_triples]))

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raws = _gathered(batches)
        if not raws:
            return
        key, n = _merged(raws)
        what, lo, size = key >> U64(40), model.first[shard], model.first[shard + 1] - model.first[shard]
        own = np.zeros((5, size), np.int64)
        for i in range(5):
            mine = what == U64(i)
            own[i, (key[mine] & U64(0xFFFFFFFF)).astype(np.int64) - lo] = n[mine]
        if size:
            arrays = {}
            for i, values in enumerate(own):
                arrays |= narrow(f"{i}", values)
            save_all(model.folder, f"words{shard}", arrays)
        kinds = np.zeros(8, np.int64)
        kinds[(key[what == U64(7)] & U64(7)).astype(np.int64)] = n[what == U64(7)]
        yield _stats(shard, *kinds, *_of_kinds(own[0]), (own[0] > 2).sum(), own[0].sum())

    met = mapped(mapped(rows, triples_met, "shard int, raw binary").repartitionById(shards, F.col("shard")), save_triples, _KEPT)
    pairs = mapped(met.repartitionById(shards, F.col("shard")), save_pairs, "shard int, raw binary")
    stats = mapped(pairs.repartitionById(shards, F.col("shard")), save_words, "shard int, stats array<long>").collect()
    s = np.array([r["stats"] for r in stats], np.int64).reshape(-1, 14).sum(axis=0)
    model.pair_discounts, model.triple_discounts, model.word_discounts = discounts(s[:4]), discounts(s[4:8]), discounts(s[8:12])
    model.before_kinds, model.before_total = (int(s[8]), int(s[9]), int(s[12])), int(s[13])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for b in chunks(batch):
                s = own.score(b.column("text"))
                train = pa.array(np.full(b.num_rows, own.total, np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s["n_tokens"]), pa.array(s["n_known"]), train, pa.array(s["base_score"]), pa.array(s["score"])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return mapped(rows, work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10 over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, learned(docs, ORDER))
