"""Operator 4, language identification by prediction by partial matching.

Each language has a context tree over bytes: for every context of 0 to ORDER bytes, counts of the bytes seen after
it. A byte costs what its longest known context says; a byte unknown there pays the context's escape and goes on in
the next shorter one, with the bytes of the longer context excluded (escape method C), down to a uniform code over the
bytes never seen. Contexts are the text's own bytes, across words and white space; the start counts as line ends. Statistics are frozen
after training, so code lengths are exact and do not depend on the order of texts, and each distinct byte with its context is
costed once. Letters A-Z count as a-z. The language with the shortest code wins; ties go to the first in alphabetical order.

score is the winner's share of 2 ** -(bits per byte), over all languages: 0 to 1.

Learning takes a bounded sample of the rows with a language: of every language, however many there are, the SAMPLE_ROWS texts with the
least hashes of doc_id and text, each of them whole; repeated rows count once. Workers count them; the driver gets the counts. Every sixth
of them is not learned from but says how many bits a byte of its language takes: a text is foreign if it takes more than the FOREIGN-fold
of the most that any of these took, with FOREIGN_BITS to spare, as short texts vary.

Defined cases: a null text, or one without letters, is `und` with score 0; rows with a null language are never learned from;
with no rows to learn from, every text is `und`. A null doc_id counts as an empty string for the fold; repeated rows have equal
results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.llm.textkit import LOWER, U64, chunks, flat, mapped, sums_by_row, written

ORDER = 4
SAMPLE_ROWS, PARTS = 300, 16
#: Costs (of a byte with its context, in a language) that a worker keeps at most.
KEPT = 8_000_000
FOREIGN, FOREIGN_BITS = 1.4, 400.0
_LETTER = re.compile(r"[^\W\d_]")


def contexts(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts below the `order` bytes before it, in one integer, and the places of the texts' begins and of the end."""
    data, offsets = flat(column)
    size = np.diff(offsets)
    wide = np.full(len(data) + order * len(size), 10, np.uint8)
    at = np.arange(len(data)) + order * np.repeat(np.arange(1, len(size) + 1), size)
    wide[at] = LOWER[data]
    key = np.zeros(len(data), U64)
    for j in range(order, -1, -1):
        key = key << U64(8) | wide[at - j]
    return key, offsets


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, counts, len(kinds))


class ContextTree:
    """Frozen byte statistics of one language, from the counts of bytes below their contexts.

    A key holds a byte and the bytes before it exactly: up to 8 in a 64-bit integer, the nearest lowest.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.levels = []
        for k in range(order + 1):
            pair, count = _summed(keys & U64((1 << 8 * (k + 1)) - 1), counts)
            owner = pair >> U64(8)
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]]))
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            self.levels.append({"pair": pair, "count": count, "context": owner[first], "total": total, "kinds": np.diff(np.append(first, len(owner))).astype(float)})
        # what is left of the next shorter context once the bytes known in this one are excluded
        for k in range(1, order + 1):
            own, up = self.levels[k], self.levels[k - 1]
            parent = own["context"] & U64((1 << 8 * (k - 1)) - 1)
            at = np.searchsorted(up["context"], parent)
            owner = np.repeat(np.arange(len(parent)), own["kinds"].astype(int))
            seen = np.searchsorted(up["pair"], parent[owner] << U64(8) | own["pair"] & U64(255))
            own["left"] = up["total"][at] - np.bincount(owner, up["count"][seen], len(parent))
            own["left_kinds"] = up["kinds"][at] - own["kinds"]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each byte below its context."""
        cost = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        total = np.full(len(keys), -1.0)  # of the context to use, after exclusion; -1: not excluded yet
        kinds = np.zeros(len(keys))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(level["context"]):
                continue
            i = np.flatnonzero(open_)
            pair = keys[i] & U64((1 << 8 * (k + 1)) - 1)
            c = np.searchsorted(level["context"], pair >> U64(8))
            c[c == len(level["context"])] = 0
            known = level["context"][c] == pair >> U64(8)
            i, c, pair = i[known], c[known], pair[known]
            n = np.where(total[i] < 0, level["total"][c], total[i])
            d = np.where(total[i] < 0, level["kinds"][c], kinds[i])
            p = np.searchsorted(level["pair"], pair)
            p[p == len(level["pair"])] = 0
            hit = level["pair"][p] == pair
            cost[i[hit]] += np.log2((n + d)[hit] / level["count"][p[hit]])
            miss = ~hit & (d > 0)  # with nothing left to say, the escape is certain
            cost[i[miss]] += np.log2((n + d)[miss] / d[miss])
            open_[i[hit]] = False
            if k:
                total[i[~hit]], kinds[i[~hit]] = level["left"][c[~hit]], level["left_kinds"][c[~hit]]
        unseen = 256 - (self.levels[0]["kinds"][0] if len(self.levels[0]["kinds"]) else 0)
        cost[open_] += np.log2(max(unseen, 1))
        return cost


class LanguageModel:
    """Context trees of several languages and the costs met so far; limits: bits a byte at which a text of a language is foreign."""

    def __init__(self, trees: dict[str, ContextTree], limits: dict[str, float] | None = None):
        self.names = sorted(trees)
        self.trees = [trees[x] for x in self.names]
        self.limits = limits or {}
        self.order = max((t.order for t in self.trees), default=ORDER)
        self.keys, self.costs = np.zeros(0, U64), np.zeros((len(self.trees), 0), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"keys": np.zeros(0, U64), "costs": np.zeros((len(self.trees), 0), np.float32)}

    def costs_of(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths of distinct keys: languages x keys."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(self.trees), len(keys)), np.float32)
        out[:, known] = self.costs[:, at[known]]
        new = keys[~known]
        fresh = np.stack([t.bits(new) for t in self.trees]).astype(np.float32) if self.trees else out[:, ~known]
        out[:, ~known] = fresh
        if (len(self.keys) + len(new)) * max(1, len(self.trees)) > KEPT:
            self.keys, self.costs = self.keys[:0], self.costs[:, :0]
        if len(new) * max(1, len(self.trees)) <= KEPT:
            keys, costs = np.concatenate([self.keys, new]), np.concatenate([self.costs, fresh], axis=1)
            order = np.argsort(keys)
            self.keys, self.costs = keys[order], costs[:, order]
        return out

    def lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language (texts x languages), and each text's bytes."""
        keys, offsets = contexts(column, self.order)
        which, kinds = pd.factorize(keys)
        costs = self.costs_of(kinds)
        total = [sums_by_row(c.astype(float)[which], offsets) for c in costs]
        return np.stack(total, axis=1) if total else np.zeros((len(column), 0)), np.diff(offsets)

    def predict(self, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """Language, score and the winner's bits per byte of each text."""
        total, size = self.lengths(column)
        names, scores, rates = [], [], []
        for text, n, cost in zip(column.to_pylist(), size.tolist(), total, strict=True):
            if not n or not self.names or not any(m[0].isalpha() for m in _LETTER.finditer(text or "")):
                names.append("und")
                scores.append(0.0)
                rates.append(8.0)
                continue
            best = int(np.argmin(cost))
            share = np.exp2(-(cost - cost[best]) / n)
            names.append(self.names[best])
            scores.append(float(1 / share.sum()))
            rates.append(float(cost[best] / n))
        return names, scores, rates

    def at_home(self, column: pa.Array) -> list[bool]:
        """Whether each text is in a learned language."""
        names, _, rates = self.predict(column)
        size = np.diff(flat(column)[1])
        return [x != "und" and rate * n <= self.limits.get(x, 8.0) * n + FOREIGN_BITS for x, rate, n in zip(names, rates, size.tolist(), strict=True)]


def train(texts: list[tuple[str, str]], order: int = ORDER) -> LanguageModel:
    """A model of (language, text) rows."""
    trees = {}
    for lang in {x for x, _ in texts}:
        keys, _ = contexts(pa.array([t for x, t in texts if x == lang]), order)
        trees[lang] = ContextTree(*np.unique(keys, return_counts=True), order)
    return LanguageModel(trees)


def held_out() -> Column:
    """The fold that is never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(batch):
            lang = np.array(b.column("lang").to_pylist(), object)
            for x in set(lang.tolist()):
                keys, _ = contexts(b.column("text").filter(pa.array(lang == x)))
                keys, counts = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "key", "n"])


def learned(docs: DataFrame) -> LanguageModel:
    """A model of a bounded sample of the rows with a language outside the held-out fold."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", "text", F.xxhash64(F.lit("ppm"), "doc_id", "text").alias("h"))
    # the hashes alone are ranked, in parts of a language first, so that a frequent language is no task of its own
    ranked = rows.select("lang", "h").distinct().withColumn("part", F.pmod(F.xxhash64("h"), F.lit(PARTS)))
    for by in (("lang", "part"), ("lang",)):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("n") <= SAMPLE_ROWS)
    bounds = ranked.groupBy("lang").agg(F.min("h").alias("first"), F.max("h").alias("last"))
    # a row for each language is broadcast; a language's first text is always learned from
    near = rows.join(F.broadcast(bounds), "lang").where("h <= last").dropDuplicates(["lang", "h"])
    near = written(near.select("lang", "text", ((F.col("h") == F.col("first")) | (F.pmod(F.col("h"), F.lit(6)) > 0)).alias("own")), "language-sample")
    got = mapped(near.where("own").select("lang", "text"), _counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    names, at = np.unique(got.column("lang").to_pandas().to_numpy().astype(str), return_inverse=True)
    key, n = got.column("key").to_numpy().astype(U64), got.column("n").to_numpy().astype(float)
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(len(names) + 1))
    model = LanguageModel({x: ContextTree(key[own], n[own]) for x, own in ((x, order[cut[i] : cut[i + 1]]) for i, x in enumerate(names.tolist()))})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(shared.value.names)}
        for batch in batches:
            for b in chunks(batch):
                total, size = shared.value.lengths(b.column("text"))
                bits = total[np.arange(len(size)), [place[x] for x in b.column("lang").to_pylist()]]
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(size), pa.array(bits)], ["lang", "size", "bits"])

    most = F.greatest(F.sum("bits") / F.sum("size"), F.max((F.col("bits") - FOREIGN_BITS) / F.col("size")))
    model.limits = {r["lang"]: FOREIGN * r["rate"] for r in mapped(near.where("not own").select("lang", "text"), taken, "lang string, size long, bits double").groupBy("lang").agg(most.alias("rate")).collect()}
    return model


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits (per byte) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                names, scores, bits = shared.value.predict(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return mapped(rows, work, "doc_id long, held_out boolean, lang_pred string, score double, bits double")


def in_a_language(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text is in none of the learned languages: `und`, or foreign.

    Defined cases: null texts and texts without letters go; with no language to learn from, all rows go; a language without a text to
    calibrate with keeps whatever is nearest to it; repeated rows go or stay together, other columns travel as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                yield b.filter(pa.array(model.value.at_home(b.column("text")), pa.bool_()))

    return mapped(docs, work, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4 over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, learned(docs))
