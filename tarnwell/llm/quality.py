"""Operator 6, quality rules with an isolation forest over rule statistics.

Rule statistics of a text (words, symbols, repeated lines and word windows, capitals, marks) become ratios; a forest of trees
with random splits of the labelled rows' range, holding the good ones, gives each text the mean length of its paths: texts
unlike good ones are isolated early. The threshold is calibrated on other labelled rows: the lowest score at which no more than
LOST of the good ones would go.

Learning takes a bounded sample: at most LABELLED labelled rows, chosen by a hash of doc_id. Every text's statistics cover all of it.

Defined cases: a null or empty text has no words and fails the base rules; without good labelled rows only the base
rules decide; labels that are null, or of documents that aren't there, are ignored, and so are other columns; a doc_id
with several labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.textkit import U64, Words, chunks, mapped, mix64, sums_by_row

#: Labelled rows learned from at most; share of good ones that may go.
LABELLED = 6000
LOST = 0.002
TREES, SAMPLE, DEPTH = 100, 256, 10
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words a text must have, and the share of repeated words (percent) that it may have.
LEAST_WORDS, MOST_REPEATED = 50, 50
_SPACE = " \t\n\r\x0b\x0c"


def _bytes_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _MARK, _DIGIT, _CAPITAL = _bytes_of("#*$%&|<>"), _bytes_of("!?"), _bytes_of("0123456789"), _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Base counts (BASE) and further counts of each text."""
    words = Words(column)
    data, at = words.data, words.offsets
    own = {
        "n_words": words.counts,
        "word_chars": sums_by_row(((data & 0xC0) != 0x80) & words.inside, at),
        "n_symbols": sums_by_row(_SYMBOL[data], at),
        "n_repeat_words": _repeated(words),
        "n_marks": sums_by_row(_MARK[data], at),
        "n_digits": sums_by_row(_DIGIT[data], at),
        "n_capitals": sums_by_row(_CAPITAL[data], at),
    }
    lines, dups = [], []
    for text in column.to_pylist():
        held = [x for x in (text or "").split("\n") if x.strip(_SPACE)]
        lines.append(len(held))
        dups.append(len(held) - len(set(held)))
    return own | {"n_lines": np.array(lines, np.int64), "n_dup_lines": np.array(dups, np.int64)}


def _repeated(words: Words) -> np.ndarray:
    """Words inside a window of three that its text holds more than once."""
    h, n = words.hashes(), words.counts
    many = np.maximum(n - 2, 0)
    row = np.repeat(np.arange(words.n_rows), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + words.first[:-1][row]
    key = mix64(mix64(mix64(mix64(row.astype(U64)) ^ h[at]) ^ h[at + 1]) ^ h[at + 2])
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    equal = key[order][1:] == key[order][:-1]
    same[1:] = equal
    same[:-1] |= equal
    hit = at[order[same]]
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[hit + j] = True
    return sums_by_row(covered, words.first)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too many repeated ones."""
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as ratios: texts x features."""
    n, c, lines = (np.maximum(s[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    symbols, marks = s["n_symbols"] / n, s["n_marks"] / n
    return np.stack(
        [
            np.log2(n),
            s["word_chars"] / n,
            symbols / (symbols + 0.1),  # saturates, so that a few symbols and many differ as none and a few do
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / n,
            marks / (marks + 0.1),
            s["n_digits"] / c,
            s["n_capitals"] / c,
            np.log2(n / lines),
        ],
        axis=1,
    )


class IsolationForest:
    """Trees of random splits in heap order: feature -1 is a leaf with its path length."""

    def __init__(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = 7):
        """rows: what is normal; lo, hi: the range of each feature in which splits are drawn, wider than that of rows."""
        rng = np.random.default_rng(seed)
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature, self.split, self.path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
        take = min(sample, len(rows))
        self.norm = max(_mean_path(take), 1e-9)
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), take, replace=False)], lo, hi, rng)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, rng: np.random.Generator) -> None:
        wide = np.flatnonzero(hi > lo)
        if depth == self.depth or len(rows) < 2 or not len(wide):
            self.path[t, node] = depth + _mean_path(len(rows))
            return
        f = int(rng.choice(wide))
        s = rng.uniform(lo[f], hi[f])
        self.feature[t, node], self.split[t, node] = f, s
        right, below, above = rows[:, f] >= s, hi.copy(), lo.copy()
        below[f] = above[f] = s
        self._grow(t, 2 * node + 1, depth + 1, rows[~right], lo, below, rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[right], above, hi, rng)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / that of a random tree): near 1 is anomalous."""
        total, all_ = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[all_, f] >= split[node]))
            total += path[node]
        return np.exp2(-total / len(self.path) / self.norm)


def _mean_path(n: int) -> float:
    """Mean path of an unsuccessful search in a random binary tree of n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Rules:
    """A forest with its threshold; with no forest, base rules alone."""

    def __init__(self, rows: np.ndarray, good: np.ndarray):
        """rows: features; good: whether each row is labelled good. Every second good row grows trees, the others calibrate."""
        own = rows[good]
        self.forest, self.threshold = None, np.inf
        if len(own) >= 20:
            self.forest = IsolationForest(own[::2], *np.quantile(rows, [0.005, 0.995], axis=0))
            self.threshold = float(np.quantile(self.forest.scores(own[1::2]), 1 - LOST, method="higher"))

    def kept(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, kept and score of each text."""
        failed = base_failed(s)
        score = self.forest.scores(features(s)) if self.forest else np.zeros(len(failed))
        return failed, ~failed & (score <= self.threshold), score


def learned(docs: DataFrame, labels: DataFrame) -> Rules:
    """Rules from a bounded sample of labelled rows."""
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 1).alias("good"))
    share = int(1_000_000 * min(1.0, LABELLED / max(1, labels.count())))
    some = labels.where(F.pmod(F.xxhash64(F.lit("forest"), "doc_id"), F.lit(1_000_000)) < share).limit(2 * LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                s = statistics(b.column("text"))
                x = features(s)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), pa.array(base_failed(s)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "good", "failed", "x"])

    found = mapped(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "good", "text"), work, "doc_id long, good boolean, failed boolean, x array<double>")
    got = sorted((r[0], r[1], list(r[2])) for r in found.where("not failed").select("doc_id", "good", "x").limit(4 * LABELLED).collect())
    return Rules(np.array([r[2] for r in got]) if got else np.zeros((0, 1)), np.array([r[1] for r in got], bool))


def judged(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, base counts, base_failed, kept and score of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                s = statistics(b.column("text"))
                failed, kept, score = shared.value.kept(s)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, work, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, score double")


def only_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject."""
    rules = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                yield b.filter(pa.array(rules.value.kept(statistics(b.column("text")))[1]))

    return mapped(docs, work, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6 over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
