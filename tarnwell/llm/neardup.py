"""Operator 2, near-duplicates by BagMinHash.

A text is the multiset of its runs of five words (a text of one to four words: one run of all of them). Each
run owns Poisson processes over the discretised weights 1, 2, 3, ...: one on each of the intervals [0, 1),
[1, 2), [2, 4), [4, 8), ..., halved down to unit intervals as points are drawn, so that a run of weight w meets
all points below w. Each point falls on one of M components; a component keeps the time of its first point.
Two signatures agree in a component with a probability equal to the weighted Jaccard similarity of the
multisets. Bands of ROWS components give candidates; candidates whose signatures leave a similarity of 0.8
conceivable are verified by the exact weighted Jaccard similarity; classes are the connected components of
verified links.

Equal texts are one node from the start. No bucket is expanded into pairs: its members are compared with its least member. Where a bucket of three or more
still holds several classes after that, its members are compared in blocks, and only links that connect
classes leave the comparison.

Defined cases: classes are of texts, so rows that share a doc_id but not the text may be in different classes; null texts and texts
without words are alike to nothing, each a class of its own; a class's id is its least doc_id, null if all of its rows have none;
repeated rows are in one class. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tarnwell.llm.textkit import U64, Words, chunks, mapped, mix64, randoms, written

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 4: a pair at similarity 0.8 shares none with a probability of 5e-8.
M, ROWS = 128, 4
#: Components that must agree for an exact comparison; fewer have a probability of about 1e-8 at similarity 0.8.
LIKELY = 76
#: Members of a block where a bucket is compared in full, and bytes of their multisets, about.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Rows of ids and keys (about 60 bytes each) up to which a join on them is a broadcast; beyond, it is a shuffle.
BROADCAST_ROWS = 250_000


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit hash and count of each distinct run of words, by row and hash."""
    h, n = words.hashes(), words.counts
    many = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(words.n_rows), many)
    begin = np.cumsum(many) - many
    at = np.arange(len(row)) - np.repeat(begin, many) + words.first[:-1][row]
    length = np.minimum(n[row], width)
    r = randoms(width)
    total = np.zeros(len(row), U64)
    for j in range(width):
        has = length > j
        if has.all():
            total += h[at + j] * r[j]
        else:
            total[has] += h[at[has] + j] * r[j]
    key = np.sort(row.astype(U64) << U64(48) | mix64(total + length.astype(U64)) >> U64(16))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    key, count = key[first], np.diff(np.append(first, len(key)))
    return (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1), count


def bag_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int = M) -> np.ndarray:
    """n_rows x m times of the first points; infinite in rows without elements.

    weight: positive integers. All rows advance together, a point of each live process at a time; a process
    ends when its next point is later than the latest first point of its row.
    """
    h = np.full(n_rows * m, np.inf)
    seed = mix64(element ^ U64(0xA5A5A5A5A5A5A5A5))
    parts = []
    lo, hi = 0, 1
    most = int(weight.max()) if len(weight) else 0
    while lo < most:
        own = np.flatnonzero(weight > lo)
        parts.append((own, np.full(len(own), lo), np.full(len(own), hi)))
        lo, hi = hi, 2 * hi
    if not parts:
        return h.reshape(n_rows, m)
    own, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    row, w = row[own], weight[own]
    seed = _child(seed[own], lo, hi)
    x = _wait(seed, 0, hi - lo)
    drawn = np.zeros(len(x), np.int64)
    while len(x):
        unit = hi - lo == 1
        u = np.flatnonzero(unit)
        part = (mix64(seed[u] + drawn[u].astype(U64) * U64(0xD1342543DE82EF95)) >> U64(33)).astype(np.int64) % m
        np.minimum.at(h, row[u] * m + part, x[u])
        latest = h.reshape(n_rows, m).max(axis=1)
        # unit intervals draw their next point
        drawn[u] += 1
        nx = x.copy()
        nx[u] += _wait(seed[u], drawn[u], 1)
        if len(u) < len(x):
            # the point of a longer interval falls into one half; the other half draws a point of its own
            s = np.flatnonzero(~unit)
            mid = (lo[s] + hi[s]) // 2
            left = mix64(seed[s] ^ U64(0x5BD1E9955BD1E995)) >> U64(63) == 0
            a_lo, a_hi = np.where(left, lo[s], mid), np.where(left, mid, hi[s])
            b_lo, b_hi = np.where(left, mid, lo[s]), np.where(left, hi[s], mid)
            b_seed = _child(seed[s], b_lo, b_hi)
            row, w = np.concatenate([row[u], row[s], row[s]]), np.concatenate([w[u], w[s], w[s]])
            nx = np.concatenate([nx[u], x[s], x[s] + _wait(b_seed, 0, b_hi - b_lo)])
            seed = np.concatenate([seed[u], _child(seed[s], a_lo, a_hi), b_seed])
            lo, hi = np.concatenate([lo[u], a_lo, b_lo]), np.concatenate([hi[u], a_hi, b_hi])
            drawn = np.concatenate([drawn[u], np.zeros(2 * len(s), np.int64)])
        live = (nx <= latest[row]) & (lo < w)
        x, row, w, seed, lo, hi, drawn = nx[live], row[live], w[live], seed[live], lo[live], hi[live], drawn[live]
    return h.reshape(n_rows, m)


def _child(seed: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix64(seed + lo.astype(U64) * U64(0x9E3779B97F4A7C15) + hi.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def _wait(seed: np.ndarray, n: np.ndarray | int, rate: np.ndarray | int) -> np.ndarray:
    """Exponential waiting times, a function of the process's seed and the number of the point."""
    bits = mix64((seed ^ U64(0x2545F4914F6CDD1D)) + np.asarray(n).astype(U64) * U64(0x9FB21C651E98DF25))
    return -np.log(((bits >> U64(11)).astype(float) + 1) * 2.0**-53) / rate


def signatures(words: Words) -> np.ndarray:
    """16 bits for each component: rows x M."""
    row, element, weight = shingles(words)
    h = bag_min_hash(row, element, weight, words.n_rows)
    # the last bits of a logarithm may differ between processors
    return (mix64(h.view(U64) >> U64(16)) >> U64(48)).astype(np.uint16)


def levels(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int) -> list[bytes]:
    """Each row's multiset as a sorted set of 48-bit hashes of (element, occurrence), 8 bytes each; a first occurrence is its element."""
    own = np.repeat(np.arange(len(element)), weight)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(weight) - weight, weight)
    hashed = np.where(nth == 0, element[own], mix64(element[own] + nth.astype(U64) * U64(0xD6E8FEB86659FD93)) >> U64(16))
    key = np.sort(row[own].astype(U64) << U64(48) | hashed)
    cut = np.searchsorted(key, np.arange(n_rows, dtype=U64) << U64(48)).tolist() + [len(key)]
    low = key & U64((1 << 48) - 1)
    return [low[cut[i] : cut[i + 1]].tobytes() for i in range(n_rows)]


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two multisets in the form that levels() gives: exact but for equal hashes of 48 bits."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def _keys(column: pa.Array, counts: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each text; None for one without words."""
    return [hashlib.blake2b(t.encode(), digest_size=16).digest() if n else None for t, n in zip(column.to_pylist(), counts.tolist(), strict=True)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(batch):
            words = Words(b.column("text"))
            sig, keys = signatures(words), _keys(b.column("text"), words.counts)
            sigs = [x.tobytes() if k else None for x, k in zip(sig, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "key", "sig"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("sig_a", "sig_b"))
        keep = pa.array((x == y).sum(axis=1) >= LIKELY)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(batch):
            words = Words(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(_keys(b.column("text"), words.counts), pa.binary()), pa.array(levels(*shingles(words), words.n_rows), pa.binary())], ["key", "bag"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        likeness = [weighted_jaccard(x, y) for x, y in zip(b.column("bag_a").to_pylist(), b.column("bag_b").to_pylist(), strict=True)]
        keep = pa.array([x >= SIMILARITY for x in likeness], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(likeness, pa.float64()).filter(keep)], ["a", "b", "similarity"])


def _compared(t: pa.Table) -> pa.Table:
    """Verified links between two blocks of a bucket (or within one), as many as connect the classes that they connect.

    A pair is compared in the first band that it shares, and not once its classes are connected.
    """
    node, comp, block, band = (t.column(c).to_numpy() for c in ("node", "comp", "block", "pos"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(node), M // ROWS, ROWS)
    bags = t.column("bag")
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    root = np.unique(comp, return_inverse=True)[1]  # the class of each member, as joined so far
    a, b = [], []
    for x in left.tolist():
        other = right[right > x] if i == j else right
        other = other[root[other] != root[x]]
        equal = sig[other] == sig[x]
        first = equal.all(axis=2).argmax(axis=1) == band[0]
        for y in other[first & (equal.sum(axis=(1, 2)) >= LIKELY)].tolist():
            if root[x] != root[y] and weighted_jaccard(bags[x].as_py(), bags[y].as_py()) >= SIMILARITY:
                root[root == root[y]] = root[x]
                a.append(min(node[x], node[y]))
                b.append(max(node[x], node[y]))
    return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def joined_small(df: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """df joined with a table of ids: by broadcast if it is counted to be small, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def classes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: the least node of each connected component; only nodes with an edge.

    Alternates large-star and small-star steps, each a group-by with partial minima and a join that splits skewed
    keys, until the edges stay the same. Edges never reach the driver; only their number and a checksum do.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    was = None
    while (mark := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != was:
        was = mark
        # large-star: what is larger than a node goes to its least neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: what is smaller than a node goes to its least neighbour
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return written(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct(), "classes")


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and key of each row, and for each key its class_id and whether the row with doc_id `doc` is the one that stays of its class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(mapped(docs, _signed, "doc_id long, key binary, sig binary"), "signatures")
    # a node for each text, numbered once written; doc: the least doc_id that has it
    nodes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = written(_links(docs, nodes), "links")
    comps = classes(links)
    more = _rest(docs, nodes, comps)
    if more is not None:
        comps = classes(links.select("a", "b").unionAll(more.select("a", "b")))
    linked = nodes.select("node", "doc").join(comps, "node")
    least = linked.groupBy("comp").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "node")).alias("head"))
    heads = written(linked.join(least, "comp").select("node", F.col("head.doc").alias("class_id"), (F.col("head.node") == F.col("node")).alias("first")), "heads")
    of = nodes.select("key", "doc", "node").join(heads, "node", "left")
    return signed.select("doc_id", "key"), of.select("key", "doc", F.when(F.col("first").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept (whether it is the one that stays of its class) of every row."""
    rows, of = _classified(docs)
    both = rows.join(of, "key", "left")
    return both.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.col("key").isNull() | (F.col("first") & F.col("doc_id").eqNullSafe(F.col("doc")))).alias("kept"))


def _bands(nodes: DataFrame) -> DataFrame:
    band = F.posexplode(F.expr(f"transform(sequence(0, {M // ROWS - 1}), b -> xxhash64(b, substring(sig, b * {2 * ROWS} + 1, {2 * ROWS})))"))
    return nodes.select(band.alias("pos", "band"), "node")


_NO_ID = -(1 << 63)


def _bags(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """node, bag: the multisets of the texts of some nodes, which alone are read again."""
    own = written(nodes.select("node", "key", F.coalesce("doc", F.lit(_NO_ID)).alias("id")).join(ids.distinct(), "node", "left_semi"), "wanted")
    found = joined_small(docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text"), own.select("id").distinct(), "id", "left_semi")
    # a doc_id may have other texts, and a text several rows with that id
    bags = joined_small(mapped(found.select("text"), _multisets, "key binary, bag binary"), own.select("key", "node"), "key", "inner")
    return written(bags.groupBy("node").agg(F.first("bag").alias("bag")), "bags")


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links between the members of each bucket and its least member."""
    bands = _bands(nodes).select("band", "node")
    heads = bands.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("band", "a")
    pairs = bands.join(heads, "band").where("node > a").select("a", F.col("node").alias("b")).distinct()
    return _exact(docs, nodes, _plausible(pairs, nodes))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in enough components."""
    own = nodes.select("node", "sig")
    both = pairs.join(own.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(own.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    return mapped(both, _likely, "a long, b long")


def _exact(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with a weighted Jaccard similarity of at least SIMILARITY; only texts in a pair are read again in full."""
    pairs = written(pairs, "pairs")
    bags = _bags(docs, nodes, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")))
    both = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b").join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    return mapped(both, _verified, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _rest(docs: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Verified links inside buckets that still hold several classes besides their least member's links.

    Members are compared in blocks of about BLOCK members and BLOCK_BYTES at most: each pair of blocks is a task's group of bounded size, and at most
    one link for each member leaves it.
    """
    bands = _bands(nodes).join(comps, "node", "left").select("band", "pos", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = bands.groupBy("band", "pos").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("n > 2 and lo < hi").select("band", "pos")
    members = written(bands.join(mixed, ["band", "pos"]), "mixed")
    if members.isEmpty():
        return None
    bags = _bags(docs, nodes, members.select("node"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("bag")) / BLOCK_BYTES)).cast("int")
    sizes = members.join(bags, "node").groupBy("band", "pos").agg(blocks.alias("blocks"))
    members = members.join(sizes, ["band", "pos"]).join(nodes.select("node", "sig").join(bags, "node"), "node").withColumn("block", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
    dealt = members.withColumn("k", F.explode(F.expr("sequence(0, blocks - 1)"))).select("band", "pos", "node", "comp", "sig", "bag", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    return written(dealt.groupBy("band", "pos", "i", "j").applyInArrow(_compared, "a long, b long").distinct(), "links")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2 over all of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of texts that share a run, by their exact weighted Jaccard similarity; classes by reach.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS run FROM w),
bag AS (SELECT doc_id, run, count(*) AS n FROM s GROUP BY doc_id, run),
size AS (SELECT doc_id, sum(n) AS n FROM bag GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM bag a JOIN bag b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT c.a, c.b FROM common c JOIN size x ON x.doc_id = c.a JOIN size y ON y.doc_id = c.b WHERE c.n::DOUBLE / (x.n + y.n - c.n)::DOUBLE >= 0.8),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT d.doc_id, coalesce(min(r.other), d.doc_id) AS class_id, coalesce(min(r.other), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one with the least doc_id (ids before none), of repeated ones any.

    Defined cases: all rows without words stay; rows of one doc_id with other texts stay if their class has no lower id; null doc_ids and
    repeated rows are reduced like others; other columns, whatever their names, travel as they are.
    """
    rows, of = _classified(docs)
    met = written(rows.where("key is not null").groupBy("key", "doc_id").agg(F.count("*").alias("n")).join(of, "key").select("key", "doc_id", "n", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("doc"))).alias("kept")), "met")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(_keys(b.column("text"), Words(b.column("text")).counts), pa.binary())], ["row", "id", "key"])

    # all columns travel in one, so that none of theirs can clash
    kind = StructType([StructField("row", docs.schema), StructField("id", LongType()), StructField("key", BinaryType())])
    keyed = mapped(docs.select(F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text"), work, kind)
    ids = met.select("key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "n", "kept")
    out = joined_small(keyed, ids.where("not kept").select("key", "id"), ["key", "id"], "left_anti")
    again = ids.where("kept and n > 1").select("key", "id")
    if not again.isEmpty():  # one of each, combined within a task before it is shuffled
        out = joined_small(out, again, ["key", "id"], "left_anti").unionAll(joined_small(out, again, ["key", "id"], "left_semi").dropDuplicates(["key", "id"]))
    return out.select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
