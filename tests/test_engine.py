"""The engine's own operators: literal cases, a brute-force fold, and small stores and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import mutations as m
from tarnwell.operators import blocks, buffer, dictionary, leaf, segment
from tarnwell.sources.store import SegmentStore
from tarnwell.streaming.ingest import ingest, replayed


def log(spark, ops):
    return spark.createDataFrame([(k, i, kind, p, d) for i, (k, kind, p, d) in enumerate(ops)], m.LOG)


def rows(df):
    return sorted((r["key"], r["kind"], r["payload"], r["delta"]) for r in df.collect())


CASES = {
    "put3": ([("b", 0, "2", None), ("a", 0, "1", None), ("g", 0, "3", None)], [("a", 0, "1", None), ("b", 0, "2", None), ("g", 0, "3", None)], None),
    "inc_pair": ([("c", 2, None, 2), ("c", 2, None, 3)], [("c", 2, None, 5)], None),
    "put_inc": ([("c", 0, "10", None), ("c", 2, None, 5)], [("c", 2, None, 5)], [("c", 0, "15", None)]),
    "del_inc": ([("c", 1, None, None), ("c", 2, None, 5)], [("c", 2, None, 5)], [("c", 0, "5", None)]),
    "inc_put_inc": ([("c", 2, None, 1), ("c", 0, "10", None), ("c", 2, None, 2), ("c", 2, None, 3)], [("c", 2, None, 5)], [("c", 0, "15", None)]),
    "inc_del": ([("c", 2, None, 1), ("c", 1, None, None)], [("c", 1, None, None)], None),
    "put_empty": ([("k", 0, "", None)], [("k", 0, "", None)], None),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    ops, literal, sequential = CASES[name]
    assert rows(m.coalesced(log(spark, ops))) == literal
    assert rows(m.coalesced_by_window(log(spark, ops))) == literal
    assert rows(m.coalesced(log(spark, ops), "sequential")) == (sequential or literal)


def test_fold(spark):
    r = random.Random(3)
    ops = [(f"k{r.randrange(9)}", kind := r.choice([0, 1, 2, 2]), str(r.randrange(99)) if kind == 0 else None, r.randrange(-9, 9) if kind == 2 else None) for _ in range(400)]
    now = {}
    for k, kind, p, d in ops:
        was = now.get(k)
        now[k] = (2, None, was[2] + d) if kind == 2 and was and was[0] == 2 else (kind, p, d)
    want = sorted((k, *v) for k, v in now.items())
    assert rows(m.coalesced(log(spark, ops))) == want == rows(m.coalesced_by_window(log(spark, ops)))


def test_hot_key(spark):
    """One key holds 90 % of the log: it is folded in as many places as there are ranges, and the result is that of one place."""
    n = 20_000
    kind = F.when(F.col("id") % 997 == 5, m.PUT).when(F.col("id") % 4001 == 7, m.DELETE).otherwise(m.INC)
    rows_ = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 50)).otherwise(F.lit("hot")).alias("key"), F.col("id").alias("seq"), kind.alias("kind"))
    ops = rows_.select("key", "seq", "kind", F.when(F.col("kind") == m.PUT, F.col("seq").cast("string")).alias("payload"), F.when(F.col("kind") == m.INC, F.col("seq")).alias("delta"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = m.coalesced(ops, ranges=16)
        assert rows(got) == rows(m.coalesced_by_window(ops)) == rows(m.coalesced(ops, ranges=1))
        plan = got._jdf.queryExecution().executedPlan().toString()
        # raw rows are dealt by key and range; by key alone only what the ranges gave
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert len(dealt) == 2 and "range" not in dealt[0] and "range" in dealt[1] and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_constructors(spark):
    one = spark.range(1).select(F.lit("a").alias("k"), F.lit(3).alias("s"), F.lit(7).alias("v"))
    k, q, v = F.col("k"), F.col("s"), F.col("v")
    got = [tuple(one.select(*cols).first()) for cols in (m.put(k, q, v), m.delete(k, q), m.inc(k, q, v))]
    assert got == [("a", 3, 0, "7", None), ("a", 3, 1, None, None), ("a", 3, 2, None, 7)]


def test_bad_mutations_raise(spark):
    for op in (("", 0, "x", None), ("k", 7, "x", None), ("k", None, "x", None)):
        with pytest.raises(Exception, match="known kind"):
            m.checked(log(spark, [op])).collect()


def test_sequential_needs_numbers(spark):
    with pytest.raises(Exception, match="CAST"):
        m.coalesced(log(spark, [("c", 0, "x", None), ("c", 2, None, 1)]), "sequential").collect()


def test_varint():
    for n in (0, 1, -1, 63, 64, -65, 2**63 - 1, -(2**63)):
        assert m.unvarint(m.varint(n)) == n and m.varint_len(n) == len(m.varint(n))
    for bad in (b"", b"\x80", b"\x01\x01", b"\xff" * 9 + b"\x02", b"\xff" * 9 + b"\x7f", b"\x80" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            m.unvarint(bad)


def test_buffer_reads(spark):
    b = m.coalesced(log(spark, [("a", 0, "1", None), ("c", 2, None, 2), ("d", 1, None, None)]))
    assert [r["value"] for r in buffer.get(b, "a").collect()] == ["1"]
    assert buffer.get(b, "c").count() == buffer.get(b, "d").count() == 0
    assert buffer.read(b, "d").first()["kind"] == 1
    assert [r["key"] for r in buffer.scan(b, 2).collect()] == ["a", "c"]
    assert buffer.size(log(spark, [("a", 0, "1", None), ("a", 1, None, None)])).first()[0] == 1


def test_resurrection(spark):
    b = m.coalesced(log(spark, [("c", 1, None, None), ("c", 2, None, 5), ("x", 0, "new", None), ("y", 1, None, None), ("z", 2, None, 1)]))
    s = spark.createDataFrame([("c", None, 7), ("x", "old", None), ("y", "gone", None), ("w", "kept", None)], "key string, value string, counter bigint")
    got = sorted((r["key"], r["value"], r["counter"]) for r in leaf.resolved(b, s).collect())
    assert got == [("c", None, 12), ("w", "kept", None), ("x", "new", None), ("z", None, 1)]


def test_packing_sizes(spark):
    def at(pairs, target):
        e = spark.createDataFrame([(1, k, v) for k, v in pairs], "segment bigint, key string, value string")
        return [(r["n_entries"], r["length"]) for r in blocks.index(blocks.packed(e, target)).orderBy("block").collect()]

    raw3 = [("alpha", "tenant=a|state=active|count=1"), ("beta", "tenant=a|state=active|count=2"), ("delta", "tenant=b|state=disabled|count=9")]
    short = [("alpha", "1"), ("beta", "2"), ("delta", "3"), ("gamma", "4"), ("omega", "5")]
    assert at(raw3, 64) == [(1, 62), (1, 61), (1, 64)]
    assert at(short, 64) == [(2, 51), (2, 52), (1, 34)]


def test_bloom_sizes(spark):
    want = {0: (64, 1), 1: (64, 30), 3: (64, 15), 7: (72, 7), 100: (960, 7), 1000: (9592, 7), 1_000_000: (9_585_064, 7)}
    got = {r["n"]: (r["bits"], r["hashes"]) for r in blocks.bloom_sizing(spark.createDataFrame([(n,) for n in want], "n bigint"), "n").collect()}
    assert got == want == {n: blocks.bloom_size(n) for n in want}


def test_seek_many(spark):
    keys = sorted(random.Random(5).sample(range(1000), 200))
    s = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = dict(tuple(r) for r in segment.seek_many(s, "k", spark.range(-3, 1005).toDF("t")).collect())
    assert got == {t: next((k for k in keys if k >= t), None) for t in range(-3, 1005)}
    assert dict(tuple(r) for r in segment.following(s, "k").collect()) == dict(zip(keys, [*keys[1:], None], strict=True))


def test_store(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/s")
    rows_ = spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string")
    store.write(rows_, 7, 1, expected_keys=2)
    store.write(rows_.withColumn("value", F.lit("9")), 7, 2)
    assert store.read(7, 1).orderBy("key").collect() == [("a", "1"), ("b", "2")]
    assert {r["value"] for r in store.read(7).collect()} == {"9"}
    with pytest.raises(FileExistsError):
        store.write(rows_, 7, 2)
    with pytest.raises(ValueError):
        store.write(rows_.unionAll(rows_), 8, 1)
    with pytest.raises(FileNotFoundError):
        store.read(8)


def test_stream(spark, tmp_path):
    log(spark, [("c", 2, None, 2), ("c", 2, None, 3), ("a", 0, "1", None)]).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark.readStream.schema(m.LOG).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    assert rows(replayed(spark, f"{tmp_path}/log")) == [("a", 0, "1", None), ("c", 2, None, 5)]
    assert rows(replayed(spark, f"{tmp_path}/log", after=0)) == [("a", 0, "1", None), ("c", 2, None, 3)]


def test_dictionaries(spark):
    uses = spark.createDataFrame([(21, 1), (22, 2), (21, 3), (23, 4)], "dict_id int, at int")
    assert [r["dict_id"] for r in dictionary.survivors(uses, "dict_id", "at", 2).collect()] == [23, 21]
    s = spark.createDataFrame([(2, "cd"), (1, "ab"), (3, ""), (4, "ef")], "o int, s string")
    assert bytes(dictionary.history(s, "o", "s", 5).first()[0]) == b"abcde"
    wide = spark.createDataFrame([(1, "日本"), (2, "語é")], "o int, s string")
    assert bytes(dictionary.history(wide, "o", "s", 8).first()[0]) == "日本語".encode()[:8]


def test_trained_dictionaries(spark):
    said = [(i, f'{{"tenant": "t{i % 7}", "region": "eu-{i % 3}", "state": "active", "count": {i * 37}}}') for i in range(3000)]
    e = spark.createDataFrame(said, "id bigint, s string")
    d = dictionary.trained(e, "id", "s", 3, 2048)
    assert d.raw[:4] == (0xEC30A437).to_bytes(4, "little") and len(d.raw) <= 2048  # a trained dictionary, not raw history
    few = dictionary.trained(e.limit(2), "id", "s", 4, 64)
    assert few.raw == "".join(x for _, x in said[:2]).encode()[:64]
    rows_ = e.select("id", F.when(F.col("id") % 2 == 0, 3).otherwise(4).alias("d"), F.when(F.col("id") != 5, F.col("s")).alias("s"))
    packed = dictionary.compressed(rows_, "d", "s", [d, few])
    back = {r["id"]: r["s"] for r in dictionary.decompressed(packed, "d", "s", [d, few]).collect()}
    assert back == {i: None if i == 5 else bytearray(x.encode()) for i, x in said}
    size = {r["d"]: r["n"] for r in packed.groupBy("d").agg(F.sum(F.octet_length("s")).alias("n")).collect()}
    assert size[3] < 0.6 * sum(len(x) for i, x in said if i % 2 == 0)
    with pytest.raises(Exception, match="KeyError"):
        dictionary.compressed(rows_, "d", "s", [d]).collect()


def test_route(spark):
    leaves = [(i * 3, f"k{i:05d}") for i in range(4000)]
    keys = ["a", "k00000", "k00000x", "k02999", "k03999", "z", None]
    got = [r["leaf_id"] for r in leaf.route(spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1), "key", leaves).collect()]
    assert got == [None, 0, 0, 2999 * 3, 3999 * 3, 3999 * 3, None]
    numbers = leaf.route(spark.range(-2, 30), "id", [(7, 0), (8, 10), (9, 20)]).collect()
    assert {r["id"]: r["leaf_id"] for r in numbers} == {i: None if i < 0 else 7 + i // 10 if i < 30 else 9 for i in range(-2, 30)}
