"""The tree of leaves against a plain fold: appends, merges, splits, recovery, and writers that meet."""

import random

import pytest

from tarnwell.functions import mutations as m
from tarnwell.operators import segment
from tarnwell.sources import segfile, shared
from tarnwell.sources.store import SegmentStore
from tarnwell.streaming.tree import SEGMENT, Tree


def said(df):
    return {r["key"]: (r["value"], r["counter"]) for r in df.collect()}


class Plain:
    """Buffer over base, by the literal rules."""

    def __init__(self, base):
        self.base, self.ops = dict(base), {}

    def apply(self, key, kind, payload, delta):
        was = self.ops.get(key)
        self.ops[key] = (2, None, was[2] + delta) if kind == 2 and was and was[0] == 2 else (kind, payload, delta)

    def resolved(self, own=lambda k: True):
        out = dict(self.base)
        for k, (kind, payload, delta) in self.ops.items():
            if own(k):
                out.pop(k, None)
                if kind == 0:
                    out[k] = (payload, None)
                elif kind == 2:
                    out[k] = (None if k not in self.base else self.base[k][0], (self.base.get(k, (None, None))[1] or 0) + delta)
                    out[k] = (None, out[k][1])
        return out

    def merge(self, own=lambda k: True):
        self.base = self.resolved(own)
        self.ops = {k: v for k, v in self.ops.items() if not own(k)}


def batch(spark, plain, r, seq, n):
    rows = []
    for i in range(n):
        kind = r.choice([0, 1, 2, 2])
        rows.append((f"k{r.randrange(60):03}", seq + i, kind, str(i) if kind == 0 else None, r.randrange(9) if kind == 2 else None))
        plain.apply(rows[-1][0], *rows[-1][2:])
    return spark.createDataFrame(rows, m.LOG)


def test_merges_and_splits(spark, tmp_path):
    r, root = random.Random(1), f"file://{tmp_path}/t"
    base = {f"k{i:03}": (None, i) for i in range(0, 60, 2)}
    plain, tree = Plain(base), Tree(spark, root)
    tree.load(spark.createDataFrame([(k, *v) for k, v in base.items()], SEGMENT))
    tree.append(batch(spark, plain, r, 0, 80))
    assert said(tree.scan()) == plain.resolved()
    state = tree.merge(split_bytes=200)
    plain.merge()
    assert len(state["leaves"]) == 2 and {x["leaf_id"] for x in state["leaves"]} == {1, 2}
    assert said(tree.segment()) == plain.base == said(tree.scan()) and tree.log().count() == 0 and tree.truncate() == 1
    low = state["leaves"][1]["low"]
    assert said(tree.segment({1})) == {k: v for k, v in plain.base.items() if k < low} and said(tree.segment({2})) == {k: v for k, v in plain.base.items() if k >= low}
    # a merge of one leaf leaves the other's mutations in the log; whoever opens the root anew finds all of it
    tree.append(batch(spark, plain, r, 100, 80))
    tree.merge({2})
    plain.merge(lambda k: k >= low)
    again = Tree(spark, root)
    assert said(again.scan()) == plain.resolved() and again.truncate() == 0 and said(again.segment()) == plain.base
    keys = spark.createDataFrame([("k001",), ("k002",), ("none",)], "key string")
    assert said(again.read(keys)) == {k: v for k, v in plain.resolved().items() if k in ("k001", "k002")}
    assert {x["leaf_id"] for x in again.candidates(1).collect()} == {1}
    with pytest.raises(Exception, match="watermark"):
        again.append(spark.createDataFrame([(low, 5, 0, "x", None)], m.LOG))


def test_writers_that_meet(spark, tmp_path):
    one, two = (Tree(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.append(spark.createDataFrame([("a", 1, 0, "x", None)], m.LOG))
    state = two.state
    old = state()
    one.merge()
    two.state = lambda: old
    with pytest.raises(FileExistsError):  # what it wrote is never seen
        two.merge()
    two.state = state
    assert said(two.scan()) == {"a": ("x", None)} and two.state()["number"] == 1
    empty = Tree(spark, f"file://{tmp_path}/e")
    assert empty.scan().count() == 0 and empty.merge()["number"] == 1 and empty.scan().count() == 0
    with pytest.raises(FileExistsError):
        shared.create_once(spark, f"file://{tmp_path}/t/state/{1:020d}.json", "{}")


def test_segment_files_by_key(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    rows = [(i % 4 + 1, f"k{i:05d}", f"v{i}") for i in range(4000)]
    kind = "segment bigint, key string, value string"
    d = segfile.Dictionary(9, b"v1v2v3v4v5v6")
    segfile.write_segments(spark.createDataFrame(rows, kind), root, 1, dictionary=d)
    segfile.write_segments(spark.createDataFrame([(2, f"k{i:05d}", "new") for i in range(1, 100, 4)], kind), root, 2, dictionary=d)
    now = {(s, k): v for s, k, v in rows if s != 2} | {(2, f"k{i:05d}"): "new" for i in range(1, 100, 4)}
    wanted = [(s, f"k{i:05d}") for s in (1, 2, 3, 9) for i in range(0, 4000, 7)]
    keys = spark.createDataFrame(wanted, "segment bigint, key string")
    got = {(r["segment"], bytes(r["key"]).decode()): bytes(r["value"]).decode() for r in segfile.lookup(spark, root, keys, [d]).collect()}
    assert got == {k: now[k] for k in wanted if k in now}
    maybe = {(r["segment"], bytes(r["key"]).decode()) for r in segfile.may_contain(spark, root, keys).where("maybe").collect()}
    assert got.keys() <= maybe and len(maybe) < len(got) + 0.1 * len(wanted)
    span = segfile.read_segments(spark, root, [d], b"k00050", b"k00150", latest=True)
    assert {(r["segment"], bytes(r["key"]).decode()): bytes(r["value"]).decode() for r in span.collect()} == {k: v for k, v in now.items() if "k00050" <= k[1] < "k00150"}
    # without its commit file a version isn't there
    shared.delete(spark, f"{root}/{segfile.commit_name(2)}")
    assert {r["version"] for r in segfile.read_segments(spark, root, [d], latest=True).collect()} == {1}


def test_seeks_of_text(spark):
    keys = sorted({f"{chr(97 + i % 26)}{i * 37 % 101}" for i in range(300)} | {"é", "日"})
    s = spark.createDataFrame([(k,) for k in keys], "k string")
    targets = [*keys[::3], "", "a", "m5x", "zzz", "ü", "𐍈"]
    got = {r["target"]: r["found"] for r in segment.seek_many(s, "k", spark.createDataFrame([(t,) for t in targets], "t string")).collect()}
    order = lambda x: x.encode()
    assert got == {t: next((k for k in sorted(keys, key=order) if order(k) >= order(t)), None) for t in targets}
    by = sorted(keys, key=order)
    assert {r["key"]: r["next_key"] for r in segment.following(s, "k").collect()} == dict(zip(by, [*by[1:], None], strict=True))


def test_store_commits_once(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string")
    assert store.manifest().count() == 0
    store.write(rows, 7, 1)
    store.write(rows, 8, 3)
    assert store.versions(7) == [1] and {(r["segment_id"], r["version"], r["n_rows"], r["min_key"]) for r in store.manifest().collect()} == {(7, 1, 2, "a"), (8, 3, 2, "a")}
    versions, store.versions = store.versions, lambda s: []
    with pytest.raises(FileExistsError):  # a writer that didn't see the other's
        store.write(rows, 7, 1)
    store.versions = versions
    with pytest.raises(ValueError):
        store.write(spark.createDataFrame([("", "2")], "key string, value string"), 9, 1)
    assert store.versions(9) == [] and store.read(7).count() == 2
