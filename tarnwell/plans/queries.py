"""Queries over the driver's tables, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import mutations as m
from tarnwell.operators import blocks, buffer, dictionary, leaf, segment
from tarnwell.sources import segfile
from tarnwell.sources.store import SegmentStore
from tarnwell.streaming.ingest import ingest, replayed
from tarnwell.streaming.tree import Tree, row_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_of(spark: SparkSession, sf_dir: str, numeric: bool = False) -> DataFrame:
    """events as mutations: purchases put (props, or cents), errors delete, the others count cents."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    kind = F.when(F.col("event_type") == "purchase", m.PUT).when(F.col("event_type") == "error", m.DELETE).otherwise(m.INC)
    said = cents.cast("string") if numeric else F.col("props")
    rows = e.select(F.format_string("user:%08d", "user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), said.alias("said"), cents.alias("cents"))
    return rows.select("key", "seq", "kind", F.when(F.col("kind") == m.PUT, F.col("said")).alias("payload"), F.when(F.col("kind") == m.INC, F.col("cents")).alias("delta"))


def buffer_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal buffer of events."""
    return m.coalesced(log_of(spark, sf_dir))


_CENTS = "round(value * 100)::BIGINT"


def _log(numeric: bool = False) -> str:
    said = f"({_CENTS})::VARCHAR" if numeric else "props"
    return f"""log AS (SELECT printf('user:%08d', user_id) AS key, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END::INT AS kind,
  CASE WHEN event_type = 'purchase' THEN {said} END AS payload,
  CASE WHEN event_type NOT IN ('purchase', 'error') THEN {_CENTS} END AS delta FROM events)"""


_BUFFER = f"""{_log()}, reset AS (SELECT key, max(seq) FILTER (kind <> 2) AS reset, max(seq) AS last_seq FROM log GROUP BY key),
buf AS (SELECT l.key, max(l.kind) FILTER (l.seq = r.last_seq) AS kind,
  max(l.payload) FILTER (l.seq = r.last_seq AND l.kind = 0) AS payload,
  CASE WHEN max(l.kind) FILTER (l.seq = r.last_seq) = 2 THEN sum(l.delta) FILTER (l.kind = 2 AND (r.reset IS NULL OR l.seq > r.reset)) END::BIGINT AS delta,
  max(r.last_seq) AS last_seq FROM log l JOIN reset r ON l.key = r.key GROUP BY l.key)"""
_ALL = f"WITH {_BUFFER} SELECT key, kind, payload, delta, last_seq FROM buf"


@query(f"WITH {_log()} SELECT * FROM log")
def kv_mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log itself."""
    return m.checked(log_of(spark, sf_dir))


@query(f"WITH {_log()} SELECT kind, count(*) AS n, sum(delta)::BIGINT AS total FROM log GROUP BY kind")
def kv_op_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations and deltas by kind."""
    return log_of(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum("delta").alias("total"))


@query(_ALL)
def kv_buffer_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One current operation per key, in two combined passes."""
    return buffer_of(spark, sf_dir)


@query(_ALL)
def kv_buffer_coalesce_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one shuffle."""
    return m.coalesced_by_window(log_of(spark, sf_dir))


@query(
    f"""WITH {_log(True)}, reset AS (SELECT key, max(seq) FILTER (kind <> 2) AS reset, max(seq) AS last_seq FROM log GROUP BY key),
one AS (SELECT l.key, any_value(r.reset) AS reset, max(r.last_seq) AS last_seq, max(l.kind) FILTER (l.seq = r.reset) AS base,
  max(l.payload) FILTER (l.seq = r.reset) AS value, sum(l.delta) FILTER (r.reset IS NULL OR l.seq > r.reset)::BIGINT AS added
  FROM log l JOIN reset r ON l.key = r.key GROUP BY l.key)
SELECT key, CASE WHEN base IS NULL THEN 2 WHEN added IS NOT NULL THEN 0 ELSE base END AS kind,
  CASE WHEN base IS NULL THEN NULL WHEN added IS NOT NULL THEN (CASE WHEN base = 0 THEN value::BIGINT ELSE 0 END + added)::VARCHAR WHEN base = 0 THEN value END AS payload,
  CASE WHEN base IS NULL THEN added END AS delta, last_seq FROM one"""
)
def kv_buffer_coalesce_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments applied to what they follow."""
    return m.coalesced(log_of(spark, sf_dir, numeric=True), "sequential")


@query(f"WITH {_log()} SELECT count(DISTINCT key) AS n_keys FROM log")
def kv_buffer_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique keys."""
    return buffer.size(log_of(spark, sf_dir))


@query(_ALL + " WHERE key = 'user:00000001'")
def kv_read_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation of a key."""
    return buffer.read(buffer_of(spark, sf_dir), "user:00000001")


@query(f"WITH {_BUFFER} SELECT key, payload AS value FROM buf WHERE key = 'user:00000000' AND kind = 0")
def kv_get_put_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of a key that was put."""
    return buffer.get(buffer_of(spark, sf_dir), "user:00000000")


@query(f"WITH {_BUFFER} SELECT key, payload AS value FROM buf WHERE key = 'user:00000001' AND kind = 0")
def kv_get_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter has no value."""
    return buffer.get(buffer_of(spark, sf_dir), "user:00000001")


@query(_ALL + " ORDER BY key")
def kv_iter_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations in key order."""
    return buffer.scan(buffer_of(spark, sf_dir))


@query(_ALL + " ORDER BY key LIMIT 100")
def kv_iter_first_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first operations in key order."""
    return buffer.scan(buffer_of(spark, sf_dir), 100)


@query(f"WITH {_BUFFER}, k AS (SELECT DISTINCT printf('user:%08d', c_custkey) AS key FROM customer) SELECT k.key, kind, payload, delta, last_seq FROM k LEFT JOIN buf ON k.key = buf.key")
def kv_batch_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys at once, also those that aren't there."""
    keys = table(spark, sf_dir, "customer").select(F.format_string("user:%08d", "c_custkey").alias("key")).distinct()
    return buffer.read_many(buffer_of(spark, sf_dir), keys)


@query(f"WITH {_BUFFER} SELECT key, last_seq FROM buf WHERE kind = 1")
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that end deleted."""
    return buffer_of(spark, sf_dir).where(F.col("kind") == m.DELETE).select("key", "last_seq")


@query(f"WITH {_BUFFER.replace('FROM events)', 'FROM events WHERE event_id > 500)')} SELECT key, kind, payload, delta, last_seq FROM buf")
def wal_replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffer of what came after a watermark."""
    return m.coalesced(log_of(spark, sf_dir).where("seq > 500"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"


@query(f"{_O} WHERE o_orderkey = 100")
def seg_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by key."""
    return _orders(spark, sf_dir).where("o_orderkey = 100")


@query(f"{_O} WHERE o_orderkey = -1")
def seg_point_get_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that isn't there."""
    return _orders(spark, sf_dir).where("o_orderkey = -1")


@query(f"{_O} ORDER BY o_orderkey LIMIT 1")
def seg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least key."""
    return segment.first(_orders(spark, sf_dir), "o_orderkey")


@query(f"{_O} WHERE o_orderkey >= 77 ORDER BY o_orderkey LIMIT 1")
def seg_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key at or after a target."""
    return segment.seek(_orders(spark, sf_dir), "o_orderkey", 77)


@query("SELECT o_orderkey AS key, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next_key FROM orders")
def seg_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key and the next."""
    return segment.following(_orders(spark, sf_dir), "o_orderkey")


@query("SELECT t.target, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= t.target) AS found FROM (SELECT DISTINCT l_partkey * 7 AS target FROM lineitem) t")
def seg_seek_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key at or after each of many targets."""
    return segment.seek_many(_orders(spark, sf_dir), "o_orderkey", table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 7).alias("target")))


@query(f"{_O} WHERE o_orderkey >= 1000 AND o_orderkey < 2000")
def seg_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a range."""
    return segment.between(_orders(spark, sf_dir), "o_orderkey", 1000, 2000)


@query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1")
def seg_order_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that break the strict order: none."""
    return segment.repeated_keys(_orders(spark, sf_dir), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def seg_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a segment of lineitem couldn't hold."""
    return segment.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.select(F.floor(F.col("o_orderkey") / 500).alias("segment"), F.format_string("order:%012d", "o_orderkey").alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("value"))


_ENTRIES = """e AS (SELECT o_orderkey // 500 AS segment, printf('order:%012d', o_orderkey) AS key, concat_ws('|', o_orderstatus, o_orderpriority) AS value FROM orders),
s AS (SELECT segment, key, (strlen(key) + strlen(value) + 12)::BIGINT AS bytes, row_number() OVER (PARTITION BY segment ORDER BY key) AS rn FROM e)"""
_PACKED = f"""WITH RECURSIVE {_ENTRIES}, p AS (
  SELECT segment, key, bytes, rn, 0::BIGINT AS block, 16 + bytes AS size FROM s WHERE rn = 1
  UNION ALL SELECT s.segment, s.key, s.bytes, s.rn, p.block + CASE WHEN p.size + s.bytes > 4096 THEN 1 ELSE 0 END,
    CASE WHEN p.size + s.bytes > 4096 THEN 16 + s.bytes ELSE p.size + s.bytes END FROM p JOIN s ON s.segment = p.segment AND s.rn = p.rn + 1)"""
_INDEX = f"""{_PACKED}, b AS (SELECT segment, block, max(key) AS separator, count(*) AS n_entries, (sum(bytes) + 16)::BIGINT AS length FROM p GROUP BY segment, block),
i AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY segment ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM b)"""


@query("SELECT o_orderkey // 500 AS segment, 1::BIGINT AS version, printf('order:%012d', o_orderkey) AS key, concat_ws('|', o_orderstatus, o_orderpriority) AS value FROM orders")
def seg_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written to segment files and read back."""
    root = segfile.shared_folder(spark)
    segfile.write_segments(_entries(spark, sf_dir), root, 1)
    return segfile.read_segments(spark, root).withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


@query(f"{_INDEX} SELECT segment, count(*)::INT AS n_blocks, sum(n_entries)::BIGINT AS n_entries FROM i GROUP BY segment")
def seg_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and entries of each segment file."""
    return segfile.write_segments(_entries(spark, sf_dir), segfile.shared_folder(spark), 1).select("segment", "n_blocks", "n_entries")


@query(f"{_PACKED} SELECT segment, key, bytes, block FROM p")
def seg_block_pack_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries filled into blocks, segment by segment."""
    return blocks.packed(_entries(spark, sf_dir))


@query(f'{_INDEX} SELECT segment, block, separator, n_entries, length, "offset" FROM i')
def seg_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index over those blocks."""
    return blocks.index(blocks.packed(_entries(spark, sf_dir)))


@query(f"{_INDEX} SELECT segment, block, separator, n_entries, length, \"offset\" FROM i WHERE segment = 2 AND separator >= 'order:000000001250' ORDER BY separator LIMIT 1")
def seg_find_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that may hold a key."""
    return blocks.find_block(blocks.index(blocks.packed(_entries(spark, sf_dir))), 2, "order:000000001250")


@query(f"WITH {_ENTRIES} SELECT segment, (16 + sum(bytes))::BIGINT AS encoded_len FROM s GROUP BY segment")
def seg_encoded_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each segment as one block."""
    return _entries(spark, sf_dir).groupBy("segment").agg((F.sum(blocks.entry_bytes(F.col("key"), F.col("value"))) + blocks.HEAD).cast("bigint").alias("encoded_len"))


@query(
    """WITH c AS (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT flag, n, (ceil(ceil(greatest(-n * ln(0.01::DOUBLE) / pow(ln(2::DOUBLE), 2), 64)) / 8) * 8)::BIGINT AS bits,
  greatest(1, least(30, round(greatest(-n * ln(0.01::DOUBLE) / pow(ln(2::DOUBLE), 2), 64) / n * ln(2::DOUBLE))::INT))::INT AS hashes FROM c"""
)
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of membership filters."""
    return blocks.bloom_sizing(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")), "n")


@query("SELECT DISTINCT l_orderkey AS key, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS present FROM lineitem")
def bloom_membership_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, as a filter that is checked again gives it."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    there = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.lit(True).alias("there"))
    return keys.join(there, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("present"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.format_string("user:%08d", F.col("c_custkey")).alias("key"), F.lit(None).cast("string").alias("value"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("counter"))


_RESOLVED = f"""WITH {_BUFFER}, base AS (SELECT printf('user:%08d', c_custkey) AS key, NULL::VARCHAR AS value, round(c_acctbal * 100)::BIGINT AS counter FROM customer),
leaf AS (SELECT coalesce(b.key, s.key) AS key, CASE WHEN b.kind IS NULL THEN s.value WHEN b.kind = 0 THEN b.payload END AS value,
  CASE WHEN b.kind IS NULL THEN s.counter WHEN b.kind = 2 THEN coalesce(s.counter, 0) + b.delta END AS counter
  FROM base s FULL JOIN buf b ON s.key = b.key WHERE b.kind IS NULL OR b.kind <> 1) SELECT * FROM leaf"""


@query(_RESOLVED)
def leaf_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of a segment."""
    return leaf.resolved(buffer_of(spark, sf_dir), _base(spark, sf_dir))


@query(_RESOLVED + " WHERE key IN ('user:00000000', 'user:00000001', 'user:00000002', 'user:00000700', 'none')")
def leaf_resolve_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some keys through buffer and segment."""
    keys = spark.createDataFrame([(k,) for k in ("user:00000000", "user:00000001", "user:00000002", "user:00000700", "none")], "key string")
    return leaf.read(buffer_of(spark, sf_dir), _base(spark, sf_dir), keys)


LEAVES = [(0, 0), (1, 1000), (2, 4000), (3, 9000)]
_LEAF = "CASE WHEN o_orderkey >= 9000 THEN 3 WHEN o_orderkey >= 4000 THEN 2 WHEN o_orderkey >= 1000 THEN 1 WHEN o_orderkey >= 0 THEN 0 END::INT AS leaf_id"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", (F.octet_length("o_orderpriority") + 20).cast("bigint").alias("nbytes"))
    return leaf.route(rows, "o_orderkey", LEAVES)


_ROUTED = f"r AS (SELECT o_orderkey, (strlen(o_orderpriority) + 20)::BIGINT AS nbytes, {_LEAF} FROM orders), z AS (SELECT leaf_id, count(*) AS n_rows, sum(nbytes)::BIGINT AS bytes FROM r GROUP BY leaf_id)"


@query(f"WITH {_ROUTED} SELECT * FROM r")
def leaf_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's leaf."""
    return _routed(spark, sf_dir)


@query(f"WITH {_ROUTED} SELECT * FROM z")
def leaf_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of leaves."""
    return leaf.sizes(_routed(spark, sf_dir), "nbytes")


# the checksums of the leaf ids 0 to 3 stand in the oracle, which has no such function
_CRC = "CASE leaf_id WHEN 0 THEN 4108050209 WHEN 1 THEN 2212294583 WHEN 2 THEN 450215437 ELSE 1842515611 END"


@query(f"WITH {_ROUTED} SELECT *, 60000 + {_CRC} % 10000 AS threshold FROM z WHERE bytes > 60000 + {_CRC} % 10000")
def leaf_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves past their thresholds."""
    return leaf.merge_candidates(leaf.sizes(_routed(spark, sf_dir), "nbytes"), 60_000, 10_000)


@query(
    f"""WITH {_ROUTED}, a AS (SELECT leaf_id, o_orderkey, sum(nbytes) OVER (PARTITION BY leaf_id ORDER BY o_orderkey) AS upto, sum(nbytes) OVER (PARTITION BY leaf_id) AS whole FROM r)
SELECT leaf_id, min(o_orderkey) AS split_key FROM a WHERE upto * 2 >= whole GROUP BY leaf_id"""
)
def leaf_split_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where leaves would split."""
    return leaf.split_points(_routed(spark, sf_dir), "o_orderkey", "nbytes")


@query("SELECT event_id, props FROM events WHERE strlen(props) > 0")
def dict_training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that aren't empty."""
    return table(spark, sf_dir, "events").where(F.octet_length("props") > 0).select("event_id", "props")


@query("SELECT substr(string_agg(props, '' ORDER BY event_id), 1, 65536) AS history FROM (SELECT event_id, props FROM events WHERE strlen(props) > 0 ORDER BY event_id LIMIT 65536)")
def dict_history_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dictionary is trained on where samples are few; props have one byte a character."""
    return dictionary.history(table(spark, sf_dir, "events"), "event_id", "props").select(F.col("history").cast("string").alias("history"))


@query("SELECT user_id AS dict_id, max(event_id) AS last_use FROM events GROUP BY user_id ORDER BY last_use DESC, dict_id LIMIT 16")
def dict_lru_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry of 16 still holds."""
    return dictionary.survivors(table(spark, sf_dir, "events"), "user_id", "event_id", 16)


@query("SELECT DISTINCT user_id AS dict_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dict_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries that nothing names."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("dict_id")).distinct()
    return dictionary.unused(ids, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("dict_id")))


@query("SELECT event_id, coalesce(strlen(props), 0)::BIGINT AS raw_len, true AS same FROM events")
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression with trained dictionaries, one for each of three groups of users, and back."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3 + 1).cast("int").alias("dict_id"), F.coalesce("props", F.lit("")).cast("binary").alias("said"))
    dictionaries = [dictionary.trained(e.where(F.col("dict_id") == i), "event_id", "said", i, 4096) for i in (1, 2, 3)]
    packed = dictionary.compressed(e.withColumn("raw", F.col("said")), "dict_id", "said", dictionaries)
    back = dictionary.decompressed(packed, "dict_id", "said", dictionaries)
    return back.select("event_id", F.octet_length("raw").cast("bigint").alias("raw_len"), (F.col("raw") == F.col("said")).alias("same"))


@query("SELECT DISTINCT o_orderkey // 100 AS leaf_id, (o_orderkey // 100 // 16 + 1)::INT AS dict_id FROM orders")
def dict_leaf_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of each leaf: one for sixteen leaves beside each other."""
    leaves = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("leaf_id")).distinct()
    return leaves.select("leaf_id", dictionary.group_of(F.col("leaf_id")).alias("dict_id"))


def _trained(spark: SparkSession, sf_dir: str) -> segfile.Dictionary:
    return dictionary.trained(_entries(spark, sf_dir), "key", "value", 7, 1024)


_WANTED = "w AS (SELECT o_orderkey // 500 AS segment, printf('order:%012d', o_orderkey) AS key FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey // 500, printf('other:%012d', o_orderkey) FROM orders WHERE o_orderkey % 7 = 1)"
_SEGMENT = "segment_files AS (SELECT o_orderkey // 500 AS segment, printf('order:%012d', o_orderkey) AS key, concat_ws('|', o_orderstatus, o_orderpriority) AS value FROM orders)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.floor(F.col("o_orderkey") / 500).alias("segment"), "o_orderkey")
    there = o.where("o_orderkey % 7 = 0").select("segment", F.format_string("order:%012d", "o_orderkey").alias("key"))
    return there.unionAll(o.where("o_orderkey % 7 = 1").select("segment", F.format_string("other:%012d", "o_orderkey").alias("key")))


def _strings(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


@query(f"WITH {_WANTED}, {_SEGMENT} SELECT s.segment, 1::BIGINT AS version, s.key, s.value FROM w JOIN segment_files s ON s.segment = w.segment AND s.key = w.key")
def seg_file_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of compressed segment files, through filter, index and one block each; those that aren't there are left out."""
    root, d = segfile.shared_folder(spark), _trained(spark, sf_dir)
    segfile.write_segments(_entries(spark, sf_dir), root, 1, dictionary=d)
    return _strings(segfile.lookup(spark, root, _wanted(spark, sf_dir), [d]))


@query(f"WITH {_SEGMENT} SELECT segment, CASE WHEN segment % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version, key, CASE WHEN segment % 2 = 0 THEN value || '+' ELSE value END AS value FROM segment_files WHERE key >= 'order:000000000450' AND key < 'order:000000001100'")
def seg_file_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of keys in the latest versions of compressed segment files; every second segment has two."""
    root, e, d = segfile.shared_folder(spark), _entries(spark, sf_dir), _trained(spark, sf_dir)
    segfile.write_segments(e, root, 1, dictionary=d)
    segfile.write_segments(e.where("segment % 2 = 0").withColumn("value", F.concat("value", F.lit("+"))), root, 2, dictionary=d)
    return _strings(segfile.read_segments(spark, root, [d], b"order:000000000450", b"order:000000001100", latest=True))


@query(f"WITH {_WANTED}, {_SEGMENT} SELECT w.segment, w.key, s.key IS NOT NULL AS present FROM w LEFT JOIN segment_files s ON s.segment = w.segment AND s.key = w.key")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by segment files' filters; what they let through is checked in the files."""
    root = segfile.shared_folder(spark)
    segfile.write_segments(_entries(spark, sf_dir), root, 1)
    return segfile.membership(spark, root, _wanted(spark, sf_dir)).select("segment", F.col("key").cast("string").alias("key"), "present")


@query("SELECT printf('user:%08d', c_custkey) AS key, c_name || '!' AS value, 2::BIGINT AS versions FROM customer WHERE c_custkey % 3 > 0")
def seg_store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of a segment's versions in a store, and how many there are."""
    store, c = SegmentStore(spark, segfile.shared_folder(spark)), table(spark, sf_dir, "customer")
    rows = c.select(F.format_string("user:%08d", "c_custkey").alias("key"), F.col("c_name").alias("value"), "c_custkey")
    n = rows.count()
    store.write(rows.select("key", "value"), 1, 1, n)
    store.write(rows.where("c_custkey % 3 > 0").select("key", F.concat("value", F.lit("!")).alias("value")), 1, 2, n)
    return store.read(1).select("key", "value", F.lit(store.manifest().where("segment_id = 1").count()).cast("bigint").alias("versions"))


@query(_ALL)
def stream_ingest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of mutations, logged batch by batch and replayed to a buffer; a second run adds nothing."""
    root = segfile.shared_folder(spark)
    log_of(spark, sf_dir).write.parquet(f"{root}/in")
    for _ in range(2):
        ingest(spark.readStream.schema(m.LOG).option("maxFilesPerTrigger", 8).parquet(f"{root}/in"), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return replayed(spark, f"{root}/log")


_HALF = 500
_FIRST = _RESOLVED.replace("FROM events)", f"FROM events WHERE event_id <= {_HALF})")
_SECOND = _RESOLVED.replace("FROM events)", f"FROM events WHERE event_id > {_HALF})").replace("base AS (SELECT printf('user:%08d', c_custkey) AS key, NULL::VARCHAR AS value, round(c_acctbal * 100)::BIGINT AS counter FROM customer)", f"base AS ({_FIRST})")


def _tree(spark: SparkSession, sf_dir: str) -> Tree:
    """customers as the first segment, the first events merged into it and the leaf split, the others in the log."""
    tree, log = Tree(spark, segfile.shared_folder(spark)), log_of(spark, sf_dir)
    tree.load(_base(spark, sf_dir))
    tree.append(log.where(F.col("seq") <= _HALF))
    tree.merge(split_bytes=1000)
    tree.truncate()
    tree.append(log.where(F.col("seq") > _HALF))
    return tree


@query(_SECOND)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys after a merge that committed and split, through what is in the log since; read by one that opens the root anew."""
    return Tree(spark, _tree(spark, sf_dir).root).scan()


@query(f"SELECT * FROM ({_SECOND}) WHERE key IN ('user:00000000', 'user:00000001', 'user:00000700', 'none')")
def tree_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some keys of that tree."""
    keys = spark.createDataFrame([(k,) for k in ("user:00000000", "user:00000001", "user:00000700", "none")], "key string")
    return _tree(spark, sf_dir).read(keys)


@query(
    f"""WITH l AS ({_FIRST}), r AS (SELECT key, (strlen(key) + coalesce(strlen(value), 0) + 8)::BIGINT AS nbytes FROM l),
a AS (SELECT key, nbytes, sum(nbytes) OVER (ORDER BY key) AS upto, sum(nbytes) OVER () AS whole FROM r), c AS (SELECT min(key) AS cut FROM a WHERE upto * 2 >= whole)
SELECT CASE WHEN key < cut THEN 1 ELSE 2 END::INT AS leaf_id, count(*) AS n_rows, sum(nbytes)::BIGINT AS bytes, min(key) AS least FROM r, c GROUP BY ALL"""
)
def tree_split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves that a split merge makes: their rows, bytes and least keys."""
    tree = _tree(spark, sf_dir)
    leaves = [(x["leaf_id"], x["low"]) for x in tree.state()["leaves"]]
    rows = leaf.route(tree.segment(), "key", leaves).withColumn("nbytes", row_bytes())
    return rows.groupBy("leaf_id").agg(F.count("*").alias("n_rows"), F.sum("nbytes").alias("bytes"), F.min("key").alias("least"))


@query("WITH t AS (SELECT DISTINCT printf('user:%08d', user_id * 11 + 3) AS target FROM events), k AS (SELECT printf('user:%08d', c_custkey * 5) AS key FROM customer) SELECT target, (SELECT min(key) FROM k WHERE key >= target) AS found FROM t")
def seg_seek_many_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text key at or after each of many targets."""
    keys = table(spark, sf_dir, "customer").select(F.format_string("user:%08d", F.col("c_custkey") * 5).alias("key"))
    return segment.seek_many(keys, "key", table(spark, sf_dir, "events").select(F.format_string("user:%08d", F.col("user_id") * 11 + 3).alias("target")))


@query("SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM (SELECT printf('user:%08d', c_custkey) AS key FROM customer)")
def seg_next_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text key and the next."""
    return segment.following(table(spark, sf_dir, "customer").select(F.format_string("user:%08d", "c_custkey").alias("key")), "key")
