"""Segment and dictionary files in their byte format, and Spark's sink and source of whole folders of them.

A segment file is a header, blocks, a membership filter over all keys, a block index and a footer. All integers are
little-endian; checksums are CRC-32. A segment is one sorted stream, so it is written by one task that holds one block
and eight bytes a key; leaves are split before a segment outgrows that. Blocks may be compressed with a dictionary.

Defined cases: no entries give a file without blocks; empty values are kept, null values count as empty; empty, null,
repeated or unsorted keys raise, and so does every damaged or incomplete file.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.blocks import ENTRY, HEAD, TARGET, bloom_size
from tarnwell.sources.shared import create_once, exists, names, shared_folder, text_of  # noqa: F401

# Fixed values of the formats: magic and version of each part, sizes, kinds of compression, constants of the filter's hashes.
HEADER, BLOCK, BLOOM, FOOTER, DICTIONARY = b"FHDR", b"FBLK", b"FBLM", b"FFTR", b"FDDC"
VERSIONS = {HEADER: 3, BLOCK: 1, BLOOM: 1, FOOTER: 1, DICTIONARY: 1}
HEADER_BYTES, FOOTER_BYTES, DICTIONARY_BYTES = 28, 64, 24
RAW, ZSTD_DICTIONARY = 0, 1
GOLDEN = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

U64 = np.uint64
ROWS = 4096
Entry = tuple[bytes, bytes]


class DamagedFile(ValueError):
    """A file that isn't whole or doesn't follow its format."""


def _sealed(magic: bytes, body: bytes) -> bytes:
    data = magic + struct.pack("<I", VERSIONS[magic]) + body
    return data + struct.pack("<I", zlib.crc32(data))


def _unsealed(magic: bytes, data: bytes) -> bytes:
    if len(data) < 12 or data[:4] != magic or struct.unpack_from("<I", data, 4)[0] != VERSIONS[magic]:
        raise DamagedFile(f"not a {magic.decode()} part of a known version")
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise DamagedFile(f"wrong checksum of a {magic.decode()} part")
    return data[8:-4]


def _unpack(form: str, data: bytes, at: int = 0) -> tuple:
    try:
        return struct.unpack_from(form, data, at)
    except struct.error as e:
        raise DamagedFile("a part ends too early") from e


def _checked(key: bytes | None, last: bytes | None) -> bytes:
    if not key:
        raise ValueError("a key can't be empty")
    if last is not None and key <= last:
        raise ValueError("keys must strictly ascend")
    return key


def encode_block(entries: Iterable[Entry]) -> bytes:
    """A block of strictly ascending entries."""
    parts, offsets, at, last = [], [], 12, None
    for key, value in entries:
        last = _checked(key, last)
        parts.append(struct.pack("<II", len(key), len(value)) + key + value)
        offsets.append(at)
        at += len(parts[-1])
    return _sealed(BLOCK, struct.pack("<I", len(parts)) + b"".join(parts) + struct.pack(f"<{len(offsets)}I", *offsets))


def decode_block(data: bytes) -> list[Entry]:
    """The entries of a block; its offsets and order are checked."""
    body = _unsealed(BLOCK, data)
    (n,) = _unpack("<I", body)
    tail = len(body) - 4 * n
    if tail < 4:
        raise DamagedFile("a block holds fewer offsets than entries")
    entries, at, last = [], 4, None
    for offset in struct.unpack_from(f"<{n}I", body, tail):
        k, v = _unpack("<II", body[:tail], at)
        end = at + 8 + k + v
        if offset != at + 8 or end > tail:
            raise DamagedFile("an entry isn't where its offset says")
        key = body[at + 8 : at + 8 + k]
        if not key or (last is not None and key <= last):
            raise DamagedFile("keys of a block don't ascend")
        entries.append((key, body[at + 8 + k : end]))
        at, last = end, key
    if at != tail:
        raise DamagedFile("a block has bytes that no entry owns")
    return entries


class Place(NamedTuple):
    """A block in the index: its last key and where it lies in the data section."""

    separator: bytes
    offset: int
    length: int


def checked_index(places: list[Place]) -> list[Place]:
    """places, if no separator descends, no block is empty and none overlaps the one before; gaps are allowed."""
    for i, p in enumerate(places):
        before = places[i - 1] if i else Place(b"", 0, 0)
        if not p.separator or p.separator < before.separator or not p.length or p.offset < before.offset + before.length:
            raise DamagedFile("blocks of an index overlap, are empty or are out of order")
    return places


def encode_index(places: list[Place]) -> bytes:
    """The index section (it has neither magic nor checksum)."""
    return struct.pack("<I", len(places)) + b"".join(struct.pack("<I", len(p.separator)) + p.separator + struct.pack("<QI", p.offset, p.length) for p in checked_index(places))


def decode_index(data: bytes) -> list[Place]:
    """The blocks that an index section lists."""
    (n,), at, places = _unpack("<I", data), 4, []
    for _ in range(n):
        (size,) = _unpack("<I", data, at)
        places.append(Place(data[at + 4 : at + 4 + size], *_unpack("<QI", data, at + 4 + size)))
        at += size + 16
    if at != len(data):
        raise DamagedFile("an index has bytes after its last block")
    return checked_index(places)


def first_hashes(keys: list[bytes]) -> np.ndarray:
    """The first hash of each key."""
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), U64, len(keys))


def second_hash(h1: np.ndarray) -> np.ndarray:
    """The step between a key's bits, made of its first hash; never 0."""
    x = (h1 ^ U64(GOLDEN)) + U64(GOLDEN)
    for shift, factor in zip((30, 27), MIX, strict=True):
        x = (x ^ (x >> U64(shift))) * U64(factor)
    x ^= x >> U64(31)
    return np.where(x == 0, U64(GOLDEN), x)


class Bloom:
    """A membership filter without false negatives."""

    def __init__(self, bits: int, hashes: int, data: bytes | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def _at(self, h1: np.ndarray, i: int | np.ndarray) -> np.ndarray:
        return (h1 + np.asarray(i, U64) * second_hash(h1)) % U64(self.bits)

    def _places(self, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bits of keys, a row for each of the filter's hashes."""
        at = self._at(h1, np.arange(self.hashes)[:, None])
        return (at >> U64(3)).astype(np.int64), (at & U64(7)).astype(np.uint8)

    def add(self, h1: np.ndarray) -> None:
        """Add keys by their first hashes (XXH64 with seed 0)."""
        at, bit = self._places(h1)
        np.bitwise_or.at(self.data, at.ravel(), np.left_shift(np.uint8(1), bit.ravel()))

    def may_contain_each(self, h1: np.ndarray) -> np.ndarray:
        """For each key, by its first hash: false if it was never added."""
        at, bit = self._places(h1)
        return (self.data[at] >> bit & np.uint8(1)).all(axis=0)

    def may_contain(self, key: bytes) -> bool:
        """False: the key was never added."""
        return bool(self.may_contain_each(first_hashes([key]))[0])

    def encode(self) -> bytes:
        """The filter section."""
        return _sealed(BLOOM, struct.pack("<III", self.bits, self.hashes, len(self.data)) + self.data.tobytes())

    @staticmethod
    def decode(data: bytes) -> Bloom:
        """The filter of a section."""
        body = _unsealed(BLOOM, data)
        bits, hashes, size = _unpack("<III", body)
        if not bits or not 1 <= hashes <= 30 or size != -(-bits // 8) or len(body) != 12 + size:
            raise DamagedFile("a filter's sizes don't fit")
        return Bloom(bits, hashes, body[12:])


def encode_header(version: int, dict_id: int = 0) -> bytes:
    """The header; dict_id 0 means raw blocks."""
    return _sealed(HEADER, struct.pack("<QII", version, ZSTD_DICTIONARY if dict_id else RAW, dict_id))


def decode_header(data: bytes) -> tuple[int, int]:
    """version and dict_id."""
    if len(data) != HEADER_BYTES:
        raise DamagedFile("a header of a wrong size")
    version, kind, dict_id = _unpack("<QII", _unsealed(HEADER, data))
    if kind not in (RAW, ZSTD_DICTIONARY) or (kind == RAW) != (dict_id == 0):
        raise DamagedFile("compression and dictionary of a header disagree")
    return version, dict_id


class Footer(NamedTuple):
    """Number of blocks, and (offset, length) of the sections."""

    blocks: int
    data: tuple[int, int]
    bloom: tuple[int, int]
    index: tuple[int, int]


def encode_footer(f: Footer) -> bytes:
    """The footer."""
    return _sealed(FOOTER, struct.pack("<I6Q", f.blocks, *f.data, *f.bloom, *f.index))


def decode_footer(data: bytes) -> Footer:
    """The footer; its sections end within 64 bits."""
    if len(data) != FOOTER_BYTES:
        raise DamagedFile("a footer of a wrong size")
    blocks, *x = _unpack("<I6Q", _unsealed(FOOTER, data))
    sections = list(zip(x[::2], x[1::2], strict=True))
    if any(a + b >= 1 << 64 for a, b in sections):
        raise DamagedFile("a section ends past 64 bits")
    return Footer(blocks, *sections)


class Dictionary:
    """A compression dictionary; each block is a frame of its own."""

    def __init__(self, dict_id: int, raw: bytes, level: int = 3):
        if dict_id <= 0 or len(raw) < 8:
            raise ValueError("a dictionary needs an id above 0 and 8 bytes at least")
        self.id, self.raw, self.level = dict_id, raw, level or 3
        data = zstandard.ZstdCompressionDict(raw)
        self._pack, self._unpack = zstandard.ZstdCompressor(level=self.level, dict_data=data), zstandard.ZstdDecompressor(dict_data=data)

    def compress(self, data: bytes) -> bytes:
        """One frame."""
        return self._pack.compress(data)

    def decompress(self, data: bytes) -> bytes:
        """The bytes of a frame."""
        return self._unpack.decompress(data)

    def encode(self) -> bytes:
        """The dictionary file; the checksum covers the raw bytes."""
        return DICTIONARY + struct.pack("<5I", VERSIONS[DICTIONARY], self.id, self.level, len(self.raw), zlib.crc32(self.raw)) + self.raw

    @staticmethod
    def decode(data: bytes) -> Dictionary:
        """The dictionary of a whole file."""
        version, dict_id, level, size, crc = _unpack("<5I", data, 4)
        raw = data[DICTIONARY_BYTES:]
        if data[:4] != DICTIONARY or version != VERSIONS[DICTIONARY] or size != len(raw) or zlib.crc32(raw) != crc:
            raise DamagedFile("not a whole dictionary file")
        return Dictionary(dict_id, raw, level)


def write_atomically(path: str, data: bytes) -> None:
    """A file that is there whole or not at all, on a mounted file system."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
    at = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


class Registry:
    """Dictionaries by id: in memory, or in a mounted folder with those used last in memory (limit 0: all)."""

    def __init__(self, folder: str | None = None, limit: int = 0):
        self.folder, self.limit, self.held = folder, limit, OrderedDict()

    def path(self, dict_id: int) -> str:
        """The file of a dictionary."""
        return os.path.join(self.folder or "", f"dict-{dict_id:08d}.zdict")

    def _hold(self, d: Dictionary) -> Dictionary:
        self.held[d.id] = d
        self.held.move_to_end(d.id)
        while 0 < self.limit < len(self.held):
            self.held.popitem(last=False)
        return d

    def add(self, d: Dictionary) -> None:
        """Hold a dictionary; with a folder, write its file. An id that is held or has a file is refused."""
        if d.id in self.held or (self.folder and os.path.exists(self.path(d.id))):
            raise FileExistsError(f"dictionary {d.id}")
        if self.folder:
            write_atomically(self.path(d.id), d.encode())
        self._hold(d)

    def get(self, dict_id: int) -> Dictionary:
        """A dictionary, from its file if it isn't held; KeyError if there is none."""
        if dict_id in self.held:
            return self._hold(self.held[dict_id])
        if not self.folder or not os.path.exists(self.path(dict_id)):
            raise KeyError(dict_id)
        with open(self.path(dict_id), "rb") as f:
            d = Dictionary.decode(f.read())
        if d.id != dict_id:
            raise DamagedFile(f"the file of dictionary {dict_id} holds {d.id}")
        return self._hold(d)

    def compress(self, dict_id: int, data: bytes) -> bytes:
        """A frame by the dictionary with an id; KeyError if there is none."""
        return self.get(dict_id).compress(data)

    def decompress(self, dict_id: int, data: bytes) -> bytes:
        """The bytes of such a frame."""
        return self.get(dict_id).decompress(data)

    def close(self) -> None:
        """Hold nothing more; files stay."""
        self.held.clear()

    def remove(self, dict_id: int) -> None:
        """Hold a dictionary no more; its file stays."""
        self.held.pop(dict_id, None)


class SegmentWriter:
    """Writes one segment to a stream."""

    def __init__(self, out: BinaryIO, version: int, target: int = TARGET, rate: float = 0.01, dictionary: Dictionary | None = None):
        if target < HEAD + 4 or not 0 < rate < 1:
            raise ValueError("a block takes 20 bytes at least, and a filter a rate between 0 and 1")
        self.out, self.target, self.rate, self.dictionary = out, target, rate, dictionary
        self.places, self.block, self.size, self.last, self.at = [], [], HEAD, None, 0
        self.hashes = []
        out.write(encode_header(version, dictionary.id if dictionary else 0))

    def append(self, key: bytes, value: bytes) -> None:
        """Add an entry after the last one."""
        key = _checked(key, self.last)
        size = ENTRY + len(key) + len(value)
        if self.block and self.size + size > self.target:
            self._flush()
        self.block.append((key, value))
        self.size += size
        self.last = key
        if not self.hashes or len(self.hashes[-1]) == ROWS:
            self.hashes.append([])
        self.hashes[-1].append(xxhash.xxh64_intdigest(key))
        if len(self.hashes[-1]) == ROWS:
            self.hashes[-1] = np.array(self.hashes[-1], U64)

    def _flush(self) -> None:
        data = encode_block(self.block)
        if self.dictionary:
            data = self.dictionary.compress(data)
        self.out.write(data)
        self.places.append(Place(self.last, self.at, len(data)))
        self.at, self.block, self.size = self.at + len(data), [], HEAD

    def freeze(self) -> tuple[int, int]:
        """Write what follows the blocks; the numbers of blocks and of bytes."""
        if self.block:
            self._flush()
        bloom = Bloom(*bloom_size(sum(map(len, self.hashes)), self.rate))
        for part in self.hashes:
            bloom.add(np.asarray(part, U64))
        parts = [bloom.encode(), encode_index(self.places)]
        begins = [HEADER_BYTES, HEADER_BYTES + self.at, HEADER_BYTES + self.at + len(parts[0])]
        parts.append(encode_footer(Footer(len(self.places), *zip(begins, (self.at, *map(len, parts)), strict=True))))
        self.out.write(b"".join(parts))
        return len(self.places), HEADER_BYTES + self.at + sum(map(len, parts))


class SegmentReader:
    """Reads one segment from a file that can seek; holds its index and filter, and one block at a time."""

    def __init__(self, file: BinaryIO, registry: Registry | None = None, blocks: bool = True):
        """blocks: whether blocks will be read, which in a compressed segment takes a registry."""
        self.file = file
        size = file.seek(0, io.SEEK_END)
        if size < HEADER_BYTES + FOOTER_BYTES:
            raise DamagedFile("a file too short for a segment")
        self.version, self.dict_id = decode_header(self._bytes(0, HEADER_BYTES))
        self.footer = f = decode_footer(self._bytes(size - FOOTER_BYTES, FOOTER_BYTES))
        ends = [HEADER_BYTES, *(a + b for a, b in f[1:])]
        if [a for a, _ in f[1:]] != ends[:-1] or ends[-1] != size - FOOTER_BYTES:
            raise DamagedFile("sections don't follow each other up to the footer")
        self.bloom, self.index = Bloom.decode(self._bytes(*f.bloom)), decode_index(self._bytes(*f.index))
        if len(self.index) != f.blocks or (self.index and self.index[-1].offset + self.index[-1].length > f.data[1]):
            raise DamagedFile("index and footer disagree")
        if self.dict_id and registry is None and blocks:
            raise ValueError("a compressed segment needs a registry")
        self.dictionary = registry.get(self.dict_id) if self.dict_id and blocks else None

    def _bytes(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise DamagedFile("a file ends too early")
        return data

    def block(self, i: int) -> list[Entry]:
        """The entries of a block."""
        p = self.index[i]
        data = self._bytes(HEADER_BYTES + p.offset, p.length)
        return decode_block(self.dictionary.decompress(data) if self.dictionary else data)

    def get(self, key: bytes) -> bytes | None:
        """The value of a key, or None: filter, index, then one block."""
        if not self.bloom.may_contain(key):
            return None
        found = next(self.seek(key), None)
        return found[1] if found and found[0] == key else None

    def seek(self, target: bytes = b"") -> Iterator[Entry]:
        """Entries in key order from the first that isn't before target."""
        first = bisect_left(self.index, target, key=lambda p: p.separator)
        for i in range(first, len(self.index)):
            entries = self.block(i)
            yield from entries[bisect_left(entries, target, key=lambda e: e[0]) if i == first else 0 :]


def file_name(segment: int, version: int) -> str:
    """The name of a segment's file."""
    return f"segment-{segment:020d}-v{version:020d}.seg"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/+", uri):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


MANIFEST = "segment bigint, file string, n_blocks int, n_entries bigint, bytes bigint"


def write_segments(entries: DataFrame, root: str, version: int, target: int = TARGET, rate: float = 0.01, dictionary: Dictionary | None = None) -> DataFrame:
    """One file below root for each segment of (segment, key, value); a row for each: segment, file, n_blocks, n_entries, bytes.

    Tasks write under names of their own, so repeated attempts don't meet; files get their final names once all are whole, side by side, and
    a commit file that one writer alone can create makes the version visible. A version that is there already is refused.
    """
    spark, raw = entries.sparkSession, (dictionary.id, dictionary.raw, dictionary.level) if dictionary else None
    job = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        store.create_dir(f"{folder}/.{job}", recursive=True)
        codec, now, done = Dictionary(*raw) if raw else None, None, []

        def closed() -> None:
            blocks, size = now[1].freeze()
            now[2].close()
            done.append((now[0], now[3], blocks, now[4], size))

        for b in batches:
            for s, k, v in zip(b.column("segment").to_pylist(), b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True):
                if now is None or s != now[0]:
                    if now:
                        closed()
                    name = f".{job}/{uuid.uuid4().hex}.tmp"
                    out = store.open_output_stream(f"{folder}/{name}")
                    now = [s, SegmentWriter(out, version, target, rate, codec), out, name, 0]
                now[1].append(k, v)
                now[4] += 1
        if now:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["segment", "file", "n_blocks", "n_entries", "bytes"])

    rows = entries.select(F.col("segment").cast("bigint").alias("segment"), F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))
    if names(spark, root, commit_name(version)):
        raise FileExistsError(f"{root}/{commit_name(version)}")
    dealt = rows.repartition("segment").sortWithinPartitions("segment", "key")
    manifest = f"{root}/{manifest_name(version, job)}"
    dealt.mapInArrow(work, MANIFEST).write.parquet(manifest)
    whole = spark.read.schema(MANIFEST).parquet(manifest)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        for b in batches:
            for segment, file in zip(b.column("segment").to_pylist(), b.column("file").to_pylist(), strict=True):
                final = f"{folder}/{file_name(segment, version)}"
                # a task that runs again finds its own file renamed
                if store.get_file_info(f"{folder}/{file}").type != fs.FileType.NotFound:
                    store.move(f"{folder}/{file}", final)
                elif store.get_file_info(final).type == fs.FileType.NotFound:
                    raise FileNotFoundError(final)
            yield pa.RecordBatch.from_arrays([b.column("segment")], ["segment"])

    whole.select("segment", "file").mapInArrow(named, "segment bigint").count()
    create_once(spark, f"{root}/{commit_name(version)}", job)
    store, folder = _store(root)
    if store.get_file_info(f"{folder}/.{job}").type == fs.FileType.Directory:
        store.delete_dir(f"{folder}/.{job}")
    return whole.withColumn("file", F.format_string(f"segment-%020d-v{version:020d}.seg", "segment"))


def commit_name(version: int) -> str:
    """The name of the file that makes a version visible."""
    return f"_commit-{version:020d}"


def manifest_name(version: int, job: str) -> str:
    """The name of the folder that lists the files of a version; the version's commit file says which job's."""
    return f"_manifest-{version:020d}-{job}"


def segment_files(spark: SparkSession, root: str, latest: bool = False) -> DataFrame:
    """segment, version and path of the files of committed versions; of each segment's latest only, if asked for.

    They come from the manifests of those versions, so that neither the driver nor a job goes through the files.
    """
    commits = [x for x in names(spark, root, "_commit-*") if re.fullmatch(r"_commit-\d+", x)]
    if not commits and not exists(spark, root):
        raise FileNotFoundError(root)
    manifests = [f"{root}/{manifest_name(int(x[8:]), text_of(spark, f'{root}/{x}'))}" for x in commits]
    if manifests:
        version = F.regexp_extract("_metadata.file_path", r"_manifest-(\d+)-[^/]*/[^/]*$", 1).cast("bigint")
        files = spark.read.schema(MANIFEST).parquet(*manifests).select("segment", version.alias("version"))
    else:
        files = spark.createDataFrame([], "segment bigint, version bigint")
    if latest and len(manifests) > 1:
        files = files.groupBy("segment").agg(F.max("version").alias("version"))
    return files.withColumn("path", F.format_string("%s/segment-%020d-v%020d.seg", F.lit(root), "segment", "version"))


def _known(raws: list[tuple]) -> Registry:
    known = Registry()
    for x in raws:
        known.add(Dictionary(*x))
    return known


_ENTRIES = "segment bigint, version bigint, key binary, value binary"


def _rows(segment: int, version: int, entries: list[Entry]) -> pa.RecordBatch:
    keys, values = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([segment] * len(keys), pa.int64()), pa.array([version] * len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["segment", "version", "key", "value"])


def read_segments(spark: SparkSession, root: str, registry: list[Dictionary] | None = None, low: bytes = b"", high: bytes | None = None, latest: bool = False) -> DataFrame:
    """segment, version, key, value of the committed segment files below root, keys from low up to, without, high.

    Files are read beside each other, block by block; only blocks that the index says may hold keys of the range are read.
    """
    raws = [(d.id, d.raw, d.level) for d in registry or []]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(raws)
        for b in batches:
            for segment, uri in zip(b.column("segment").to_pylist(), b.column("path").to_pylist(), strict=True):
                store, path = _store(uri)
                with store.open_input_file(path) as file:
                    reader = SegmentReader(file, known)
                    for i in range(bisect_left(reader.index, low, key=lambda p: p.separator), len(reader.index)):
                        entries = [e for e in reader.block(i) if e[0] >= low and (high is None or e[0] < high)]
                        if entries:
                            yield _rows(segment, reader.version, entries)
                        if high is not None and reader.index[i].separator >= high:
                            break

    # dealt anew, as what the manifests' own parts list may be one writer's many segments
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return segment_files(spark, root, latest).select("segment", "path").repartition(parts).mapInArrow(work, _ENTRIES)


def _wanted(spark: SparkSession, root: str, keys: DataFrame, once: bool = False) -> DataFrame:
    """segment, version, key of the wanted (segment, key) rows whose segment has a file, in order; once: without repeated rows.

    They are dealt by segment, in one shuffle, so that few tasks open the same file.
    """
    wanted = keys.select(F.col("segment").cast("bigint").alias("segment"), F.col("key").cast("binary").alias("key")).repartition("segment")
    files = segment_files(spark, root, latest=True).select("segment", "version")
    rows = (wanted.distinct() if once else wanted).join(files, "segment")
    return rows.sortWithinPartitions("segment", "key").select("segment", "version", "key")


def _answered(batches: Iterator[pa.RecordBatch], root: str, known: Registry | None, read: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes | None]]]:
    """Batches of `_wanted` rows, with what each row's filter says and, if asked to read, its value (None: it isn't there).

    A file is opened once and its filter asked for all of a batch's keys together; keys come in order, so a block is read once.
    """
    store, folder = _store(root)
    now, file, reader, held, block = None, None, None, [], -1
    for b in batches:
        segments, versions, keys = (b.column(c).to_pylist() for c in ("segment", "version", "key"))
        hashes, maybe, values = first_hashes(keys), np.zeros(len(keys), bool), [None] * len(keys)
        begins = [i for i, s in enumerate(segments) if not i or s != segments[i - 1]]
        for begin, end in zip(begins, [*begins[1:], len(keys)], strict=True):
            if segments[begin] != now:
                if file:
                    file.close()
                now, file = segments[begin], store.open_input_file(f"{folder}/{file_name(segments[begin], versions[begin])}")
                reader, block = SegmentReader(file, known, read), -1
                separators = [p.separator for p in reader.index]
            maybe[begin:end] = reader.bloom.may_contain_each(hashes[begin:end])
            for j in (begin + np.flatnonzero(maybe[begin:end])).tolist() if read else ():
                i = bisect_left(separators, keys[j])
                if i == len(separators):
                    break  # so are all keys after it
                if i != block:
                    held, block = reader.block(i), i
                at = bisect_left(held, (keys[j],))
                if at < len(held) and held[at][0] == keys[j]:
                    values[j] = held[at][1]
        yield b, maybe, values
    if file:
        file.close()


def lookup(spark: SparkSession, root: str, keys: DataFrame, registry: list[Dictionary] | None = None) -> DataFrame:
    """segment, version, key, value of the wanted (segment, key) rows that are there, in each segment's latest version.

    Wanted keys go to the task that opens their segment's file: its filter says which can't be there, its index which block to read.
    """
    raws = [(d.id, d.raw, d.level) for d in registry or []]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, values in _answered(batches, root, _known(raws)):
            there = pa.array([v is not None for v in values], pa.bool_())
            rows = [*(b.column(c) for c in ("segment", "version", "key")), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays([x.filter(there) for x in rows], ["segment", "version", "key", "value"])

    return _wanted(spark, root, keys, once=True).mapInArrow(work, _ENTRIES)


def may_contain(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """segment, key, maybe: what each segment's latest filter says of the wanted (segment, key) rows; never false for a key that is there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, maybe, _ in _answered(batches, root, None, read=False):
            yield pa.RecordBatch.from_arrays([b.column("segment"), b.column("key"), pa.array(maybe)], ["segment", "key", "maybe"])

    return _wanted(spark, root, keys).mapInArrow(work, "segment bigint, key binary, maybe boolean")


def membership(spark: SparkSession, root: str, keys: DataFrame, registry: list[Dictionary] | None = None) -> DataFrame:
    """segment, key, maybe, present: what `may_contain` says, and whether the key is there, as the file of what a filter lets through tells."""
    raws = [(d.id, d.raw, d.level) for d in registry or []]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, maybe, values in _answered(batches, root, _known(raws)):
            present = pa.array([v is not None for v in values], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("segment"), b.column("key"), pa.array(maybe), present], ["segment", "key", "maybe", "present"])

    return _wanted(spark, root, keys).mapInArrow(work, "segment bigint, key binary, maybe boolean, present boolean")
