"""Operator 3, SentencePiece BPE encoding and decoding.

A text gets a leading space mark and marks for its spaces; it falls into segments where no piece of the vocabulary
reaches across (before marks, and between letters, digits and other characters). Distinct segments of a batch lie in flat arrays of
symbols. In each round, every segment finds the best rank among its adjacent pairs by a segmented minimum, all leftmost pairs of that
rank that don't overlap are merged at once, and the arrays are compacted, until no pair is left. That is the library's order (by rank,
then by place) as long as no merge makes a pair of the same or a better rank; where one does, its segment merges the first pair only.

A segment of more than LONG symbols (a long text without spaces) is cut further as it is merged, wherever no piece that the text can
still give reaches across; and in it a pair is also merged where nothing can come before it: no such piece of a better rank begins or ends
at one of its two symbols and reaches beyond the pair. Far-off parts then merge side by side, so the number of rounds doesn't
grow with the length. Characters without a piece become byte pieces.

Defined cases: a null text is empty; an empty text has the two control ids only and decodes to an empty text; repeated rows have equal
results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.textkit import chunks, mapped

MARK = "▁"
LONG = 256
#: Rounds after which a long segment is cut anew.
CUT_EVERY = 6
#: Segments whose ids a worker keeps at most; then it starts anew.
KEPT = 400_000
NONE = np.iinfo(np.int32).max
U64 = np.uint64
_FACTOR = U64(0x5851F42D4C957F2D)


def segments_of(names: list[str]) -> re.Pattern[str]:
    """A pattern that cuts a text where no piece reaches across: before marks, and between letters, digits and the rest.

    Every piece must lie in one segment; where the vocabulary has others, only marks cut, or nothing does.
    """
    also = {"_"}
    for _ in range(2):
        other = re.escape("".join(sorted(also)))
        pattern = re.compile(rf"{MARK}*[^\W\d{other}]+|{MARK}*\d|{MARK}*(?:[^{MARK}\w]|[{other}])+|{MARK}+")
        odd = [p for p in names if not pattern.fullmatch(p)]
        if not odd:
            return pattern
        also |= {c for p in odd for c in p if re.match(r"[^\W\d]", c) and not c.isalpha()}
    by_mark = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    return by_mark if all(by_mark.fullmatch(p) for p in names) else re.compile(r"(?s).+")


class _Held:
    """The pieces that long segments can still give: those that begin and end between symbols as merged so far."""

    def __init__(self, begin: np.ndarray, size: np.ndarray, rank: np.ndarray, n: int):
        self.begin, self.size, self.rank = begin, size, rank.astype(np.int32)
        self.inside = np.zeros(n + 1, bool)  # a place inside a symbol

    def cut(self) -> np.ndarray:
        """Which places no piece reaches across; what free() looks up is brought up to date."""
        between = np.concatenate([[0], np.cumsum(~self.inside)])
        keep = ~self.inside[self.begin] & ~self.inside[self.begin + self.size] & (between[self.begin + self.size] - between[self.begin + 1] > 0)
        self.begin, self.size, self.rank = self.begin[keep], self.size[keep], self.rank[keep]
        n, most = len(self.inside), int(self.size.max()) if len(self.size) else 1
        #: the best rank of pieces of more than l characters that begin at p, and that end before p
        self.begins, self.ends = (np.full((most + 1, n), NONE, np.int32) for _ in range(2))
        self.begins[self.size - 1, self.begin] = self.rank
        self.ends[self.size - 1, self.begin + self.size] = self.rank
        for x in (self.begins, self.ends):
            for size in range(most - 1, 0, -1):
                np.minimum(x[size - 1], x[size], out=x[size - 1])
        across = np.bincount(self.begin + 1, minlength=n + 1)[:n] - np.bincount(self.begin + self.size, minlength=n + 1)[:n]
        return np.cumsum(across) == 0

    def free(self, rank: np.ndarray, place: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places of the pairs that nothing in the text can come before."""
        at = np.flatnonzero(rank < NONE)
        a, b, e, own, most = place[at], place[at + 1], stop[at + 1], rank[at], len(self.begins) - 1
        long_, last = np.minimum(e - a, most), np.minimum(e - b, most)
        later = np.minimum(self.begins[long_, a], self.begins[last, b]) >= own  # of equal ranks the left pair is the first
        return at[later & (np.minimum(self.ends[long_, e], self.ends[np.minimum(b - a, most), b]) > own)]


class Pieces:
    """A BPE model with byte fallback, read through the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.id_of = {p: i for i, p in enumerate(names) if not special[i]}
        self.n = n
        # equal scores have equal ranks: the leftmost pair is then the first
        scores = np.array([-sp.get_score(i) for i in range(n)])
        rank = np.unique(scores, return_inverse=True)[1]
        pairs = [(self.id_of[p[:k]] * n + self.id_of[p[k:]], rank[i], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        pairs.sort()
        self.pair, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        # hashes and ranks of all pieces of a length, for those that a long text holds
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(2, max(map(len, self.id_of)) + 1):
            own = [(p, rank[i]) for p, i in self.id_of.items() if len(p) == size]
            points = np.frombuffer("".join(p for p, _ in own).encode("utf-32-le"), np.uint32).reshape(-1, size)
            h = np.zeros(len(own), U64)
            for j in range(size):
                h = h * _FACTOR + points[:, j]
            order = np.argsort(h)
            self.known.append((h[order], np.array([r for _, r in own], np.int32)[order]))
        self.segment = segments_of(list(self.id_of))
        self.said = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        for value, i in self.byte_ids.items():
            self.said[i] = bytes([value])
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, begin and end included."""
        if len(self.ids) > KEPT:
            self.ids.clear()
        ids, known = self.ids, self.ids.get
        split = [self.segment.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        got = [list(map(known, x)) for x in split]
        new = list({s for x, g in zip(split, got, strict=True) if None in g for s, k in zip(x, g, strict=True) if k is None})
        ids.update(zip(new, self.merge(new), strict=True))
        head, tail = (int(x).to_bytes(4, "little") for x in (self.begin, self.end))
        return [b"".join([head, *(g if None not in g else map(known, x)), tail]) for x, g in zip(split, got, strict=True)]

    def merge(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment by rounds of merges."""
        out: list[bytes] = [b""] * len(segments)
        for far in (False, True):
            own = [i for i, x in enumerate(segments) if (len(x) > LONG) == far]
            for i, ids in zip(own, self._rounds([segments[i] for i in own], far) if own else (), strict=True):
                out[i] = ids
        return out

    def _rounds(self, segments: list[str], far: bool) -> list[bytes]:
        lengths = np.array([len(x) for x in segments])
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        distinct, at = np.unique(points, return_inverse=True)
        # a character without a piece: negative, and in no pair
        sym = np.array([self.id_of.get(chr(c), -1 - int(c)) for c in distinct.tolist()], np.int64)[at]
        seg = np.repeat(np.arange(len(segments)), lengths)
        held = _Held(*self._held(points, lengths), len(points)) if far else None
        done_sym, done_place = [], []
        place, stop = np.arange(len(sym)), np.arange(1, len(sym) + 1)
        rounds = 0
        rank, into = self._ranks(sym[:-1], sym[1:], seg[:-1] == seg[1:])
        rank, into = np.append(rank, NONE), np.append(into, 0)
        while len(sym):
            if held and rounds % CUT_EVERY == 0:
                seg = np.cumsum(held.cut()[place])
            rounds += 1
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            size = np.diff(np.append(first, len(seg)))
            best = np.minimum.reduceat(rank, first)
            on = np.repeat(best < NONE, size)
            if not on.all():
                for x, y in ((done_sym, sym), (done_place, place)):
                    x.append(y[~on])
                if not on.any():
                    break
            best = np.repeat(best, size)
            at = self._leftmost(rank, (rank == best) & on)
            sure = np.zeros(len(at), bool)
            if held:
                free = held.free(rank, place, stop)
                at = np.union1d(at, free)
                sure = np.isin(at, free)
            # what each merge makes of the pairs on both sides, when it comes: those to its left are merged, those to its right not yet
            touch, left_rank, left_into, right_rank, right_into = self._beside(sym, seg, into, at)
            early = (np.minimum(left_rank, right_rank) <= rank[at]) & ~sure
            if early.any():
                only = np.concatenate([[True], seg[at[1:]] != seg[at[:-1]]])  # the first of each segment
                at = at[only | sure | ~np.isin(seg[at], seg[at[early]])]
                touch, left_rank, left_into, right_rank, right_into = self._beside(sym, seg, into, at)
            live = on.copy()
            live[at + 1] = False
            stop[at] = stop[at + 1]
            if held:
                held.inside[place[at + 1]] = True
            sym[at], rank[at], into[at] = into[at], right_rank, right_into
            before = np.where(touch, at - 2, at - 1)
            ok = before >= 0
            rank[before[ok]], into[before[ok]] = left_rank[ok], left_into[ok]
            sym, seg, rank, into, place, stop = (x[live] for x in (sym, seg, rank, into, place, stop))
        sym, place = (np.concatenate(x) for x in (done_sym, done_place))
        order = np.argsort(place)
        sym, seg = sym[order], np.searchsorted(np.cumsum(lengths), place[order], "right")
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            sym, seg = self._fallback(sym, seg, odd)
        cut = 4 * np.searchsorted(seg, np.arange(len(segments) + 1))
        raw = sym.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _beside(self, sym: np.ndarray, seg: np.ndarray, into: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which merges follow another at once, and ranks and pieces of the pairs that each makes to its left and right."""
        touch = np.concatenate([[False], at[1:] == at[:-1] + 2])
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        of_left = self._ranks(np.where(touch, into[at - 2 * touch], sym[left]), into[at], (at > 0) & (seg[left] == seg[at]))
        of_right = self._ranks(into[at], sym[right], (right == at + 2) & (seg[right] == seg[at]))
        return touch, *of_left, *of_right

    def _held(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces of two characters and more lie in the segments: begins, lengths and ranks."""
        stop = np.repeat(np.cumsum(lengths), lengths)
        found, h = [], points.astype(U64)
        for size, (hashes, ranks) in enumerate(self.known, 2):
            h = h[:-1] * _FACTOR + points[size - 1 :]
            if not len(h):
                break
            if len(hashes):
                k = np.searchsorted(hashes, h)
                k[k == len(hashes)] = 0
                at = np.flatnonzero((hashes[k] == h) & (np.arange(size, len(h) + size) <= stop[: len(h)]))
                found.append((at, np.full(len(at), size), ranks[k[at]]))
        return tuple(np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(3))

    @staticmethod
    def _leftmost(rank: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Places of the hits that are merged: in a run of pairs of one rank, every second from its begin, up to the first that is no hit."""
        near = np.flatnonzero(hit)
        run = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        of = np.searchsorted(run, near, "right") - 1
        offset = near - run[of]
        # a hit counts if all pairs of its run before it are hits, that is if it is the run's offset-th hit
        nth = np.arange(len(near)) - np.searchsorted(of, of)
        return near[(offset == nth) & (offset % 2 == 0)]

    def _ranks(self, a: np.ndarray, b: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged pieces of pairs, where they stand beside each other; NONE where there is none."""
        key = np.where(beside & (a >= 0) & (b >= 0), a * self.n + b, -1)
        k = np.searchsorted(self.pair, key)
        k[k == len(self.pair)] = 0
        return np.where(self.pair[k] == key, self.rank[k], NONE), self.merged[k]

    def _fallback(self, sym: np.ndarray, seg: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = {c: [self.byte_ids[b] for b in chr(-1 - c).encode()] for c in np.unique(sym[odd]).tolist()}
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(of[c]) for c in sym[odd].tolist()]
        begin = np.cumsum(size) - size
        wide, wide_seg = np.repeat(sym, size), np.repeat(seg, size)
        for at, c in zip(begin[odd].tolist(), sym[odd].tolist(), strict=True):
            wide[at : at + len(of[c])] = of[c]
        return wide, wide_seg

    def decode(self, ids: bytes) -> str:
        """The text of ids in the form that encode() gives; the leading mark goes."""
        said = self.said
        text = b"".join([said[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model at a path, loaded once in a process."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for b in chunks(batch):
                ids = model.encode([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, ids binary, decoded string")


def digests(tokenised_: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, of what tokenised() gives."""
    return tokenised_.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3 over all of documents. The model is found on each worker, where the tokenizer files are installed."""
    import public_tokenizers

    return digests(tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")))
