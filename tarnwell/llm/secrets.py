r"""Operator 8, secret scans in DataFrame functions only.

Patterns give the base spans. The method adds strings that look random: in each candidate string a window slides over the
characters; counts per character, grouped by character class, are kept up to date as one leaves and one enters, and with them
the window's Shannon entropy. A string is a secret if some window reaches its class's entropy and no allow-list entry holds: letters
alone, digits alone, a word of the list, or a span that is found already. First whole runs of letters, digits and signs are tried
(hexadecimal, or not); what they leave is split into ever narrower runs (CLASSES), each with its own entropy and held against the
allow-list by itself.

Places are code points, ends exclusive. The pieces between matches (split) and the matches give a match's place, a window's
step costs the same wherever it is, and long runs go piece by piece, so a text takes linear time. Defined cases: a null text is
empty and has no spans; equal rows have equal results; columns named like those of the result are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind: (pattern, group that must reach a length, that length)
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
ENTROPY = "entropy"
KINDS = (*BASE, ENTROPY)
#: Characters in a window and bits that one must reach: hexadecimal, letters of one case with digits, and other strings.
WINDOW, HEX_BITS, ALNUM_BITS, TEXT_BITS = 20, 3.1, 3.5, 3.9
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{WINDOW},}}"
#: A run of some characters, whole, with no sample's name in its word of letters and digits nor after it in the candidate (keys made
#: for documents end so, and may hold a slash); a sample's name in a piece before it, as in a path, says nothing about it.
_SAMPLE = "(?i:example|sample|dummy|placeholder)"
_PART = rf"(?<![{{0}}])(?=[{{0}}]{{{{{WINDOW}}}}})(?<!{_SAMPLE}[A-Za-z0-9]{{{{0,40}}}})[{{0}}]{{{{{WINDOW},}}}}+(?![A-Za-z0-9+/_-]{{{{0,100}}}}{_SAMPLE})"
#: Runs inside a candidate, widest first, and the bits of each.
CLASSES = (
    (_PART.format("A-Za-z0-9+_-"), TEXT_BITS),
    (_PART.format("A-Za-z0-9"), TEXT_BITS),
    (f"{_PART.format('a-z0-9')}|{_PART.format('A-Z0-9')}", ALNUM_BITS),
    (f"{_PART.format('0-9a-f')}|{_PART.format('0-9A-F')}", HEX_BITS),
)
#: What is no secret however random: letters alone, digits alone, samples.
ALLOWED = rf"^[A-Za-z]+$|^[0-9]+$|{_SAMPLE}"
MASK = "[SECRET]"
#: Characters of a piece in which windows slide or from which a text is cut; spans that are gathered at once.
PIECE, BLOCK = 4096, 256
_SAID = "array<struct<span:struct<start:int,kind:int,stop:int>,said:string>>"
#: Character classes of candidates: digits, signs, small and capital letters. Counts of a window take 5 bits each, 12 to a word.
ALPHABET = "0123456789+/_-" + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BITS, _EACH = 5, 12
_WORDS = -(-len(ALPHABET) // _EACH)
#: Fixed point of c * log2(c): sums are exact, whatever order characters come in.
_UNIT = 1 << 40


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: Spark computes an expression anew wherever a lambda names it."""
    return F.transform(F.array(value), use)[0]


def _gathered(rows: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """An array (of type kind) of what all steps give: from the place so far and an element, the next place and an array.

    Elements go block by block, as an array that grows is copied at each step.
    """
    none = F.lit([]).cast(kind)

    def of_block(at: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            place, out = step(acc["at"], x)
            return F.struct(place.alias("at"), F.concat(acc["out"], out).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), one)

    def whole(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, BLOCK))
        begin = F.struct(F.lit(0).alias("at"), F.lit([]).cast(f"array<{kind}>").alias("out"))
        return F.aggregate(cut, begin, lambda acc, b: _bound(of_block(acc["at"], b), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(rows) > 0, _bound(rows, whole)).otherwise(none)


def _found(text: Column, pattern: str, kind: int, group: int, least: int, shift: Column | int = 0) -> Column:
    """Spans of a pattern's matches in a text that begins at shift, with what each says, as an array of (span, said)."""
    p = F.lit(pattern)

    def spans(whole: Column) -> Column:
        tested = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
        steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("all"), tested.alias("test"))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            begin = at + F.length(x["gap"])
            span = F.struct((begin + shift).alias("start"), F.lit(kind).alias("kind"), (begin + F.length(x["all"]) + shift).alias("stop"))
            one = F.array(F.struct(span.alias("span"), x["all"].alias("said")))
            return begin + F.length(x["all"]), F.when(F.length(x["test"]) >= least, one).otherwise(F.lit([]).cast(_SAID))

        return _gathered(steps, _SAID, step)

    return _bound(F.regexp_extract_all(text, p, F.lit(0)), lambda whole: F.when(F.size(whole) > 0, spans(whole)).otherwise(F.lit([]).cast(_SAID)))


def window_entropy(text: Column) -> Column:
    """The highest Shannon entropy, in bits, of WINDOW consecutive characters of a string over ALPHABET; 0 if it is shorter.

    A long string goes in pieces, each with the last characters of the one before, so that no array is longer than a piece.
    """

    def of_pieces(pieces: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.size(pieces) - 1))
        return F.array_min(F.transform(F.zip_with(before, pieces, lambda a, b: F.concat(F.right(a, F.lit(WINDOW - 1)), b)), _least_sum))

    best = _bound(F.regexp_extract_all(text, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), of_pieces)
    return F.when(F.length(text) >= WINDOW, F.lit(math.log2(WINDOW)) - best / F.lit(float(_UNIT * WINDOW))).otherwise(0.0)


def _least_sum(piece: Column) -> Column:
    """The least sum of c * log2(c) over the counts c of a window, in units of 1 / _UNIT: there entropy is highest."""
    cost = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(WINDOW + 2)]
    # what one more and one less of a character with a count does to the sum
    up, down = (F.expr(f"array({', '.join(f'{x}L' for x in v)})") for v in ([b - a for a, b in zip(cost, cost[1:], strict=False)], [0, *(a - b for a, b in zip(cost, cost[1:], strict=False))]))
    # a character's word of counts and its place there, in one number
    index = {ord(c): i // _EACH << 6 | i % _EACH * _BITS for i, c in enumerate(ALPHABET)}
    code = F.expr(f"array({', '.join(str(index.get(c, 0)) for c in range(128))})")

    def count(acc: Column, c: Column) -> Column:
        word = F.element_at(acc["counts"], F.shiftright(c, 6) + 1)
        return F.call_function("shiftright", word, c.bitwiseAND(F.lit(63))).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["e"], x["l"]

        def moved(word: Column, i: Column) -> Column:
            one = lambda c: F.when(i == F.shiftright(c, 6), F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))
            return word + one(enters) - one(leaves)

        less = F.when(leaves >= 0, F.element_at(down, count(acc, leaves) + 1)).otherwise(F.lit(0).cast("long"))
        now = F.when(enters == leaves, acc["sum"]).otherwise(acc["sum"] + F.element_at(up, count(acc, enters) + 1) + less)
        least = lambda now: F.when(x["whole"], F.least(acc["least"], now)).otherwise(acc["least"])
        return _bound(now, lambda now: F.struct(F.transform(acc["counts"], moved).alias("counts"), now.alias("sum"), least(now).alias("least")))

    def slide(codes: Column) -> Column:
        leave = F.concat(F.array_repeat(F.lit(-1), WINDOW), codes)
        steps = _bound(leave, lambda leave: F.transform(codes, lambda c, i: F.struct(c.alias("e"), leave[i].alias("l"), (i >= WINDOW - 1).alias("whole"))))
        most = F.lit((1 << 62) - 1).cast("long")
        begin = F.struct(F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(0).cast("long").alias("sum"), most.alias("least"))
        return F.aggregate(steps, begin, step, lambda acc: acc["least"])

    return _bound(F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.element_at(code, F.ascii(c) + 1)), slide)


def scanned(docs: DataFrame) -> DataFrame:
    """The rows of docs with base and spans: arrays of (start, kind, stop), sorted; kind is a place in KINDS."""
    rows = docs.withColumn("__t", F.coalesce("text", F.lit("")))
    text = F.col("__t")
    only = lambda found: F.transform(found, lambda x: x["span"])
    parts = [only(_found(text, pattern, kind, group, least)) for kind, (pattern, group, least) in enumerate(BASE.values())]
    rows = rows.withColumns({f"__s{k}": x for k, x in enumerate(parts)} | {"__c": _found(text, CANDIDATE, len(BASE), 0, WINDOW)})
    rows = rows.withColumn("base", F.array_sort(F.concat(*[f"__s{k}" for k in range(len(BASE))]))).withColumn("spans", F.col("base"))
    none = F.lit([]).cast(_SAID)
    for pattern, bits in ((None, None), *CLASSES):
        # runs of a class lie inside candidates: a text without any has nothing to split
        split = F.col("__c") if pattern is None else F.flatten(F.transform("__c", _runs(pattern)))
        rows = rows.withColumn("__r", F.when(F.size("__c") > 0, split).otherwise(none))
        rows = rows.withColumn("__r", F.when((F.size("__r") > 0) & (F.size("spans") > 0), _fresh(F.col("__r"))).otherwise(F.col("__r")))
        rows = rows.withColumn("spans", F.when(F.size("__r") > 0, F.array_sort(F.concat("spans", only(F.filter("__r", _random(bits)))))).otherwise(F.col("spans")))
    return rows.drop("__t", "__c", "__r", *[f"__s{k}" for k in range(len(BASE))])


def _runs(pattern: str) -> Callable[[Column], Column]:
    """The runs of a class inside a candidate."""
    return lambda x: _found(x["said"], pattern, len(BASE), 0, WINDOW, x["span"]["start"])


def _fresh(found: Column) -> Column:
    """Candidates outside spans, in one sweep by start: the place is the furthest end of the spans so far."""
    kinds = f"struct<start:int,candidate:int,stop:int,x:{_SAID[6:-1]}>"
    of_spans = F.transform("spans", lambda s: F.struct(s["start"], F.lit(0), s["stop"], F.lit(None)).cast(kinds))
    of_candidates = F.transform(found, lambda x: F.struct(x["span"]["start"], F.lit(1), x["span"]["stop"], x).cast(kinds))

    def step(high: Column, s: Column) -> tuple[Column, Column]:
        new = (s["candidate"] == 1) & (s["stop"] > high)
        return F.when(s["candidate"] == 0, F.greatest(high, s["stop"])).otherwise(high), F.when(new, F.array(s["x"])).otherwise(F.lit([]).cast(_SAID))

    return _gathered(F.array_sort(F.concat(of_spans, of_candidates)), _SAID, step)


def _random(bits: float | None) -> Callable[[Column], Column]:
    """Whether a candidate looks random; bits: those of its class, None for a whole run, which has those of what it holds."""

    def test(x: Column) -> Column:
        least = F.lit(bits) if bits else F.when(x["said"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), HEX_BITS).otherwise(TEXT_BITS)
        return ~x["said"].rlike(ALLOWED) & (window_entropy(x["said"]) >= least)

    return test


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.expr(f"array{KINDS}")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["stop"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every row; no shuffle."""
    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def _without(text: Column, spans: Column) -> Column:
    """text with MASK for every span. It is cut from pieces of a fixed size, so a cut costs the same wherever it is."""
    kept = "array<struct<start:int,stop:int>>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["stop"]), F.when(s["start"] >= at, F.array(F.struct(at.alias("start"), s["start"].alias("stop")))).otherwise(F.lit([]).cast(kept))

    def said(pieces: Column) -> Callable[[Column], Column]:
        def cut(s: Column) -> Column:
            first, last = (F.shiftright(s[x], PIECE.bit_length() - 1) for x in ("start", "stop"))
            a, b = (s[x].bitwiseAND(F.lit(PIECE - 1)) for x in ("start", "stop"))
            piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
            between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            return F.when(first == last, piece(first).substr(a + 1, b - a)).otherwise(F.concat(piece(first).substr(a + 1, F.lit(PIECE)), between, piece(last).substr(F.lit(1), b)))

        return cut

    end = F.struct(F.length(text).alias("start"), F.lit(0).alias("kind"), F.length(text).alias("stop"))
    gaps = _gathered(F.concat(spans, F.array(end)), kept, step)
    # the last gap ends at the text's end; where the last span reaches it, it is empty
    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: F.array_join(F.transform(gaps, said(pieces)), MASK))


def masked(docs: DataFrame) -> DataFrame:
    """docs with MASK for every span in text, and n_chars to match; overlapping spans are masked as one.

    Defined cases: a null text stays null, rows without spans stay as they are, repeated rows stay, all other columns travel as they are.
    """
    # all columns travel in one, so that none of theirs can clash with those of scanned()
    rows = scanned(docs.select(F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row"), "text"))
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, _without(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    now = {"text": F.col("text"), "n_chars": F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(now[n] if n in now else F.col("row").getField(n)).alias(n) for n in docs.columns])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 8 over all of documents."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
