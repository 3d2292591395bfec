r"""Operator 5, chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, only that reply is trainable.
A turn is written `<|im_start|>` role `\n` text `<|im_end|>\n`. In texts, each `<`, backslashes, `|` gets one more
backslash after the `<`, so that no control string is left and unescaping is exact; in roles, backslashes
are doubled too and line ends become `\n`.

`examples` writes each example whole: its text holds all turns before the reply, so a conversation of t turns gives about t * t / 2 turns of
text. `expand` is the compact form for storage: what each example's text adds to the one before it (`delta`), with offsets into the
whole text; `written_out` makes whole examples of it. Turns after the last reply make a row without a target (example -1), so
that nothing is lost.

Turns are sorted by (conversation, turn, role, text), nulls first, and stream through a worker, which holds one example's text: examples
leave it one by one, in batches of about BATCH_CHARS. A conversation is one task's stream.

Defined cases: a null text or role is empty; a null conversation is a conversation of its own; turns that tie go by
role and text; repeated rows are turns of their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.textkit import mapped

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"
#: Characters of whole examples in a batch, about; a longer example is a batch of its own.
BATCH_CHARS = 4_000_000
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""text without control strings."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line, without control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    """The inverse of escape_role."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A written turn, and where its text begins and ends in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def turns_in(written: str) -> list[tuple[str, str]]:
    """Role and text of each turn in written turns."""
    out = []
    for part in written.split(START)[1:]:
        role, _, text = part.partition("\n")
        if not text.endswith(END):
            raise ValueError("a turn without its end")
        out.append((unescape_role(role), unescape(text[: -len(END)])))
    return out


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("delta", pa.string()), ("begin", pa.int64()), ("loss_begin", pa.int64()), ("loss_end", pa.int64()), ("chars", pa.int64())])
_EXAMPLES = "conv_id long, example long, delta string, begin long, loss_begin long, loss_end long, chars long"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, open_, example, begin, parts, size = None, False, 0, 0, [], 0
    out: list[tuple] = []

    def close(loss: tuple[int, int] | None) -> None:
        nonlocal example, begin, parts, size
        end = begin + size
        out.append((conv, example if loss else -1, "".join(parts), begin, *(loss or (end, end)), end))
        example, begin, parts, size = example + 1, end, [], 0

    for b in batches:
        for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if open_ and c != conv:
                if parts:
                    close(None)
                example, begin = 0, 0
            conv, open_ = c, True
            written, lo, hi = turn(role or "", text or "")
            at = begin + size
            parts.append(written)
            size += len(written)
            if role == TARGET:
                close((at + lo, at + hi))
        if out:
            yield _batch(out, _EXAMPLE)
            out = []
    if parts:
        close(None)
    if out:
        yield _batch(out, _EXAMPLE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _dealt(conversations: DataFrame) -> DataFrame:
    """Turns in order, a conversation in one task."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def expand(conversations: DataFrame) -> DataFrame:
    """An example for each assistant turn, in order within its conversation.

    delta: what its text adds to the example before it; begin: where delta begins in the whole text; loss_begin, loss_end:
    the reply's place in the whole text; chars: the whole text's length. One shuffle, by conversation.
    """
    return mapped(_dealt(conversations), _expand, _EXAMPLES)


_WHOLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.large_string()), ("loss_begin", pa.int64()), ("loss_end", pa.int64())])
_WHOLES = "conv_id long, example long, text string, loss_begin long, loss_end long"


def _complete(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Whole examples from deltas in order; a row that does not begin where the text so far ends is an error."""
    conv, parts, size, out, held = None, [], 0, [], 0
    for x in rows:
        if x["begin"] == 0 or x["conv_id"] != conv:
            conv, parts, size = x["conv_id"], [], 0
        if x["begin"] != size:
            raise ValueError(f"conversation {conv}, example {x['example']} begins at {x['begin']}, but the text before it has {size} characters")
        parts = ["".join([*parts, x["delta"]])]
        size += len(x["delta"])
        if size != x["chars"]:
            raise ValueError(f"conversation {conv}, example {x['example']} has {x['chars']} characters, but its text has {size}")
        out.append((conv, x["example"], parts[0], x["loss_begin"], x["loss_end"]))
        held += size
        if held >= BATCH_CHARS:
            yield _batch(out, _WHOLE)
            out, held = [], 0
    if out:
        yield _batch(out, _WHOLE)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (-1: turns after the last reply, no target), text, loss_begin, loss_end: whole examples, in order within a conversation.

    One shuffle, of the turns; contexts are written where their turns have streamed to.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _complete(x for b in _expand(batches) for x in b.to_pylist())

    return mapped(_dealt(conversations), work, _WHOLES)


def written_out(expanded: DataFrame) -> DataFrame:
    """The same from a table of expand(), in whatever order its rows come: they are dealt by conversation and sorted by begin."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _complete(x for b in batches for x in b.to_pylist())

    parts = int(expanded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(expanded.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "begin"), work, _WHOLES)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: dict | None = None
    out: list[tuple] = []

    def close() -> None:
        if now:
            said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns_in(now["text"])).encode())
            out.append((now["conv"], len(turns_in(now["text"])), said.hexdigest(), now["loss"], now["sha"].hexdigest(), len(now["text"]), now["examples"]))

    for b in batches:
        for x in b.to_pylist():
            if now is None or x["conv_id"] != now["conv"]:
                close()
                now = {"conv": x["conv_id"], "text": "", "loss": 0, "sha": hashlib.sha256(), "examples": 0}
            if not x["text"].startswith(now["text"]):
                raise ValueError(f"conversation {x['conv_id']}, example {x['example']} lacks its context")
            now["text"] = x["text"]
            if x["example"] >= 0:
                role, said = turns_in(x["text"])[-1]
                if role != TARGET or said != unescape(x["text"][x["loss_begin"] : x["loss_end"]]):
                    raise ValueError(f"conversation {x['conv_id']}, example {x['example']} does not end in its reply")
                now["loss"] += len(said)
                now["sha"].update(said.encode())
                now["examples"] += 1
        if out:
            yield _batch(out, _DIGEST)
            out = []
    close()
    if out:
        yield _batch(out, _DIGEST)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def read_back(wholes: DataFrame) -> DataFrame:
    """A row for each conversation, parsed from whole examples in the order that examples() gives; each must hold the one before it."""
    return mapped(wholes, _read_back, _DIGESTS)


def digests(conversations: DataFrame) -> DataFrame:
    """read_back(examples(conversations)) in one pass: whole examples are written and read back batch by batch, in one worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read_back(_complete(x for b in _expand(batches) for x in b.to_pylist()))

    return mapped(_dealt(conversations), work, _DIGESTS)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5 over all of conversations and conversation -1; formatted_chars: code points of the longest example, which holds all turns."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(rows.unionAll(more))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM t GROUP BY conv_id
"""
