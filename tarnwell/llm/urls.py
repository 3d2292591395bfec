"""Operator 7, URL filters by a bit-parallel wildcard automaton.

All rules are globs over a canonical URL (a dot, the host in lower case, the path). Each glob is a run of states: one for
each character it consumes; a wildcard is a loop on the state before it. The states of all globs lie side by side
in 64-bit words, so one shift, two ands and an or per byte advance every glob at once (Shift-And with
loops), and a batch of URLs advances together.

In a glob `*` is any run without `/`, `**` any run, `?` any byte but `/`; all else stands for itself. A URL fits a glob as a whole.

Defined cases: a null URL or one without `://` has an empty host and path, and no rule but the globs for anything fits it. Only A-Z are
lower-cased. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.textkit import U64, flat, mapped

#: (verdict, host and path): a rule holds for its host and all subdomains, if the path starts with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Globs of what is blocked where no rule fits: hosts, with any path, then whole URLs.
_HOSTS = ("*.ads-*", "*-ads.*", "*.adserver*", "*.track*", "*casino*", "*-bets.*", "*.bets-*", "*pills*", "*viagra*", "*porn*", "*xxx*")
BLOCKED = (*_HOSTS, *(f"{h}/**" for h in _HOSTS), "**/ads/**", "**/track/**", "**/banner/**", "**.exe", "**.zip")


class GlobSet:
    """Globs compiled into masks over 64-bit words."""

    def __init__(self, globs: list[str]):
        self.globs = globs
        # states of all globs, glob after glob: a first state and one for each consumed byte
        consumes: list[tuple[int, ...]] = []
        loops: list[str] = []
        self.first, self.last = [], []
        for g in globs:
            self.first.append(len(consumes))
            consumes.append(())
            loops.append("")
            raw, i = g.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops[-1] = "any"
                    i += 2
                elif raw[i] == 0x2A:
                    loops[-1] = loops[-1] or "name"
                    i += 1
                else:
                    consumes.append(tuple(x for x in range(256) if x != 0x2F) if raw[i] == 0x3F else (raw[i],))
                    loops.append("")
                    i += 1
            self.last.append(len(consumes) - 1)
        self.words = max(1, -(-len(consumes) // 64))
        take, stay = np.zeros((256, self.words), U64), np.zeros((256, self.words), U64)
        for s, (bytes_, loop) in enumerate(zip(consumes, loops, strict=True)):
            w, bit = s // 64, U64(1 << s % 64)
            take[list(bytes_), w] |= bit
            if loop:
                stay[:, w] |= bit
            if loop == "name":
                stay[0x2F, w] &= ~bit
        self.take, self.stay = take, stay
        self.start = np.zeros(self.words, U64)
        for s in self.first:
            self.start[s // 64] |= U64(1 << s % 64)

    def fits(self, column: pa.Array) -> np.ndarray:
        """Which globs fit each text: rows x globs."""
        data, offsets = flat(column)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")  # the longest first: rows that end drop off the tail
        size, begin = size[order], offsets[:-1][order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        carry = U64(63)
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))  # rows longer than t
            c = data[begin[:n] + t]
            d = state[:n]
            up = d << U64(1)
            up[:, 1:] |= d[:, :-1] >> carry
            state[:n] = up & self.take[c] | d & self.stay[c]
        out = np.zeros((len(order), len(self.globs)), bool)
        for g, s in enumerate(self.last):
            out[order, g] = state[:, s // 64] >> U64(s % 64) & U64(1) == 1
        return out


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; no shuffle."""
    # the canonical URL's host ends at its first slash, so host globs use runs without one
    globs = [f"*.{r}**" for _, r in rules] + list(blocked)
    # longest rule first: by host and path length
    by_length = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), rules[i][1]))
    rest = F.expr("substring(url, locate('://', url) + 3)")
    has = F.coalesce(F.locate("://", "url") > 0, F.lit(False))
    host = F.when(has, F.regexp_extract(rest, r"^[^/?#]*", 0)).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), low.alias("host"), path.alias("path")).withColumn("canonical", F.concat(F.lit("."), "host", "path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobSet(globs)
        for b in batches:
            fits = automaton.fits(b.column("canonical"))
            rule = np.full(b.num_rows, -1)
            for i in reversed(by_length):
                rule[fits[:, i]] = i
            bad = fits[:, len(rules) :].any(axis=1)
            names = [rules[i][1] if i >= 0 else None for i in rule.tolist()]
            verdicts = [rules[i][0] if i >= 0 else "block" if x else "allow" for i, x in zip(rule.tolist(), bad.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return mapped(rows, work, "page_id long, host string, path string, rule string, verdict string")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7 over all of pages."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression, for the oracle and for tests."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + r"(.|\n)*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "-_/" else glob[i]), i + 1
    return out


def _rule_case(what: int) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    return "CASE " + " ".join(f"WHEN regexp_full_match(c, '{glob_regex('*.' + r[1] + '**')}') THEN '{r[what]}'" for r in order)


OP7_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), q AS (SELECT *, '.' || host || path AS c FROM p)
SELECT page_id, host, path, {_rule_case(1)} END AS rule,
  {_rule_case(0)} WHEN {" OR ".join(f"regexp_full_match(c, '{glob_regex(g)}')" for g in BLOCKED)} THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""
