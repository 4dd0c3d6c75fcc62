"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over lower-case byte trigrams is
derived: all of its clauses must hold, a clause holds if one of its alternatives has
all its trigrams.  Each chunk of texts in a task is one index segment: a posting list
(text numbers) for every trigram that some rule asks for, built in one vectorised pass
over the segment's bytes.  Postings are intersected and united per rule, and only the
candidates are searched with the regular expression.  A rule without a mandatory
trigram scans every text.  There is no shuffle, and memory is bounded by a segment (one
text at least).
"""
from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import chunks, utf8

MAX_ALTERNATIVES = 64


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0     # the group whose length counts
    least: int = 0     # its least length; shorter matches are dropped
    flags: int = 0


# The base rules, in the order of kinds.  A maximal run of hex digits has
# 24 or more exactly if {24,} finds it, so the length is part of that pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         re.IGNORECASE | re.ASCII),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# A PEM block up to its END line.  Without one, up to the end of its base64 body: header
# lines, lines of base64 digits only, and pieces that are long or padded; line ends may be
# written as \n, lines may be quoted.  No bound cuts a secret's length.
_LABEL = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_TO_END = r"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END " + _LABEL
_GAP = r"""(?:\s|\\+[rn]|["',>#*|])*+"""
_HEADERS = _GAP + r"(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Version|Comment|Hash|Charset|MessageID): [^\r\n\\]*+"
_PIECE = _GAP + r"""(?:[A-Za-z0-9+/]{20,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+|[A-Za-z0-9+/]++(?=["',+\x20\t]*+(?:[\r\n\\]|\Z)))"""
EXTRA = (
    Rule("private_key", rf"-----BEGIN {_LABEL}(?:{_TO_END}|(?:{_HEADERS})*+(?:{_PIECE})*+)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]+://[^/\s:@]+:[^/\s:@]+@"),
)
RULES = BASE + EXTRA


def trigram_query(rule: Rule) -> list[list[frozenset]]:
    """Clauses (all must hold) of alternatives (one must) of trigrams (all must occur in
    the lower-cased text).  No clause: no trigram is mandatory."""
    return _clauses(_parser.parse(rule.pattern, rule.flags))


def _exact(items) -> set[str] | None:
    """All strings that a small expression matches, or None."""
    found = {""}
    for op, arg in items:
        if op is C.LITERAL:
            more = {chr(arg)}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            more = {chr(a) for _, a in arg}
        elif op is C.SUBPATTERN:
            more = _exact(arg[3])
        elif op is C.BRANCH:
            each = [_exact(x) for x in arg[1]]
            more = None if None in each else set().union(*each)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4:
            one = _exact(arg[2])
            more = None if one is None else {"".join(p) for n in range(arg[0], int(arg[1]) + 1) for p in product(one, repeat=n)}
        else:
            return None
        if more is None or len(found) * len(more) > MAX_ALTERNATIVES:
            return None
        found = {a + b for a in found for b in more}
    return found


def _clauses(items) -> list[list[frozenset]]:
    out, run = [], {""}

    def flush():
        nonlocal run
        each = {frozenset(b[i:i + 3] for i in range(len(b) - 2)) for b in (s.encode().lower() for s in run)}
        if frozenset() not in each:
            out.append([x for x in each if not any(y < x for y in each)])
        run = {""}

    for op, arg in items:
        more = _exact([(op, arg)])
        if more is not None and len(run) * len(more) <= MAX_ALTERNATIVES:
            run = {a + b for a in run for b in more}
            continue
        if more is not None:
            flush()
            run = more
            continue
        if op is C.SUBPATTERN:
            flush()
            out += _clauses(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            once = _exact(arg[2])
            if once is not None and len(run) * len(once) <= MAX_ALTERNATIVES:
                run = {a + b for a in run for b in once}
                flush()
            else:
                flush()
                out += _clauses(arg[2])
        elif op is not C.AT:
            flush()
    flush()
    return out


def postings(texts: list[bytes], slots: np.ndarray) -> dict[int, np.ndarray]:
    """Numbers of the texts that hold each wanted trigram.  ``slots``: by trigram code,
    its number from 1, 0 for trigrams that no rule asks for."""
    joined = np.frombuffer(b"\0\0".join([*texts, b""]).lower(), np.uint8)
    if len(joined) < 3:
        return {}
    code = joined[:-2].astype(np.uint32) << np.uint32(16)
    code |= joined[1:-1].astype(np.uint32) << np.uint32(8)
    code |= joined[2:]
    found = slots[code]
    at = np.flatnonzero(found)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])
    owner = np.searchsorted(starts, at, "right") - 1
    pairs = np.unique(found[at].astype(np.int64) << 32 | owner)
    cuts = np.flatnonzero(np.diff(pairs >> 32)) + 1
    return {int(part[0] >> 32): part & 0xFFFFFFFF for part in np.split(pairs, cuts) if len(part)}


def candidates(query, index: dict[int, np.ndarray], numbers: dict[bytes, int]) -> np.ndarray:
    """Text numbers for which the query holds."""
    none = np.zeros(0, np.int64)
    result = None
    for clause in query:
        held = none
        for grams in clause:
            lists = sorted((index.get(numbers[g], none) for g in grams), key=len)
            both = lists[0]
            for x in lists[1:]:
                both = np.intersect1d(both, x, assume_unique=True)
            held = np.union1d(held, both)
        result = held if result is None else np.intersect1d(result, held, assume_unique=True)
    return result


class Scanner:
    """The rules with their queries; one per task."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r)) for r in rules]
        grams = sorted({g for _, _, q in self.rules for clause in q for alt in clause for g in alt})
        self.numbers = {g: i + 1 for i, g in enumerate(grams)}
        self.slots = np.zeros(1 << 24, np.uint16)
        for g, i in self.numbers.items():
            self.slots[g[0] << 16 | g[1] << 8 | g[2]] = i

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text in code points, by start, then kind."""
        index = postings(texts, self.slots)
        found: list[list] = [[] for _ in texts]
        strings: dict[int, str] = {}
        for order, (rule, regex, query) in enumerate(self.rules):
            for i in (candidates(query, index, self.numbers).tolist() if query else range(len(texts))):
                if i not in strings:
                    strings[i] = texts[i].decode("utf-8")
                for m in regex.finditer(strings[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), order, m.end()))
        return [[(s, e, self.rules[k][0].kind) for s, k, e in sorted(x)] for x in found]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (kind, start, end)
    by start and then rule order, in code points, end exclusive; per rule the matches
    are leftmost and do not overlap.  Null and empty texts have no spans; repeated rows
    are scanned alike; other columns play no part."""
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def run(batches):
        scanner = Scanner(rules)
        for batch in chunks(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in scanner.scan(utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(SPAN))], names=["id", "spans"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text: str = "text", rules=RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones merged) of the text replaced by
    ``mark``; all rows, columns and their order stay, null texts stay null."""
    at = 0

    def run(batches):
        scanner = Scanner(rules)
        for batch in chunks(batches, "text"):
            texts = utf8(batch.column(at))
            new, changed = batch.column(at).to_pylist(), False
            for i, spans in enumerate(scanner.scan(texts)):
                if spans:
                    new[i], changed = _masked(new[i], spans, mark), True
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch

    # The other columns go along as one value, so their names are of no matter.
    others = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(F.col(f"`{text}`").alias("text"), others.alias("others"))
    out = rows.mapInArrow(run, rows.schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col("others").getField(c).alias(c) for c in docs.columns])


def _masked(text: str, spans, mark: str) -> str:
    parts, end = [], 0
    for s, e, _ in spans:
        if s >= end:
            parts += [text[end:s], mark]
        end = max(end, e)
    return "".join([*parts, text[end:]])
