"""Exact removal of repeated 400-byte strings.

A suffix array by external induced sorting moves a tuple for every byte of the corpus
through each exchange; this job moves tuples for sampled suffixes only and gives the
same spans (README: why).  The sample is made of local minima, as in induced sorting,
but with a wide neighbourhood, so that every 400-byte string holds one:

1. A 300-byte gram is hashed at each place; the places where the hash is the least of a
   400-byte string's grams are its anchors.  Equal strings have equal anchors at equal
   offsets.  An anchor's tuple is its gram's hash, the hash of its context (all bytes of
   all strings that it can be the anchor of), document and place.
2. Tuples are sorted in runs within tasks and merged by ranges of the gram's hash.  A gram
   that occurs once ends here.  Where all contexts of a gram are equal, they are
   repeated as a whole.  Where a gram has several contexts, each run's distinct contexts
   go to the next round: the hashes of their strings (each has one anchor) are sorted
   and merged likewise, and those that occur twice or more are repeated.
3. The repeated contexts and strings of a document are joined to it, and the bytes that
   they cover are removed.

Runs combine before the exchange: a gram or string that is frequent within a run sends
one tuple, however many documents hold it.  Hashes are 64-bit (polynomial over keyed
bytes); rows are known by two 64-bit hashes of id and text.  Long texts are worked through in
bounded segments.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import chunks, mix, row_hash, staged, tidy, utf8

LENGTH, GRAM = 400, 300
REACH = LENGTH - GRAM + 1       # grams in a string
SEGMENT = 1 << 17               # strings handled at a time
CHUNK = 1 << 20
RUN, RANGE = 1 << 18, 1 << 17   # tuples of a run, and of a range on average
ANCHORS_PER_BYTE = 2 / (REACH + 1)

_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(
    SEGMENT + 4 * LENGTH, 0x9E3779B97F4A7C15, np.uint64)]))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


class Hashes:
    """Hashes of any substring of a piece of text."""

    def __init__(self, b: np.ndarray):
        self.n = len(b)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTES[b] * _POWERS[:self.n], out=self.sums[1:])

    def of(self, start, end, salt=0):
        """Of [start, end), with the salt mixed in."""
        return mix((self.sums[end] - self.sums[start]) * _POWERS[len(_POWERS) - 1 - start] + np.uint64(1) * salt)


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each window of ``w`` neighbours."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, fill, np.uint64)]).reshape(-1, w)
    ahead = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n - w + 1], ahead[w - 1:n])


def _segments(text: bytes):
    """(place of the piece in the text, piece, first and last + 1 string of the segment in
    the piece): pieces hold the contexts of all anchors of the segment's strings."""
    b = np.frombuffer(text, np.uint8)
    strings = len(b) - LENGTH + 1
    for s in range(0, max(strings, 0), SEGMENT):
        e = min(s + SEGMENT, strings)
        low, high = max(0, s - REACH), min(len(b), e + 2 * LENGTH)
        yield low, b[low:high], s - low, e - low


def _anchors(b: np.ndarray, h: Hashes, first: int, last: int):
    """Anchors of the strings first..last-1, their gram hashes, each string's least hash."""
    places = np.arange(first, last - 1 + REACH)
    grams = h.of(places, places + GRAM)
    least = _sliding(grams, REACH, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    edge = np.zeros(REACH - 1, np.uint64)
    greatest = _sliding(np.concatenate([edge, least, edge]), REACH, np.maximum, np.uint64(0))
    at = np.flatnonzero(greatest == grams)
    return at + first, grams[at], least


def tuples(text: bytes):
    """(gram hash, context hash, place) of each anchor of a text."""
    out = []
    for low, b, first, last in _segments(text):
        h = Hashes(b)
        at, grams, _ = _anchors(b, h, first, last)
        # A context ends at the text's ends; a piece holds it whole.
        start, end = np.maximum(at - (REACH - 1), 0), np.minimum(at + LENGTH, len(b))
        salt = mix((at - start).astype(np.uint64) << np.uint64(32) | (end - at).astype(np.uint64))
        out.append((grams, h.of(start, end, salt), at + low))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, contexts, places = (np.concatenate(x) for x in zip(*out))
    # Segments share grams at their edges.
    _, one = np.unique(places, return_index=True)
    return grams[one], contexts[one], places[one]


def strings(text: bytes, chosen: np.ndarray):
    """(hash, start) of each string whose first anchor is one of the chosen places."""
    out = []
    for low, b, first, last in _segments(text):
        h = Hashes(b)
        at, grams, least = _anchors(b, h, first, last)
        s = np.arange(first, last)
        i = np.searchsorted(at, s)
        wrong = np.flatnonzero(grams[i] != least)
        while len(wrong):
            i[wrong] += 1
            wrong = wrong[grams[i[wrong]] != least[wrong]]
        s = s[np.isin(at, chosen - low)[i]]
        out.append((h.of(s, s + LENGTH, np.uint64(0x5bd1e995)), s + low))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, places = (np.concatenate(x) for x in zip(*out))
    return hashes, places


# Blocks hold tuples sorted by their first hash, packed byte by byte.

def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


# A document is known by 128 bits.
KEY, SIGNED = np.dtype([("a", np.uint64), ("b", np.uint64)]), np.dtype([("a", np.int64), ("b", np.int64)])
BLOCK = "bucket long, kind int, codes binary, contexts binary, known binary, which binary, places binary"
TUPLE, MARK, CLEAR = 0, 1, 2  # to be merged; known to be several; already decided (contexts: flags)
COVERED, OPEN = 1, 2


def _blocks(kind, ranges, codes, contexts, keys, places, run=0):
    """Block rows of sorted tuples, one for each range of codes."""
    if not len(codes):
        return []
    if kind == CLEAR:  # nothing to merge: parts of the run, each in a bucket of its own
        heads = np.arange(0, len(codes), RANGE)
        bucket = np.repeat(-1 - (run * RUN + np.arange(len(heads))), RANGE)[:len(codes)]
    else:
        bucket = ((codes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        heads = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    out = []
    for a, z in zip(heads.tolist(), np.append(heads[1:], len(codes)).tolist()):
        known, which = _numbered(keys[a:z])
        out.append((int(bucket[a]), kind,
                    _planes(np.diff(codes[a:z], prepend=np.uint64(0))), contexts[a:z].tobytes(), known.tobytes(),
                    _planes(which.astype(np.uint32)), _planes(places[a:z].astype(np.uint64))))
    return out


def _numbered(keys):
    """Distinct keys, and the number of each one's."""
    _, first, which = np.unique(keys["a"] ^ mix(keys["b"].copy()), return_index=True, return_inverse=True)
    known = keys[first]
    return (known, which) if (known[which] == keys).all() else np.unique(keys, return_inverse=True)


def _batch(rows):
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                      names=[c.split()[0] for c in BLOCK.split(", ")])


def _unpacked(table: pa.Table):
    """kind, codes, contexts, keys, places of all tuples of a range."""
    parts = []
    for r in table.to_pylist():
        codes = np.cumsum(_unplanes(r["codes"], np.uint64))
        parts.append((np.full(len(codes), r["kind"], np.int8), codes, np.frombuffer(r["contexts"], np.uint64),
                      np.frombuffer(r["known"], KEY)[_unplanes(r["which"], np.uint32)],
                      _unplanes(r["places"], np.uint64).astype(np.int64)))
    return [np.concatenate(x) for x in zip(*parts)]


def _groups(*columns):
    """Heads of runs of equal rows of sorted columns, and their sizes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    heads = np.flatnonzero(new)
    return heads, np.diff(np.append(heads, len(new)))


def _runs(batches, make, most, close):
    """Gathers tuples of texts into runs of about ``most`` and closes each with its number."""
    held, n = [], 0
    numbers = itertools.count(TaskContext.get().partitionId() << 20)
    for batch in chunks(batches, "text", CHUNK):
        keys = np.array([tuple(map(int, k.split(":"))) for k in batch.column("key").to_pylist()], SIGNED).view(KEY)
        for i, text in enumerate(utf8(batch.column("text"))):
            if len(text) < LENGTH:
                continue
            a, b, place = make(batch, i, text)
            if len(a):
                held.append((a, b, np.repeat(keys[i:i + 1], len(a)), place))
                n += len(a)
            if n >= most:
                yield close(*[np.concatenate(x) for x in zip(*held)], next(numbers))
                held, n = [], 0
    if held:
        yield close(*[np.concatenate(x) for x in zip(*held)], next(numbers))


def _anchor_blocks(ranges):
    def close(grams, contexts, keys, places, number):
        order = np.lexsort((contexts, grams))
        grams, contexts, keys, places = grams[order], contexts[order], keys[order], places[order]
        class_at, class_size = _groups(grams, contexts)
        gram_at, gram_classes = _groups(grams[class_at])
        mixed = np.repeat(gram_classes > 1, gram_classes)          # by class
        flag = np.repeat(np.where(class_size > 1, COVERED, 0), class_size)
        flag[class_at[mixed]] |= OPEN
        clear = flag > 0
        rows = _blocks(CLEAR, ranges, grams[clear], flag[clear].astype(np.uint64), keys[clear], places[clear], number)
        one, heads = class_at[~mixed], class_at[gram_at[gram_classes > 1]]
        rows += _blocks(TUPLE, ranges, grams[one], contexts[one], keys[one], places[one])
        return _batch(rows + _blocks(MARK, ranges, grams[heads], contexts[heads], keys[heads], places[heads]))

    def run(batches):
        yield from _runs(batches, lambda batch, i, text: tuples(text), RUN, close)
    return tidy(run)


DECIDED = "a long, b long, place long, flag int"
ROW = ["a", "b"]


def _decided(keys, places, flags) -> pa.Table:
    return pa.table({**_halves(keys), "place": pa.array(places, pa.int64()), "flag": pa.array(flags, pa.int32())})


def _halves(keys) -> dict:
    return {c: pa.array(keys[c].view(np.int64) if len(keys) else np.zeros(0, np.int64)) for c in ROW}


def _merged_anchors(table: pa.Table) -> pa.Table:
    kind, grams, contexts, keys, places = _unpacked(table)
    if kind[0] == CLEAR:
        return _decided(keys, places, contexts.astype(np.int64))
    order = np.lexsort((contexts, kind, grams))
    kind, grams, contexts, keys, places = (x[order] for x in (kind, grams, contexts, keys, places))
    at, size = _groups(grams)
    marked = np.add.reduceat((kind == MARK).astype(np.int64), at) > 0
    class_at, class_size = _groups(grams, kind, contexts)
    classes = np.add.reduceat(np.isin(np.arange(len(grams)), class_at).astype(np.int64), at)
    flag = np.repeat(np.where(class_size > 1, COVERED, 0), class_size)
    flag |= np.where(np.repeat(marked | (classes > 1), size), OPEN, 0)
    keep = (flag > 0) & (kind == TUPLE)
    return _decided(keys[keep], places[keep], flag[keep])


def _string_blocks(ranges):
    def close(codes, none, keys, places, number):
        order = np.argsort(codes, kind="stable")
        codes, none, keys, places = codes[order], none[order], keys[order], places[order]
        at, size = _groups(codes)
        many = np.repeat(size > 1, size)
        heads = at[size > 1]
        rows = _blocks(CLEAR, ranges, codes[many], none[many], keys[many], places[many], number)
        rows += _blocks(TUPLE, ranges, codes[~many], none[~many], keys[~many], places[~many])
        return _batch(rows + _blocks(MARK, ranges, codes[heads], none[heads], keys[heads], places[heads]))

    def make(batch, i, text):
        hashes, places = strings(text, np.array(batch.column("open")[i].as_py(), np.int64))
        return hashes, np.zeros(len(hashes), np.uint64), places

    def run(batches):
        yield from _runs(batches, make, RUN, close)
    return tidy(run)


def _merged_strings(table: pa.Table) -> pa.Table:
    kind, codes, _, keys, places = _unpacked(table)
    if kind[0] != CLEAR:
        order = np.argsort(codes, kind="stable")
        kind, codes, keys, places = kind[order], codes[order], keys[order], places[order]
        _, size = _groups(codes)
        keep = np.repeat(size > 1, size) & (kind == TUPLE)
        keys, places = keys[keep], places[keep]
    return pa.table({**_halves(keys), "start": pa.array(places, pa.int64())})


def spans_of(n: int, covered, starts) -> np.ndarray:
    """Maximal removed runs (start, end) of a text of ``n`` bytes."""
    covered, starts = np.array(covered, np.int64), np.array(starts, np.int64)
    a = np.concatenate([np.maximum(covered - (REACH - 1), 0), starts])
    z = np.concatenate([np.minimum(covered + LENGTH, n), starts + LENGTH])
    if not len(a):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    heads = np.concatenate([[0], np.flatnonzero(a[1:] > z[:-1]) + 1])
    return np.stack([a[heads], z[np.append(heads[1:] - 1, len(z) - 1)]], axis=1)


def whole_characters(text: bytes, spans: list) -> str:
    """The text without the characters of which a byte is in one of the spans."""
    parts, at = [], 0
    for a, z in spans:
        while a < len(text) and text[a] & 0xC0 == 0x80:
            a -= 1
        while z < len(text) and text[z] & 0xC0 == 0x80:
            z += 1
        parts.append(text[at:max(a, at)])
        at = z
    return b"".join([*parts, text[at:]]).decode("utf-8", "replace")


def _cleaned(batches):
    for batch in chunks(batches, "text", CHUNK):
        spans, kept, texts = [], [], []
        for text, covered, starts in zip(utf8(batch.column("text")), batch.column("covered").to_pylist(),
                                         batch.column("starts").to_pylist()):
            found = spans_of(len(text), covered or [], starts or [])
            spans.append([{"start": int(a), "end": int(z)} for a, z in found])
            parts, at = [], 0
            for a, z in found.tolist():
                parts.append(text[at:a])
                at = z
            kept.append(b"".join([*parts, text[at:]]) if len(found) else text)
            texts.append(whole_characters(text, found.tolist()))
        sizes = [len(t) for t in kept]
        removed = [sum(s["end"] - s["start"] for s in x) for x in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([a + b for a, b in zip(sizes, removed)], pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(texts, pa.string())],
            names=["id", "n_bytes", "n_removed", "spans", "kept", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_removed, spans (maximal removed
    runs, in bytes, end exclusive), kept (the remaining bytes) and text (the remaining whole
    characters: those that lost a byte are left out).

    A byte goes if a 400-byte string of the input that covers it also starts anywhere
    else, in the same text or another; strings do not cross texts.  Null texts are
    empty.  Repeated rows repeat each other's texts.  Empty tables give no rows.  Other
    columns play no part, whatever their names.
    """
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("key", row_hash(F.col("id").cast("string"), "text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, int(total * ANCHORS_PER_BYTE) // RANGE + 1)
    anchors = rows.select("key", "text").mapInArrow(_anchor_blocks(ranges), BLOCK).groupBy("bucket").applyInArrow(
        tidy(_merged_anchors), DECIDED)
    anchors = staged(anchors.groupBy(*ROW, "place").agg(F.bit_or("flag").alias("flag")), "anchors")

    open_ = staged(anchors.where(F.col("flag").bitwiseAND(OPEN) > 0).groupBy(*ROW).agg(
        F.collect_list("place").alias("open")).withColumn("key", F.concat_ws(":", *ROW)), "open-anchors")
    n_open = open_.agg(F.sum(F.size("open"))).first()[0] or 0
    ranges = max(1, int(n_open / ANCHORS_PER_BYTE) // RANGE + 1)
    found = staged(rows.select("key", "text").join(open_.select("key", "open"), "key").mapInArrow(_string_blocks(ranges), BLOCK)
                   .groupBy("bucket").applyInArrow(tidy(_merged_strings), "a long, b long, start long"), "strings")

    covered = anchors.where(F.col("flag").bitwiseAND(COVERED) > 0).groupBy(*ROW).agg(
        F.collect_list("place").alias("covered"))
    starts = found.groupBy(*ROW).agg(F.collect_set("start").alias("starts"))
    marks = staged(covered.join(starts, ROW, "full").select(F.concat_ws(":", *ROW).alias("key"), "covered", "starts"), "repeats")
    return rows.join(marks, "key", "left").select("id", "text", "covered", "starts").mapInArrow(
        tidy(_cleaned), f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, text string"
    ).withColumnRenamed("id", id_col)
