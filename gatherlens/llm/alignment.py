"""Alignment of two tokenizers' tokens over the same texts, with corpus counts of id pairs.

Both tokenizers cut the bytes of blank + text; the places where both have a token end cut
the tokens into groups.

1. Diagonal run skipping.  With the arrays of token ends of both, slices at the current
   shift of indexes are compared, each twice as long as the one before; equal slices are
   one-to-one groups and are taken whole.  In a slice that differs, halving finds the
   first difference; the irregular group there is resolved by advancing whichever token
   ends first, and the shift is the new difference of the indexes.  Ends go on from text to
   text, so a stretch may pass the end of a text, which both have in common.
2. The links (pairs of tokens that share bytes) of a run of texts are summed by id pair
   before they leave the task: a run sends each of its pairs once, however often it has
   them.  A document's own pairs stay with the run, packed as places in the run's list.
3. The pairs' counts are a grouped sum over all runs; each pair's count goes back to the
   runs that hold the pair, and a run's documents add them up.  A run is bounded, so is
   what its group gathers; a frequent pair is one row per run in a join that the adaptive
   planner splits.

Texts are cut into pieces where both tokenizers cut them too, and each distinct piece is
encoded once per task (see ``vocab``); alignment works on the whole texts.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gatherlens.llm import vocab
from gatherlens.llm.common import chunks, staged, tidy, utf8

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 21    # bytes of the texts of a run, unless one text has more
WINDOW = 1 << 17   # tokens whose ends are lists at a time
DIFFERENT = vocab.packed([1])
# A blank and what is no white space: only the first id of such a piece has a blank.
PLAIN = re.compile(" [!-~À-ɏ]+")


def diagonal(ea: list[int], eb: list[int]):
    """Groups of two lists of token ends that end alike: yields (i0, i1, j0, j1, one),
    the tokens of either side; if ``one``, i1 - i0 groups of one token each."""
    i = j = 0
    n = len(ea)
    while i < n:
        if ea[i] == eb[j]:
            p, q, step = i + 1, j + 1, 2
            while True:
                x = ea[p:p + step]
                if x != eb[q:q + step]:
                    while step > 1:
                        step >>= 1
                        if ea[p:p + step] == eb[q:q + step]:
                            p += step
                            q += step
                    break
                p += len(x)
                q += len(x)
                if len(x) < step:
                    break
                step <<= 1
            yield i, p, j, q, True
            i, j = p, q
            if i == n:
                return
        i0, j0 = i, j
        x, y = ea[i], eb[j]
        while x != y:
            if x < y:
                i += 1
                x = ea[i]
            else:
                j += 1
                y = eb[j]
        i += 1
        j += 1
        yield i0, i, j0, j, False


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Aligner:
    """Token ids, groups and links of texts under two tokenizers."""

    def __init__(self, a: vocab.Source, b: vocab.Source, whole: bool):
        self.a, self.b = vocab.loaded(a), vocab.loaded(b)
        if a.kind == "json":
            self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.bytes_a, self.bytes_b = vocab.token_bytes(a), vocab.token_bytes(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.first_a = np.array([x[:1] == b" " for x in self.bytes_a])
        # Ids as they stand in a group of a's ids, and at its end; likewise for b.
        na, nb = len(self.bytes_a), len(self.bytes_b)
        self.names = [f"{i}{mark}" for n, marks in ((na, ",|"), (nb, ",;")) for mark in marks for i in range(n)]
        self.whole, self.exact = whole, vocab.can_cut(a)  # byte-level, nothing normalized
        self.memory = vocab.Pieces(self._encode)

    def _encode(self, pieces: list[str]):
        """Ids (u32) under both, and a 1 if the bytes of either are not the piece's."""
        ids_b = self.b.encode([p[1:] for p in pieces], num_threads=1)  # it adds the blank itself
        for i, p in enumerate(pieces):
            if len(p) == 1:  # a mark, or a last blank
                ids_b[i] = [self.b.piece_to_id(p.replace(" ", "▁"))]
        plain = [p for p in pieces if PLAIN.fullmatch(p)]
        ids_a = dict(zip(plain, vocab.encode_together(self.a, plain, "", self.first_a, None)))
        other = [p for p in pieces if p not in ids_a]
        ids_a.update(zip(other, [vocab.packed(e.ids) for e in self.a.encode_batch_fast(other, add_special_tokens=False)]))
        out = []
        for p, y in zip(pieces, ids_b):
            x, raw = ids_a[p], p.encode()
            same = raw == b"".join(map(self.bytes_b.__getitem__, y)) and (
                self.exact or raw == b"".join(map(self.bytes_a.__getitem__, memoryview(x).cast("I"))))
            out.append((x, vocab.packed(y), b"" if same else DIFFERENT))
        return out

    def tokens(self, texts: list[bytes]):
        """Ids under a and under b of all texts together, how many there are up to each
        text's end, and up to places between that both have in common.  Empty texts have
        none, nor have those whose tokens' bytes are not blank + text."""
        if self.whole:
            lists = pa.array([[b" " + t] if t else [] for t in texts], pa.list_(pa.binary()))
        else:
            lists = vocab.cut(texts)
        ((x, xs), (y, ys), (_, odd)), pieces = self.memory.ids(lists, 3)
        starts = np.concatenate([[0], pieces[:-1]])
        wrong = []
        for d in range(len(texts)):
            # What is no UTF-8 was encoded as replacement characters.
            if odd[pieces[d]] > odd[starts[d]] or b"\xef\xbf\xbd" in texts[d] or not _valid(texts[d]):
                own = (x[xs[starts[d]]:xs[pieces[d]]], self.bytes_a), (y[ys[starts[d]]:ys[pieces[d]]], self.bytes_b)
                if any(b" " + texts[d] != b"".join(map(names.__getitem__, ids)) for ids, names in own):
                    wrong.append(d)
        if wrong:
            # The sums go on without the ids of these texts.
            out = []
            for ids, sums in ((x, xs), (y, ys)):
                gone = np.zeros(len(ids), bool)
                for d in wrong:
                    gone[sums[starts[d]]:sums[pieces[d]]] = True
                out.append((ids[~gone], sums - np.concatenate([[0], np.cumsum(gone)])[sums]))
            (x, xs), (y, ys) = out
        # Some of the places where a piece ends: windows of bounded size.
        cuts = np.unique(np.concatenate([np.searchsorted(xs, np.arange(0, len(x), WINDOW)), [len(xs) - 1]]))
        return x, y, xs[pieces], ys[pieces], list(zip(xs[cuts].tolist(), ys[cuts].tolist()))

    def align(self, texts: list[bytes], strings: bool):
        """Of texts: numbers of ids under a and b, of groups and of links, the groups as text
        (or nothing), and for all links the text's number and the code: id of b, then of a,
        in 32 bits each."""
        x, y, x_ends, y_ends, cuts = self.tokens(texts)
        ea, eb = np.cumsum(self.size_a[x]), np.cumsum(self.size_b[y])
        bounds = []
        for (i, j), (i_end, j_end) in zip(cuts, cuts[1:]):
            for i0, i1, j0, j1, one in diagonal(ea[i:i_end].tolist(), eb[j:j_end].tolist()):
                bounds += (i + i0, i + i1, j + j0, j + j1, one)
        i0, i1, j0, j1, one = np.array(bounds, np.int64).reshape(-1, 5).T
        # Where each group ends: every token of a one-to-one stretch, or the last of the group.
        count = np.where(one, i1 - i0, 1)
        step = np.where(np.repeat(one, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), 0)
        a_end, b_end = (np.repeat(np.where(one, s + 1, e), count) + step for s, e in ((i0, i1), (j0, j1)))
        # Links: pairs of one-to-one groups; within the others, each stretch between two
        # neighbouring ends of either side belongs to one token of a and one of b.
        single = np.repeat(one, count).astype(bool)
        a_some, b_some = (_ranges(s[one == 0], (e - s)[one == 0]) for s, e in ((i0, i1), (j0, j1)))
        stretch = np.union1d(ea[a_some], eb[b_some])
        la = np.concatenate([a_end[single] - 1, a_some[np.searchsorted(ea[a_some], stretch)]])
        lb = np.concatenate([b_end[single] - 1, b_some[np.searchsorted(eb[b_some], stretch)]])
        owner = np.searchsorted(x_ends, la, "right")
        n = len(texts)
        groups = np.bincount(np.searchsorted(x_ends, a_end - 1, "right"), minlength=n)
        text = self._strings(x, y, a_end, b_end, x_ends, y_ends) if strings else [None] * n
        codes = y[lb].astype(np.int64) << 32 | x[la].astype(np.int64)
        return np.diff(x_ends, prepend=0), np.diff(y_ends, prepend=0), groups, np.bincount(owner, minlength=n), text, owner, codes

    def _strings(self, x, y, a_end, b_end, x_ends, y_ends) -> list[str]:
        na, nb = len(self.bytes_a), len(self.bytes_b)
        a_last, b_last = np.zeros(len(x), bool), np.zeros(len(y), bool)
        a_last[a_end - 1], b_last[b_end - 1] = True, True
        # A token of a has before it all groups' tokens of b up to its own group, and so on.
        which = np.empty(len(x) + len(y), np.int64)
        b_start = np.concatenate([[0], b_end])[:-1]
        which[np.arange(len(x)) + np.repeat(b_start, np.diff(a_end, prepend=0))] = x + np.where(a_last, na, 0)
        which[np.arange(len(y)) + np.repeat(a_end, np.diff(b_end, prepend=0))] = y + np.where(b_last, nb, 0) + 2 * na
        out, at = [], 0
        for end in (x_ends + y_ends).tolist():
            out.append("".join(map(self.names.__getitem__, which[at:end].tolist()))[:-1])
            at = end
        return out


def _valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _planes(x: np.ndarray) -> bytes:
    """u32 numbers byte by byte: the planes that are zero cost next to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _runs(a: vocab.Source, b: vocab.Source, whole: bool, form: str, schema: pa.Schema):
    """One row per run, which is a chunk of texts: its distinct codes with counts, and its
    documents."""
    def run(batches):
        aligner = Aligner(a, b, whole)
        # Unique in the staged table: a partition is written by one attempt.
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", CHUNK):
            n_a, n_b, n_groups, n_links, text, owner, codes = aligner.align(utf8(batch.column("text")), form != "none")
            if form == "sha256":
                text = [hashlib.sha256(t.encode()).hexdigest() if t else t for t in text]
            known, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
            # Distinct places of each document with their counts, in order.
            key, times = np.unique(owner * max(1, len(known)) + place, return_counts=True)
            owner, place = np.divmod(key, max(1, len(known)))
            step = np.where(np.diff(owner, prepend=-1) != 0, place, np.diff(place, prepend=0))
            yield pa.RecordBatch.from_pydict(
                {"run": [number], "codes": [known], "counts": [counts], "id": [batch.column("id")], "n_a": [n_a], "n_b": [n_b],
                 "n_groups": [n_groups], "n_links": [n_links], "groups": [text],
                 "distinct": [np.bincount(owner, minlength=len(text))], "steps": [_planes(step)], "times": [_planes(times)]}, schema)
            number += 1
    return tidy(run)


def _scored(names: list[str]):
    """Of a run and the counts of its codes: one row per document."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("code").to_numpy())
        n, best = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "best"))
        row = {c: left.column(c)[0] for c in left.column_names}
        distinct = row["distinct"].values.to_numpy()
        steps, times = _unplanes(row["steps"].as_py()), _unplanes(row["times"].as_py())
        starts = np.cumsum(distinct) - distinct
        # Places are sums of steps within a document.
        sums = np.cumsum(steps)
        before = np.concatenate([[0], sums])[starts]
        place = sums - np.repeat(before, distinct)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(starts, len(x))])
        return pa.table([row["id"].values, *[row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")],
                         pa.array(total(best[place] * times)), pa.array(total(n[place] * times)), row["groups"].values], names=names)
    return tidy(run)


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None,
          groups: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_a and n_b (tokens), n_groups, n_links (pairs of
    tokens that share bytes), n_best (links whose id pair is the most frequent of its id of
    b, ties included), count_sum (the links' pair counts, added up) and groups: all groups in
    order, as ``a1,a2|b1;a3|b2,b3``; with ``groups`` = 'sha256' its digest, with 'none' null.

    ``a`` is a byte-level ``tokenizers`` JSON file, ``b`` a SentencePiece model.  Texts that
    are null, empty, or of which either tokenizer does not keep all bytes have no tokens:
    zeros and ''.  Strings of special tokens are plain text.  Repeated rows count each;
    empty tables give no rows; other columns play no part, whatever their names.
    """
    if groups not in ("text", "sha256", "none"):
        raise ValueError("groups is 'text', 'sha256' or 'none'")
    a, b = vocab.read(a or vocab.public(A)), vocab.read(b or vocab.public(B))
    whole = not (vocab.can_cut(a) and vocab.can_cut(b))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lists = f"id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, distinct array<long>, steps binary, times binary"
    schema = f"run long, codes array<long>, counts array<long>, {lists}"
    runs = staged(rows.mapInArrow(_runs(a, b, whole, groups, to_arrow_schema(StructType.fromDDL(schema))), schema), "runs")
    pairs = runs.select("run", F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("run", F.col("p.codes").alias("code"), F.col("p.counts").alias("n"))
    scored = pair_counts(pairs)
    found = pairs.select(F.col("run").alias("of"), "code").join(scored, "code")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    out = runs.drop("codes", "counts").groupBy("run").cogroup(found.groupBy("of")).applyInArrow(
        _scored(names), f"id {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", groups string")
    return out.withColumnRenamed("id", id_col)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(code, n, best) of rows (code, n): sums, and whether a sum is the highest of those
    with the same id of b (the code's upper half; as many as its vocabulary has ids)."""
    counts = staged(pairs.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", F.shiftright("code", 32).cast("int")), "pair-counts")
    top = staged(counts.groupBy("b").agg(F.max("n").alias("top")), "top-counts")
    return staged(counts.join(top, "b").select("code", "n", (F.col("n") == F.col("top")).alias("best")), "scored-pairs")
