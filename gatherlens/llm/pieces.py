"""SentencePiece encoding by sampling, and decoding.

Every text spans a lattice of vocabulary pieces; a segmentation's probability is the
product of its pieces' weights over the sum for all segmentations.  ``encode`` draws
``k`` distinct segmentations without replacement by Gumbel top-k: an A-star search from
the root, whose queue holds subtrees with their perturbed maxima.  The best subtree is
followed to its leaf by ancestral sampling (the child that takes over its parent's
maximum is drawn by the children's masses); the siblings passed on the way enter the
queue with Gumbel values of their log-mass truncated at the parent's maximum.  A random
number has 53 bits, so a subtree's value exceeds its log-mass by 37.5 at most: parts of
a path whose log-mass cannot reach the queue any more are not opened.  The (k+1)-th
value is the threshold of the inclusion probabilities.

All random numbers are hashes of the row key, the place and the sample, so the result
does not depend on partitions.  No piece holds a blank after its start, so a text's
lattice is a chain of those of its blank-led units; the units of a chunk of texts are
handled together in arrays.  There is no shuffle.
"""
from __future__ import annotations

import hashlib
import itertools
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import chunks, mix, release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
BLANK, LITERAL_BLANK = 0x2581, 0x110000
UNIT = re.compile(r" *[^ ]+| +")
STEP, PLACE, SAMPLE, RANK = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                    0x27D4EB2F165667C5))
FACTOR = np.uint64(0x100000001B3)
SLOT_BITS = 20
CUT, REACH = -3.0, 37.5
LOG_UNIT = float(1 << 32)


class Vocabulary(NamedTuple):
    """Texts (bytes, blanks plain) by id for decoding; pieces that can be matched with
    their ids and log weights; ids of the 256 byte pieces and their log weight."""
    texts: list
    pieces: list
    ids: list
    weights: list
    byte_ids: list
    byte_weight: float


def load(model_file: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model.  Scores of a BPE model are negative merge ranks; the
    log weight of a piece is minus the logarithm of one plus its rank.  Byte pieces are
    rarer than every other piece."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    texts, pieces, ids, weights, byte_ids = [], [], [], [], [0] * 256
    for i in range(m.vocab_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            texts.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            texts.append(b"")
        else:
            texts.append(p.replace("▁", " ").encode("utf-8"))
            if "▁" in p.lstrip("▁"):
                raise ValueError(f"piece {p!r} holds a blank after its start")
            if p.strip("▁"):
                # A run of blanks may precede a word, so these pieces hold one blank at most.
                if p.startswith("▁▁"):
                    raise ValueError(f"piece {p!r} starts with two blanks")
            pieces.append(p)
            ids.append(i)
            weights.append(-float(np.log1p(max(0.0, -m.get_score(i)))))
    return Vocabulary(texts, pieces, ids, weights, byte_ids, min(weights) - 2.0)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, each followed by a 0, and the place of each start."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.zeros(starts[-1], np.uint32)
    inner = np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    out[inner] = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    return out, starts


class Matcher:
    """The vocabulary as hash tables; one per task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        prefixes, hashes = set(), []
        for p in v.pieces:
            h = 0
            for c in p:
                h = (h * int(FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes.add(h)
            hashes.append(h)
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.array(hashes, np.uint64)[order]
        assert len(np.unique(self.hashes)) == len(hashes)
        self.ids = np.array(v.ids, np.int64)[order]
        self.weights = np.array(v.weights)[order]
        # By slot: 0 nothing starts so, 1 a piece may start so, 2 a piece may be so.
        self.slots = np.zeros(1 << SLOT_BITS, np.uint8)
        self.slots[self._slot(np.array(sorted(prefixes), np.uint64))] = 1
        self.slots[self._slot(self.hashes)] = 2
        self.longest = max(map(len, v.pieces))

    @staticmethod
    def _slot(h):
        return mix(h) >> np.uint64(64 - SLOT_BITS)


class Lattice:
    """The lattices of distinct units.  A node is a place in the units' code points, its
    edges are first[node] up to first[node + 1], the shortest first; ``cum`` are
    cumulative probabilities within a node, ``logp`` the logarithms of the single ones,
    ``flat[token:token + width]`` the ids."""

    def __init__(self, m: Matcher, units: list[str]):
        code, self.roots = _codes(units)
        self.end = np.zeros(len(code) + 1, bool)
        self.end[self.roots[1:] - 1] = True
        self.end[-1] = True
        code = np.where(code == BLANK, LITERAL_BLANK, np.where(code == 32, BLANK, code)).astype(np.uint64)
        inner = np.flatnonzero(~self.end[:-1])
        degree = np.zeros(len(code) + 1, np.int64)
        at, h, found = inner, np.zeros(len(inner), np.uint64), []
        for size in range(1, m.longest + 1):
            h = h * FACTOR + code[at + (size - 1)] + np.uint64(1)
            state = m.slots[m._slot(h)]
            some = np.flatnonzero(state == 2)
            place = np.minimum(np.searchsorted(m.hashes, h[some]), len(m.hashes) - 1)
            good = m.hashes[place] == h[some]
            start, place = at[some[good]], place[good]
            found.append((start, degree[start], size, m.ids[place], m.weights[place]))
            degree[start] += 1
            if size == 1:
                rest = inner[degree[inner] == 0]
                kinds, which = np.unique(code[rest], return_inverse=True)
                coded = [chr(int(c) if c != LITERAL_BLANK else BLANK).encode("utf-8") for c in kinds]
                widths = np.array([len(b) for b in coded], np.int64)
                tokens = len(m.v.texts) + np.cumsum(widths) - widths
                found.append((rest, degree[rest], 1, tokens[which], m.v.byte_weight * widths[which]))
                degree[rest] += 1
            on = np.flatnonzero((state > 0) & ~self.end[at + size])
            at, h = at[on], h[on]
            if not len(at):
                break
        # Ids stand for themselves; the bytes of characters outside the vocabulary follow.
        self.flat = np.concatenate([np.arange(len(m.v.texts)),
                                    np.array([m.v.byte_ids[x] for b in coded for x in b], np.int64)])
        self.first = np.concatenate([[0], np.cumsum(degree)])
        n = int(self.first[-1])
        self.start = np.repeat(np.arange(len(degree)), degree)
        self.next, self.token, weight = np.empty(n, np.int64), np.empty(n, np.int32), np.empty(n)
        for start, rank, size, token, w in found:
            spot = self.first[start] + rank
            self.next[spot], self.token[spot], weight[spot] = start + size, token, w
        self.width = np.ones(n, np.uint8)
        outside = np.flatnonzero(self.token >= len(m.v.texts))
        self.width[outside] = widths[np.searchsorted(tokens, self.token[outside])] if len(outside) else 1
        self._masses(weight, degree, inner)

    def _masses(self, weight, degree, inner):
        """Log-mass of all ways from each node to its unit's end, then probabilities."""
        sizes = np.diff(self.roots)
        left = np.repeat(self.roots[1:] - 1, sizes)[inner] - inner
        if len(left) and left.max() < 1 << 15:
            left = left.astype(np.int16)  # sorted by counting
        order = np.argsort(left, kind="stable")
        nodes = inner[order]
        edges = np.repeat(self.first[nodes], degree[nodes]) + runs(degree[nodes])
        heads = np.cumsum(degree[nodes]) - degree[nodes]
        cuts = np.append(np.flatnonzero(np.diff(left[order], prepend=-1)), len(nodes))
        value, to = weight[edges], self.next[edges]
        beta = np.zeros(len(self.end))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e, f = heads[a], heads[z] if z < len(heads) else len(edges)
            part = value[e:f] + beta[to[e:f]]
            most = part.max()  # weights of one step differ little; far below it, a way has no mass
            if part.min() > most - 600:
                beta[nodes[a:z]] = most + np.log(np.add.reduceat(np.exp(part - most), heads[a:z] - e))
            else:
                top = np.maximum.reduceat(part, heads[a:z] - e)
                total = np.add.reduceat(np.exp(part - np.repeat(top, degree[nodes[a:z]])), heads[a:z] - e)
                beta[nodes[a:z]] = top + np.log(total)
        self.logp = np.minimum(weight + beta[self.next] - beta[self.start], 0.0)
        # Sums stay within a node, so that they do not depend on the other units.
        self.cum = np.exp(self.logp)
        on, rank = inner[degree[inner] > 1], 1
        while len(on):
            spot = self.first[on] + rank
            self.cum[spot] += self.cum[spot - 1]
            rank += 1
            on = on[degree[on] > rank]
        self.cum[self.first[inner + 1] - 1] = 1.0

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ancestral samples from nodes to their units' ends: the edges of all walks one
        after another, and the number of each."""
        on = np.flatnonzero(~self.end[nodes])
        at, step, owners, edges = nodes[on], 0, [], []
        while len(on):
            u = unit(mix(seeds[on] + np.uint64(step * int(STEP) & 0xFFFFFFFFFFFFFFFF)))
            e = self.first[at]
            more = np.flatnonzero(u >= self.cum[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= self.cum[e[more]]]
            owners.append(on)
            edges.append(e)
            at = self.next[e]
            keep = ~self.end[at]
            on, at, step = on[keep], at[keep], step + 1
        counts = np.zeros(len(nodes), np.int64)
        for x in owners:
            counts[x] += 1
        offsets = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for step, (x, e) in enumerate(zip(owners, edges)):
            out[offsets[x] + step] = e
        return out, counts

    def ids(self, edges: np.ndarray, owner_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the edges, and how many come from each run of edges."""
        width, token = self.width[edges].astype(np.int64), self.token[edges]
        ends = np.cumsum(width)
        out = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(token - (ends - width), width)]
        total = np.concatenate([[0], ends])
        stops = np.cumsum(owner_sizes)
        return out, total[stops] - total[stops - owner_sizes]


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0 ** -53


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def sample_chunk(m: Matcher, texts: list[str], seeds: np.ndarray, k: int):
    """For each text up to ``k`` (edges, log-probability, perturbed value), best value
    first, and the (k+1)-th value: arrays over samples in the order drawn."""
    units = [UNIT.findall(" " + t) if t else [] for t in texts]
    n_units = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.empty(int(n_units.sum()), object)
    flat[:] = list(itertools.chain.from_iterable(units))
    which, known = pd.factorize(flat)
    lat = Lattice(m, known.tolist())
    roots = lat.roots[which]
    first_unit = np.cumsum(n_units) - n_units
    n, drawn = len(texts), []
    # Store of the paths' edges with the unit (in its text) of each; a path is a slice.
    store_edge, store_unit = np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets, sizes = [], []
    queue = {c: np.zeros(0, t) for c, t in (("text", np.int64), ("value", float), ("path", np.int64), ("place", np.int64),
                                            ("edge", np.int64), ("mass", float))}
    g0 = -np.log(-np.log(unit(mix(seeds ^ SAMPLE)) + 2.0 ** -54))
    top = {"text": np.arange(n), "value": g0, "path": np.zeros(n, np.int64), "place": np.zeros(n, np.int64),
           "edge": np.full(n, -1), "mass": np.zeros(n)}
    for j in range(k):
        who = top["text"]
        if not len(who):
            break
        has = top["edge"] >= 0
        # What the new path shares with the one it leaves, then the edge that leaves it.
        kept = top["place"]
        if j:
            base = np.array([offsets[p][t] for p, t in zip(top["path"].tolist(), who.tolist())], np.int64)
        else:
            base = np.zeros(len(who), np.int64)
        from_unit = np.zeros(len(who), np.int64)
        if j:
            from_unit = store_unit[base + kept]
        # Walks: the rest of the unit in which it leaves, and all units after it.
        count = n_units[who] - from_unit
        owner = np.repeat(np.arange(len(who)), count)
        within = runs(count) + from_unit[owner]
        nodes = roots[first_unit[who][owner] + within].copy()
        if j:
            heads = (np.cumsum(count) - count)[has]
            nodes[heads] = lat.next[top["edge"][has]]
        walk_seeds = mix(seeds[who][owner] + within.astype(np.uint64) * PLACE + np.uint64((j + 1) * int(SAMPLE) & 0xFFFFFFFFFFFFFFFF))
        walked, steps = lat.walk(nodes, walk_seeds)
        walked_unit = np.repeat(within, steps)
        walked_text = np.repeat(owner, steps)
        walked_size = np.bincount(walked_text, minlength=len(who))
        extra = has.astype(np.int64)
        size = kept * extra + extra + walked_size
        at = np.cumsum(size) - size
        edge, unit_of = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
        if j:
            spot = np.repeat(at, kept) + runs(kept)
            origin = np.repeat(base, kept) + runs(kept)
            edge[spot], unit_of[spot] = store_edge[origin], store_unit[origin]
            edge[at + kept], unit_of[at + kept] = top["edge"], from_unit
        spot = np.repeat(at + kept * extra + extra, walked_size) + runs(walked_size)
        edge[spot], unit_of[spot] = walked, walked_unit
        # Whole numbers of 2^-32: a text's sums do not depend on what stands before it.
        total = np.concatenate([[0], np.cumsum(np.round(lat.logp[edge] * LOG_UNIT).astype(np.int64))])
        before = (total[:-1] - np.repeat(total[at], size)) / LOG_UNIT
        mass = (total[at + size] - total[at]) / LOG_UNIT
        drawn.append((who, edge, size, mass, top["value"]))
        own_offsets = np.full(n, -1, np.int64)
        own_offsets[who] = len(store_edge) + at
        offsets.append(own_offsets)
        sizes.append(size)
        store_edge, store_unit = np.concatenate([store_edge, edge]), np.concatenate([store_unit, unit_of])
        # Siblings off the new part of the path.  Values above CUT are enough where a text
        # has as many as it still needs; elsewhere all places are opened and all kept.
        place = runs(size)
        fresh = place >= np.repeat(kept * extra + extra, size)
        text_of = np.repeat(np.arange(len(who)), size)
        new = _siblings(lat, who, seeds, j, edge, before, text_of, place, fresh & (before > CUT - REACH), top["value"])
        high = np.flatnonzero(new["value"] > CUT)
        left = {c: np.concatenate([queue[c], new[c][high]]) for c in queue}
        full = np.bincount(left["text"][left["value"] > CUT], minlength=n) >= k - j
        if not full[who].all():
            new = _siblings(lat, who, seeds, j, edge, before, text_of, place, fresh & ~full[who[text_of]], top["value"])
            old = np.flatnonzero(full[left["text"]])
            lacking = np.flatnonzero(~full[queue["text"]])
            left = {c: np.concatenate([left[c][old], queue[c][lacking], new[c]]) for c in queue}
        left = _best(left, k + 1 - j)
        lead = np.ones(len(left["text"]), bool)
        lead[1:] = left["text"][1:] != left["text"][:-1]
        top = {c: left[c][lead] for c in queue}
        queue = {c: left[c][~lead] for c in queue}
    threshold = np.full(n, -np.inf)
    threshold[top["text"]] = top["value"]
    return lat, drawn, threshold


def _best(q: dict, most: int) -> dict:
    """The entries of each text with the greatest values, in that order."""
    order = np.lexsort((q["edge"], q["place"], q["path"], -q["value"], q["text"]))
    q = {c: x[order] for c, x in q.items()}
    head = np.searchsorted(q["text"], q["text"])
    keep = np.arange(len(head)) - head < most
    return {c: x[keep] for c, x in q.items()}


def _siblings(lat, who, seeds, path, edge, before, text_of, place, chosen, limit) -> dict:
    """Queue entries for the edges not taken at the chosen places of the paths."""
    at = np.flatnonzero(chosen)
    node = lat.start[edge[at]]
    degree = lat.first[node + 1] - lat.first[node]
    spot = np.repeat(at, degree)
    other = np.repeat(lat.first[node], degree) + runs(degree)
    keep = other != edge[spot]
    spot, other = spot[keep], other[keep]
    mass = before[spot] + lat.logp[other]
    text = text_of[spot]
    noise = mix(seeds[who[text]] + place[spot].astype(np.uint64) * PLACE + np.uint64((path + 1) * int(SAMPLE) & 0xFFFFFFFFFFFFFFFF)
                + (other - lat.first[lat.start[other]] + 1).astype(np.uint64) * RANK)
    with np.errstate(over="ignore"):
        value = mass - np.log(np.exp(mass - limit[text]) - np.log1p(-unit(noise) - 2.0 ** -54))
    return {"text": who[text], "value": value, "path": np.full(len(text), path), "place": place[spot], "edge": other,
            "mass": mass}


def decode_ids(ids: list[int], texts: list[bytes]) -> str:
    """The text of ids: blanks and bytes put together, without the blank put in front."""
    return b"".join([texts[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def _encoded(v: Vocabulary, k: int, verify: bool):
    def run(batches):
        try:
            yield from encoded(batches)
        finally:
            release()

    def encoded(batches):
        m = Matcher(v)
        for batch in chunks(batches, "text", 1 << 19):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("key").to_pylist()
            seeds = np.array([int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little")
                              for x in keys], np.uint64)
            lat, drawn, threshold = sample_chunk(m, texts, seeds, k)
            for rank, (who, edge, size, mass, value) in enumerate(drawn):
                ids, n_ids = lat.ids(edge, size)
                stops = np.cumsum(n_ids)
                x = mass - threshold[who]
                with np.errstate(over="ignore", divide="ignore"):
                    inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700.0)))))
                right = pa.nulls(len(who), pa.bool_())
                if verify:
                    all_ids = ids.tolist()
                    right = pa.array([decode_ids(all_ids[e - c:e], v.texts) == texts[w]
                                      for w, e, c in zip(who.tolist(), stops.tolist(), n_ids.tolist())], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()),
                                                 pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(who)), pa.array(np.full(len(who), rank + 1), pa.int32()), lists,
                     pa.array(n_ids, pa.int32()), pa.array(np.round(mass, 6)), pa.array(np.round(value, 9)),
                     pa.array(np.round(np.minimum(inclusion, 0.0), 9)), right],
                    names=["id", "sample", "ids", "n_ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])
    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text: str = "text", k: int = K,
           verify: bool = True) -> DataFrame:
    """Rows (id, sample, ids, n_ids, log_prob, perturbed, log_inclusion, round_trip): up
    to ``k`` distinct segmentations of each row of ``docs``, the best perturbed value
    first.  ``log_inclusion`` is the logarithm of the probability that a segmentation
    is among the k, given the (k+1)-th value (0 if there is none); ``round_trip`` tells
    that decoding gives the text back.

    Null and empty texts have one segmentation, the empty one.  Texts with fewer than
    ``k`` segmentations give all of them.  Rows with the same id are drawn with the same
    numbers (a null id is an id).  Other columns play no part; no text is cut.
    """
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").cast("string").alias("key"),
                       F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(_encoded(vocabulary, k, verify),
                          f"id {kind}, sample int, ids array<int>, n_ids int, log_prob double, perturbed double, "
                          f"log_inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as column ``out`` (null ids: null).  Bytes
    that are no UTF-8 give replacement characters; unknown ids raise."""
    encoded = encoded.drop(out)
    at = encoded.columns.index(ids)
    texts = vocabulary.texts

    def run(batches):
        for batch in batches:
            found = [None if x is None else decode_ids(x, texts) for x in batch.column(at).to_pylist()]
            yield batch.append_column(out, pa.array(found, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{out}` string"
    return encoded.mapInArrow(run, schema)
