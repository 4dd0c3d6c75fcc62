"""Lattice sampling against all segmentations of short texts; round trips."""
import itertools
import math
from collections import Counter

import numpy as np
import pytest

from gatherlens.llm import pieces as P

VOCAB = P.Vocabulary(
    texts=[b"", b" ", b"a", b"b", b"ab", b" a", b"ba"] + [bytes([i]) for i in range(256)],
    pieces=["▁", "a", "b", "ab", "▁a", "ba"], ids=[1, 2, 3, 4, 5, 6], weights=[-1.0, -2.0, -1.5, -0.5, -1.2, -0.7],
    byte_ids=list(range(7, 263)), byte_weight=-4.0)


def all_segmentations(text):
    """Every segmentation (as ids) of a text with its weight; the slow way."""
    weights = dict(zip(VOCAB.ids, VOCAB.weights))
    out = {}

    def go(s, ids, w):
        if not s:
            out[tuple(ids)] = w
        for i, p in zip(VOCAB.ids, VOCAB.pieces):
            t = p.replace("▁", " ")
            if s.startswith(t):
                go(s[len(t):], ids + [i], w + weights[i])
        if s and s[0] not in " ab":
            b = s[0].encode()
            go(s[1:], ids + [VOCAB.byte_ids[x] for x in b], w + VOCAB.byte_weight * len(b))

    go(" " + text if text else "", [], 0.0)
    return out


def sample(texts, seeds, k):
    m = P.Matcher(VOCAB)
    lat, drawn, threshold = P.sample_chunk(m, texts, np.array(seeds, np.uint64), k)
    found = [[] for _ in texts]
    for who, edge, size, mass, value in drawn:
        ids, n = lat.ids(edge, size)
        for w, part, lp, v in zip(who.tolist(), np.split(ids, np.cumsum(n)[:-1]), mass, value):
            found[w].append((tuple(part.tolist()), lp, v))
    return found, threshold


@pytest.mark.parametrize("text", ["", "a", "abab", "ab ba", "é\n▁ab", "  a  "])
def test_all_segmentations_come_once_with_their_probability(text):
    want = all_segmentations(text)
    found, threshold = sample([text], [5], len(want) + 3)
    got = {ids: lp for ids, lp, _ in found[0]}
    assert len(found[0]) == len(got) == len(want) and threshold[0] == -math.inf
    total = math.log(sum(math.exp(w) for w in want.values()))
    for ids, w in want.items():
        assert got[ids] == pytest.approx(w - total, abs=1e-6)
        assert P.decode_ids(list(ids), VOCAB.texts) == text
    values = [v for _, _, v in found[0]]
    assert values == sorted(values, reverse=True)


def test_samples_without_replacement_follow_the_lattice():
    text, n = "abba", 20000
    want = all_segmentations(text)
    total = sum(math.exp(w) for w in want.values())
    p = {ids: math.exp(w) / total for ids, w in want.items()}
    found, _ = sample([text] * n, P.mix(np.arange(n, dtype=np.uint64)), 2)
    first, pair = Counter(f[0][0] for f in found), Counter((f[0][0], f[1][0]) for f in found)
    for a in p:
        assert first[a] / n == pytest.approx(p[a], abs=0.015)
    for a, b in itertools.permutations(p, 2):  # the second is drawn from what is left
        assert pair[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.015)


def test_sampling_does_not_depend_on_the_chunk():
    texts = ["abab ba", "", "a" * 3000, "ba ab é"]
    together, _ = sample(texts, [1, 2, 3, 4], 3)
    for t, s, f in zip(texts, [1, 2, 3, 4], together):
        assert sample([t], [s], 3)[0][0] == f
        assert len({x[0] for x in f}) == len(f)


def test_encode_and_decode(spark):
    long = "Straße der Wörter " * 3000
    rows = [(1, "Hello  world\n▁x ", "s"), (2, None, "s"), (3, "", "s"), (None, " lead 🎈\x00", "s"), (1, "Hello  world\n▁x ", "s"),
            (4, long, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample string")
    v = P.load()
    out = P.decode(P.encode(df, v, k=3), v).collect()
    assert all(r["round_trip"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert [len(by[i]) for i in (1, 2, 3, 4, None)] == [6, 1, 1, 3, 3]
    assert {r["decoded"] for r in by[4]} == {long} and by[2][0]["ids"] == [] and by[3][0]["log_inclusion"] == 0
    assert len({tuple(r["ids"]) for r in by[1]}) == 3
    assert P.encode(df.limit(0), v).count() == 0
