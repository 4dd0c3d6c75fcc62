"""Alignment against a comparison of all pairs of tokens of a text."""
import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gatherlens.llm import alignment as L
from gatherlens.llm import vocab
from tests.llm.brute import EDGES, near_copies

ODD = [" ", "  ", " a", "  two  blanks ", "tab\there\n\n new  \n line ", "x▁y ▁z", "<|endoftext|> x <s> <unk> </s> <0x41>", "ﬁ ﬀ é é 日本語 テ",
       "a\x1c b \x85 c\xa0 d　 e", "don't I'LL 12 345", "�", "mixed � ok", "été là où", "a.b, c., d, . e,f . , g.", "end.", "it's. U.S., x\x00. y", "🎈🎈 👩‍👩‍👧"]


def token_bytes():
    a = Tokenizer.from_file(vocab.public(L.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocab.public(L.B))
    chars = vocab.byte_alphabet()
    return (a, lambda i: bytes(chars[c] for c in a.id_to_token(i)), b,
            lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


def brute(texts):
    a, bytes_a, b, bytes_b = token_bytes()
    docs, counts = [], Counter()
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        wa, wb = [bytes_a(i) for i in x], [bytes_b(i) for i in y]
        if not t or not b"".join(wa) == b"".join(wb) == (" " + t).encode():
            x = y = wa = wb = []
        ra, rb = spans(wa), spans(wb)
        links = [(x[i], y[j]) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if max(s, u) < min(e, v)]
        ends = {e for _, e in ra} & {e for _, e in rb}
        counts.update(links)
        group = lambda ids, r, s, e: ",".join(str(i) for i, (u, v) in zip(ids, r) if s <= u and v <= e)
        cuts = [0, *sorted(ends)]
        text = ";".join(f"{group(x, ra, s, e)}|{group(y, rb, s, e)}" for s, e in zip(cuts, cuts[1:]))
        docs.append((len(x), len(y), len(ends), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(na, nb, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), h)
            for na, nb, g, links, h in docs]


def spans(words):
    ends = np.cumsum([len(w) for w in words]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def result(df, **options):
    rows = L.align(df, groups="sha256", **options).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_equals_brute_force(spark, documents):
    texts = [t if t is None else t[:2000] for t in EDGES] + ODD + near_copies(2, 3, 6)
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab é\n日.1  ") for _ in range(rng.randrange(200))) for _ in range(40)]
    want = sorted(((i, *x) for i, x in enumerate(brute(texts))), key=str)
    assert result(documents(texts).repartition(4)) == want
    assert sum(r[1] == 0 for r in want) == 3  # null, empty, and one whose bytes B does not keep


def test_runs_and_windows_do_not_change_results(spark, documents, monkeypatch):
    texts = [None, "", "x▁y"] + near_copies(4, 3, 8) + [None]
    df = documents(texts).coalesce(1)
    whole = result(df)
    make = L._runs

    def short(*args):
        run = make(*args)

        def runs(batches):
            L.CHUNK, L.WINDOW = 700, 50
            yield from run(batches)
        return runs
    monkeypatch.setattr(L, "_runs", short)
    assert result(df) == whole


def test_groups_as_text_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two"), (5, "one two"), (5, "one two"), (6, None)], "id long, groups string")
    rows = L.align(df, "id", "groups").collect()
    one = [r for r in rows if r["n_a"]]
    assert len(rows) == 4 and len(one) == 3 and len({r["groups"] for r in one}) == 1
    assert all(len(r["groups"].split(";")) == r["n_groups"] for r in one)
    assert [r["count_sum"] for r in one] == [3 * r["n_links"] for r in one]
    assert [(r["groups"], r["n_links"], r["count_sum"]) for r in rows if r["id"] == 6] == [("", 0, 0)]
    assert L.align(df.limit(0), "id", "groups").collect() == []
    assert {r["groups"] for r in L.align(df, "id", "groups", groups="none").collect()} == {None}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.randoms(use_true_random=False), st.floats(0.05, 0.95), st.floats(0, 1))
def test_diagonal_of_any_ends(n, rng, dense, alike):
    a = [i for i in range(1, n) if rng.random() < dense] + [n]
    b = [i for i in range(1, n) if (i in set(a)) != (rng.random() > alike)] + [n]
    groups = []
    for i0, i1, j0, j1, one in L.diagonal(a, b):
        groups += [(i, i + 1, j, j + 1) for i, j in zip(range(i0, i1), range(j0, j1), strict=True)] if one else [(i0, i1, j0, j1)]
    cuts = sorted(set(a) & set(b))
    want, i, j = [], 0, 0
    for c in cuts:
        p, q = a.index(c) + 1, b.index(c) + 1
        want.append((i, p, j, q))
        i, j = p, q
    assert groups == want


def test_pieces_encode_like_whole_texts():
    a, b = vocab.read(vocab.public(L.A)), vocab.read(vocab.public(L.B))
    assert vocab.can_cut(a) and vocab.can_cut(b)
    parts, whole = L.Aligner(a, b, False), L.Aligner(a, b, True)
    texts = [t.encode() for t in ODD + [x for x in EDGES if x] + near_copies(7)] + [b"no \xff utf-8", b""]
    for x, y in zip(parts.tokens(texts)[:4], whole.tokens(texts)[:4]):
        assert x.tolist() == y.tolist()
