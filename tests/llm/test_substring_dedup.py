"""Repeated 400-byte strings against a count of all strings."""
import hashlib
import random
from collections import Counter

import numpy as np

from gatherlens.llm import substring_dedup as D


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                gone[i:i + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (398, 400, 401, 450, 700, 1500)]
    out = [None, "", "short", "a" * 399, "a" * 400, "b" * 401, "c" * 1300, "ab" * 900, text(2000)]
    for _ in range(30):
        t = text(rng.randrange(0, 900))
        for p in rng.sample(shared, rng.randrange(0, 4)):
            t += p[rng.randrange(0, 30):] + text(rng.randrange(0, 300))
        out.append(t)
    out += [out[-1], out[-1], out[-2], shared[4] + shared[4]]
    return out


def result(df):
    out = []
    for r in D.remove_repeats(df).collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert removed == r["n_removed"]
        out.append((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark, documents):
    for seed in (1, 2):
        texts = corpus(seed)
        want = sorted(((i, *x) for i, x in enumerate(brute(texts))), key=str)
        assert result(documents(texts).repartition(5)) == want


def test_text_has_whole_characters(spark):
    base = "".join(chr(97 + (i * i) % 23) for i in range(600))
    texts = [f"one é{base}é two", f"other ĩ{base}è end"]  # the run takes a byte of each letter beside it
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(D.remove_repeats(df).collect())
    assert [r["text"] for r in rows] == ["one  two", "other  end"]
    assert [len(r["kept"]) for r in rows] == [r["n_bytes"] - r["n_removed"] for r in rows]
    assert rows[0]["kept"] == b"one \xc3\xa9 two"


def test_repeated_rows_and_null_ids(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(700))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + "!"), (None, None)], "doc_id long, text string")
    assert [r[1:4] for r in result(df)] == [(700, 700, 1), (700, 700, 1), (0, 0, 0), (701, 700, 1)]
    assert D.remove_repeats(df.limit(0)).count() == 0


def test_segments_do_not_change_tuples(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab ") for _ in range(5000)).encode() + b"z" * 3000
    whole = D.tuples(text)
    strings = D.strings(text, whole[2][::2])
    monkeypatch.setattr(D, "SEGMENT", 177)
    parts = D.tuples(text)
    for a, b in zip(whole, parts):
        assert (a == b).all()
    some = D.strings(text, whole[2][::2])
    assert (some[0] == strings[0]).all() and (some[1] == strings[1]).all()
    assert len(set(strings[1].tolist())) == len(strings[1])
