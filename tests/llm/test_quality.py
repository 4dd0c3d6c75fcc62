"""Base rules and scores against plain counting."""
import math
import random
import re
from collections import Counter

import numpy as np

from gatherlens.llm import quality as Q
from gatherlens.llm.common import hash_words
from tests.llm import brute as B


def base(text):
    t, w = text or "", B.words_of(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    inside = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if B.WORD.search(x)]
    repeat = len(inside)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat,
            len(w) < 10 or 100 * repeat > 20 * len(w))


def texts():
    rng = random.Random(4)
    pool = ["a", "b", "c", "ß", "#x", "*", "na me", "d|e", "🎈"]
    out = []
    for _ in range(120):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 60))]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t", "\x1c", "\r\n"]) for x in w))
    return out + B.EDGES + [B.EDGES[-1]] * 2


def test_base_rules_equal_counting(spark, documents):
    rows = texts()
    ids = spark.createDataFrame([(0,), (5,), (None,), (99999,)], "doc_id long")
    got = {r["doc_id"]: r for r in Q.judge(documents(rows), ids).collect()}
    for i, t in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t)
        assert not (r["kept"] and r["base_failed"])


def test_scores_equal_plain_ratio(spark, documents):
    rows = [t for t in texts() if t]
    good = [1, 2, 3, 10]
    df = documents(rows)
    got = {r["doc_id"]: r["score"] for r in Q.judge(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}

    def grams(text):
        words = [w.encode() for w in B.words_of(text)]
        return Q.buckets(hash_words(words), np.array([len(words)]))[0].tolist()
    raw, target = Counter(), Counter()
    for i, t in enumerate(rows):
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    v = 1 << Q.BITS
    for i, t in enumerate(rows):
        g = grams(t)
        if not g:
            assert got[i] is None
            continue
        p = {x: (raw[x] + 1) / (sum(raw.values()) + v) for x in g}
        want = sum(math.log((target[x] + Q.PRIOR * p[x]) / (sum(target.values()) + Q.PRIOR) / p[x]) for x in g) / len(g)
        assert abs(got[i] - want) < 1e-5


def test_buckets_do_not_cross_texts():
    a, b = [b"x", b"y"], [b"y", b"z", b"z"]
    codes, sizes = Q.buckets(hash_words(a + [] + b), np.array([2, 0, 3]))
    assert sizes.tolist() == [3, 0, 5]
    assert sorted(codes[:3]) == sorted(Q.buckets(hash_words(a), np.array([2]))[0])
    assert sorted(codes[3:]) == sorted(Q.buckets(hash_words(b), np.array([3]))[0])


def test_empty_tables_and_no_trusted_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long")
    assert Q.judge(documents(["a"]).limit(0), none).count() == 0
    assert [(r["score"], r["kept"]) for r in Q.judge(documents(["word " * 9, None, "a b c d e f g h i j"]), none).collect()] == [
        (0.0, False), (None, False), (0.0, True)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert [r[0] for r in Q.trusted_sample(labels, "doc_id", labels["quality"] == 1).collect()] == [1]


def test_held_out_quality(spark):
    """Documents that labels call bad score lower than those they call good."""
    from tests.conftest import SF_ORACLE
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    out = Q.judge(docs, Q.trusted_sample(train, "doc_id", train["quality"] == 1)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = out.where("NOT base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows)
    assert right > 0.9 and all(r["kept"] for r in rows if r["quality"] == 1)


def test_threshold_from_held_out_rows_at_any_size(spark):
    """With 2 % of the trusted rows as with all of them good documents stay; with all of
    them most bad ones go.  The verdict is that of the held-out scores."""
    from pyspark.sql import functions as F
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    whole = Q.trusted_sample(train, "doc_id", train["quality"] == 1)
    for share, least_rejected in ((2, 0), (100, 0.9)):
        part = whole.where(F.pmod(F.xxhash64("t_id"), F.lit(100)) < share)
        trusted, held = Q.held_out_half(part)
        ids = [{r[0] for r in x.collect()} for x in (trusted, held)]
        assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == part.count()
        rows = [r for r in Q.judge(docs, trusted, held_out=held).collect() if not r["base_failed"]]
        scores = np.array([r["score"] for r in rows if r["doc_id"] in ids[1]])
        low = min(np.quantile(scores, Q.HELD_OUT_SHARE), scores.mean() - Q.HELD_OUT_SPREAD * scores.std(ddof=1))
        assert all(r["kept"] == (r["score"] >= low) or abs(r["score"] - low) < 1e-8 for r in rows)
        good, bad = ([r["kept"] for r in rows if test.get(r["doc_id"]) == v] for v in (1, 0))
        assert np.mean(good) > 0.98 and 1 - np.mean(bad) >= least_rejected, (share, np.mean(good), np.mean(bad))


def test_no_held_out_rows(spark, documents):
    none = spark.createDataFrame([], "t_id long")
    assert [r["kept"] for r in Q.judge(documents(["word " * 9, None, "a b c d e f g h i j"]), none, held_out=none).orderBy("doc_id").collect()] == [False, False, True]
    assert Q.judge(documents(["a"]).limit(0), none, held_out=none).count() == 0


def test_every_trusted_row_is_taken(spark):
    """More than the 20,000 rows that were once sampled."""
    from pyspark.sql import functions as F
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = Q.trusted_sample(labels, "doc_id", labels["quality"] == 1)
    assert got.count() == got.distinct().count() == 25_000
    trusted, held = Q.held_out_half(got)
    assert trusted.count() + held.count() == 25_000 and trusted.intersect(held).count() == 0
