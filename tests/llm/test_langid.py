"""Language ID: grams against plain slicing, fusion against plain Bayes, held-out accuracy."""
import math

import numpy as np
from pyspark.sql import functions as F

from gatherlens.llm import langid as L
from tests.conftest import SF_ORACLE
from tests.llm import brute as B


def test_grams_equal_slices():
    texts = [(t or "").encode() for t in B.EDGES if t is None or len(t) < 5000] + ["Straße, Élan!".encode()]
    got, sizes = L.grams(texts)
    want = []
    for t in texts:
        f = b"  " + bytes(L.FOLD[np.frombuffer(t, np.uint8)]) + b"  "
        own = [f[i:i + 4] for i in range(len(f) - 3) if f[i + 1] != 32 and f[i + 2] != 32]
        want.append([(int.from_bytes(g, "little") * 2654435761 % (1 << 32)) >> 16 for g in own])
    assert sizes.tolist() == [len(w) for w in want] and got.tolist() == [x for w in want for x in w]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"), "text", "lang", per_language=50)
    test = docs.where("doc_id % 2 = 1")
    out = L.identify(test, model, "doc_id", F.col("text"), host=F.col("source")).withColumnRenamed("lang", "got").join(test, "doc_id")
    rows = out.collect()
    assert sum(r["got"] == r["lang"] for r in rows) / len(rows) > 0.98
    assert all(r["kept"] for r in rows if len(r["text"]) > 100)


def test_fusion_equals_bayes(spark):
    """A flat text model: the other evidence decides, by the stated formulas."""
    model = np.full((4, 1 << L.BITS), -L.UNIT, np.int32)
    model[1] += 1  # texts lean to the second language, by next to nothing
    long = "some words of text that hold more than twenty grams"
    rows = [(1, long, "fr", "h1", "com"), (2, long, None, "h1", "com"), (3, long, "xx", "h2", None), (4, None, "de", "h1", "com"),
            (5, "", None, None, None), (6, long, "fr", None, None), (6, long, "fr", None, None)]
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, host string, suffix string")
    out = L.identify(df, model, "page_id", F.col("text"), F.col("declared"), F.col("host"), F.col("suffix"))
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == 6 and out.count() == 7
    # Clear texts: 2 of h1/com, 1 of h2/-, 2 of -/-; all decided as the second language.
    top = np.array([1, 6, 1, 1]) / 9
    clear = {("h1", "com"): 2, ("h2", ""): 1, ("", ""): 2}
    by_suffix = {"com": 2, "": 3}
    for i, declared, host, suffix, n in ((1, "fr", "h1", "com", 1), (2, None, "h1", "com", 1), (3, None, "h2", "", 1), (4, "de", "h1", "com", 0),
                                         (5, None, "", "", 0), (6, "fr", "", "", 1)):
        one = np.array([0, 1, 0, 0])
        p_suffix = (by_suffix[suffix] * one + L.SUFFIX_STRENGTH * top) / (by_suffix[suffix] + L.SUFFIX_STRENGTH)
        prior = (clear[host, suffix] * one + L.HOST_STRENGTH * p_suffix) / (clear[host, suffix] + L.HOST_STRENGTH)
        like = np.array([(L.RELIABILITY if x == declared else (1 - L.RELIABILITY) / 3) if declared else 1 for x in L.LANGUAGES])
        lean = np.exp(got[i]["n_grams"] * L.TEXT_WEIGHT / L.UNIT * one)
        p = prior * like * lean
        assert got[i]["lang"] == L.LANGUAGES[int(p.argmax())]
        assert math.isclose(got[i]["confidence"], p.max() / p.sum(), abs_tol=1e-7)
    assert not got[4]["kept"] and not got[5]["kept"] and got[1]["kept"]


def test_edges(spark, documents):
    df = documents(B.EDGES + ["0x" * 500, "!!!! " * 100]).withColumn("lang", F.lit("en"))
    model = L.train(df, "text", "lang")
    out = L.identify(df.withColumn("id", F.lit(9)), model, "doc_id", F.col("text"))
    assert out.count() == df.count()
    assert {r["doc_id"] for r in out.where("NOT kept").collect()} >= {0, 1, 2, len(B.EDGES) + 1}
    empty = df.limit(0)
    assert L.identify(empty, L.train(empty, "text", "lang"), "doc_id", F.col("text")).count() == 0
