"""The pipeline's stages against plain versions on small tables."""
import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from gatherlens.llm.common import staged
from tests.conftest import SF_SMALL
from tests.llm import brute as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark):
    rng = random.Random(2)
    texts = B.near_copies(3, families=3, members=6) + ["", None, "123 456", "my token = abcdefgh99 and more words to read here"]
    texts = [t if t is None else " ".join(rng.choice(["apple", "river", "window"]) + w for w in t.split(" ")) if t[:1] == "w" else t for t in texts]
    df = staged(docs_of(spark, texts), "t")
    first = staged(P.language_id(spark, df, None), "t")
    assert first.columns == df.columns
    assert {r["doc_id"] for r in df.collect()} - {r["doc_id"] for r in first.collect()} >= {len(texts) - 4, len(texts) - 3, len(texts) - 2}
    second = staged(P.near_duplicates(spark, first, None), "t")
    rows = sorted(first.collect(), key=lambda r: r["doc_id"])
    root = B.groups([B.shingles(r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in second.collect()) == [rows[i]["doc_id"] for i in range(len(rows)) if root[i] == i]
    third = staged(P.secrets(spark, second, None), "t")
    secret = third.where(F.col("doc_id") == len(texts) - 1).first()
    assert secret["text"] == "my [secret] and more words to read here" and secret["n_chars"] == len(secret["text"])
    assert third.count() == second.count()
    fourth = staged(P.mix(spark, third, None), "t")
    assert fourth.columns == df.columns and {r["doc_id"] for r in fourth.collect()} <= {r["doc_id"] for r in third.collect()}
    last = P.encode(spark, fourth, None)
    assert last.where("NOT round_trip").count() == 0 and last.where("sample = 1").count() == fourth.count()


def test_repeated_rows_leave_one(spark):
    text = "the very same words stand in each of these rows"
    df = spark.createDataFrame([(1, text, "en", "s", 5)] * 3 + [(2, text, "en", "s", 5), (None, None, None, None, None)], SCHEMA)
    assert sorted(map(tuple, P.near_duplicates(spark, df, None).collect()), key=str) == [(1, text, "en", "s", 5), (None,) * 5]


def test_empty_table(spark):
    df = docs_of(spark, ["x"]).limit(0)
    for _, stage in P.STAGES:
        df = staged(stage(spark, df, None), "t")
    assert df.count() == 0


def test_run(spark):
    out = P.run(spark, SF_SMALL)
    assert out.where("NOT round_trip").count() == 0 and out.count() > 100


def test_columns_of_any_name_stay(spark):
    text = "river apple window story about some words that stand in a row number "
    df = spark.createDataFrame([(i, text + "one two three four five six " * 3 + str(i), "en", "s", 5) for i in range(3)], SCHEMA)
    names = ["row_key", "ROW_KEY_", "__row_key", "__row", "row", "head", "key", "n", "a.b"]
    df = staged(df.select("*", *[(F.col("doc_id") * 10 + i).alias(n) for i, n in enumerate(names)]), "t")
    for _, stage in P.STAGES[:4]:
        out = staged(stage(spark, df, None), "t")
        assert out.columns == df.columns
        assert all(r[n] == r["doc_id"] * 10 + i for r in out.collect() for i, n in enumerate(names))


def test_only_rows_that_may_be_listed_meet_joins(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("cast(id as string) AS key", "id AS page", "id * 2 AS bits")
    listed = rows.where("page % 10 = 3").select("key")
    clear, rest = P._split(rows, "key", listed)
    assert clear.columns == rest.columns == rows.columns
    a, b = [{r["page"] for r in x.collect()} for x in (clear, rest)]
    assert a | b == set(range(5000)) and not a & b and {i for i in range(5000) if i % 10 == 3} <= b and len(b) < 1000
    monkeypatch.setattr(P, "PAGES", 0)
    none, every = P._split(rows, "key", listed.where("false"))
    assert none.count() == 5000 and every.count() == 0
