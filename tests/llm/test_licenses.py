"""License phrases against plain search over words."""
import random
import re

from gatherlens.llm import licenses as L
from tests.llm import brute as B

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORDS.findall(B.lower(text))
    places = [(i, label) for phrase, label in L.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(8)
    parts = ["GNU", "general", "public", "license", "Apache", "MIT", "cc", "by", "gnu general public license", "CC-BY 4.0", "mit license",
             "apache\nLicense", "é", "the", "of", ".", "--", "cc by cc by", "İ", "Kelvin"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + B.EDGES


def test_base_phrases_equal_search(spark, documents):
    rows = texts()
    got = {r["doc_id"]: r for r in L.find(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"])


def test_notices_with_a_word_more_or_less(spark, documents):
    notice = dict((label, n) for n, label in L.NOTICES)["bsd"].split()
    rows = [" ".join(notice), " ".join(notice[:6] + ["really"] + notice[6:]), " ".join(notice[:8] + notice[9:]), " ".join(notice[:8]),
            " ".join(reversed(notice)), "pad " * 500 + " ".join(notice) + " pad" * 500]
    got = {r["doc_id"]: r for r in L.find(documents(rows)).collect()}
    assert [("bsd" in got[i]["labels"]) for i in range(6)] == [True, True, True, False, False, True]
    assert got[0]["score"] == 1.0 and 0.75 <= got[2]["score"] < 1.0 and got[3]["score"] == 0.0
    span = got[5]["spans"][0]
    assert (span["start"], span["end"]) == (500, 500 + len(notice))


def test_repeated_rows_and_empty_table(spark, documents):
    df = documents(["mit license", "mit license"], [1, 1])
    assert [r["n_base"] for r in L.find(df).collect()] == [1, 1]
    assert L.find(df.limit(0)).count() == 0
