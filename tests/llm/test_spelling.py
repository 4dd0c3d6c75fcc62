"""Spelling variants against a comparison of all pairs of words."""
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gatherlens.llm import spelling as S


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_words(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute_forms(words):
    form, rows = {}, []
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        form[w] = (close[0][1], -close[0][0]) if close and -close[0][0] >= 5 * n else (None, None)
        rows.append((w, n, len(close)))
    out = set()
    for w, n, k in rows:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.add((w, form[w][0], root, n, k, form[w][1]))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def result(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


def typos(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abzéñ") + word[i:], word[:i] + rng.choice("abzéñ") + word[i + 1:]])


def test_texts_against_all_pairs(spark, documents):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 10))) for _ in range(25)]
    texts = [None, "", "123 - \n", "ABCDEFG×÷ÀÉ " * 7]
    for _ in range(60):
        ws = [rng.choice(base[: rng.randrange(1, 26)]) for _ in range(60)]
        texts.append(rng.choice([" ", "-", "1"]).join(typos(rng, w) if rng.random() < 0.2 else w.title() for w in ws))
    rows = list(enumerate(texts))
    words = brute_words(rows)
    assert any(len(w) == 6 for w in words) and any(zlib.crc32(f"{i}:{r.lower()}".encode()) % 199 == 0
                                                     for i, t in rows for r in re.findall("[A-Za-zé]{7,}", t or ""))
    docs = documents(texts)
    counted = {r["word"]: r["n"] for r in S.vocabulary(S.noisy_words(docs)).collect()}
    assert counted == words
    assert result(S.variants(docs.repartition(3))) == brute_forms(words)


def test_near_words_of_any_letters(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("aÿ×zß日x'") for _ in range(rng.randrange(1, 6))) for _ in range(200)}
    df = spark.createDataFrame([(w, rng.randrange(1, 60)) for w in words], "word string, n long")
    got = {(r["word"], r["near"]) for r in S.near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}
    assert S.near_words(df).count() == len(got)
    assert result(S.forms(df)) == brute_forms({r["word"]: r["n"] for r in df.collect()})


def test_chains_ties_and_empty_tables(spark):
    rows = [("aaaaaaa", 1), ("aaaaaab", 5), ("aaaaabb", 25), ("aaaabbb", 200), ("aaaaaaz", 5), ("qqqqqqq", 9)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = result(S.forms(df))
    assert got == brute_forms(dict(rows))
    assert ("aaaaaaa", "aaaaaab", "aaaabbb", 1, 2, 5) in got  # a tie, and a path of three steps
    assert result(S.forms(df.limit(0))) == set()


def test_reduced_words(spark):
    for n, symbols in ((0, 4), (10 ** 4, 5), (10 ** 9, 26)):
        assert S.symbols_for(n) == min(26, max(4, symbols)) or n == 10 ** 9
    row = spark.range(1).select(S.neighbourhood(F.lit("ab"), 2).alias("n")).first()["n"]
    assert set(row) == {"ab", "a", "b", "bb", "aa", "aab", "bab", "abb", "aba"} and len(row) == 9


def test_null_ids_repeated_rows_and_names(spark):
    rows = [(None, "spelling " * 4), (1, "spelling"), (1, "spelling"), (2, None)]
    df = spark.createDataFrame(rows, "id long, word string").withColumn("n", F.lit("x")).withColumn("run", F.lit(1))
    assert result(S.variants(df, "id", "word")) == brute_forms(brute_words(rows))
