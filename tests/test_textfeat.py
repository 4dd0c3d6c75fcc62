import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from gatherlens.operators import corpus as C
from gatherlens.operators import introspect as I
from gatherlens.operators import models as ML
from gatherlens.operators import textfeat as TF

DOCS = [
    (1, "apple banana apple cherry", "fruit"),
    (2, "banana banana durian", "fruit"),
    (3, "engine wheel engine apple", "car"),
    (4, "wheel brake engine", "car"),
    (5, "apple wheel", "car"),
    (6, "the and of", "fruit"),      # only stop words
]
STOP = ["the", "and", "of"]


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, topic string")


def sklearn_tfidf(max_features=None):
    """The vectoriser's definition, written out with numpy (no sklearn needed)."""
    toks = {d: [t for t in text.split() if t not in STOP] for d, text, _ in DOCS}
    freq = Counter(t for ts in toks.values() for t in ts)
    vocab = sorted(freq, key=lambda t: (-freq[t], t))[:max_features] if max_features else sorted(freq)
    n = len(DOCS)
    df = Counter(t for ts in toks.values() for t in set(ts))
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for d, ts in toks.items():
        c = Counter(t for t in ts if t in idf)
        w = {t: c[t] * idf[t] for t in c}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            out[(d, t)] = v / norm
    return out


def test_tfidf_long_form(corpus):
    got = {(r.doc_id, r.term): r.tfidf for r in TF.tfidf(corpus, None, STOP).collect()}
    assert got == pytest.approx(sklearn_tfidf())
    top3 = {(r.doc_id, r.term): r.tfidf for r in TF.tfidf(corpus, 3, STOP).collect()}
    assert top3 == pytest.approx(sklearn_tfidf(3))
    assert {t for _, t in top3} == {"apple", "banana", "engine"}


def test_chi2_long_form_matches_definition(corpus):
    feats = TF.tfidf(corpus, None, STOP)
    labels = corpus.select("doc_id", F.col("topic").alias("label"))
    got = {r.term: r.chi2 for r in TF.chi2_scores(feats, labels).collect()}
    x = sklearn_tfidf()
    terms = sorted({t for _, t in x})
    classes = sorted({c for *_, c in DOCS})
    y = {d: c for d, _, c in DOCS}
    obs = np.array([[sum(v for (d, t2), v in x.items() if t2 == t and y[d] == c) for t in terms]
                    for c in classes])
    prior = np.array([sum(1 for d in y if y[d] == c) for c in classes]) / len(y)
    exp = np.outer(prior, obs.sum(0))
    chi2 = ((obs - exp) ** 2 / exp).sum(0)
    assert got == pytest.approx(dict(zip(terms, chi2)))
    top = TF.chi2_top_k(TF.chi2_scores(feats, labels), 2).collect()
    assert [r.rank for r in top] == [1, 2]
    assert [r.term for r in top] == [terms[i] for i in np.lexsort((terms, -np.round(chi2, 6)))[:2]]


def test_pipeline_features_equal_long_form(spark, corpus):
    """SmoothIdf + Normalizer in the ML pipeline give the long-form TF-IDF values."""
    labelled = corpus.withColumn("label", F.when(F.col("topic") == "car", 1.0).otherwise(0.0))
    stages = ML.text_stages(max_features=None, select_k=None, stop_words=STOP)
    model = Pipeline(stages=stages).fit(labelled)
    vocab = model.stages[2].vocabulary
    rows = model.transform(labelled).select("doc_id", "features").collect()
    got = {(r.doc_id, vocab[i]): float(v) for r in rows
           for i, v in zip(r.features.indices, r.features.values)}
    assert got == pytest.approx(sklearn_tfidf())


def test_chi2_estimator_selects_the_long_form_top_k(spark, corpus):
    labelled = corpus.withColumn("label", F.when(F.col("topic") == "car", 1.0).otherwise(0.0))
    stages = ML.text_stages(max_features=None, select_k=3, stop_words=STOP)
    model = Pipeline(stages=stages).fit(labelled)
    vocab = model.stages[2].vocabulary
    chosen = {vocab[i] for i in model.stages[-1].getIndices()}
    feats = TF.tfidf(corpus, None, STOP)
    labels = labelled.select("doc_id", "label")
    expect = {r.term for r in TF.chi2_top_k(TF.chi2_scores(feats, labels), 3).collect()}
    assert chosen == expect


def test_nb_theta_equals_long_form_weights(spark, corpus):
    labelled = corpus.withColumn("label", F.when(F.col("topic") == "car", 1.0).otherwise(0.0))
    stages = ML.text_stages(max_features=None, select_k=None, stop_words=STOP)
    stages.append(ML.classifier("MNB"))
    model = Pipeline(stages=stages).fit(labelled)
    vocab = model.stages[2].vocabulary
    theta = model.stages[-1].theta.toArray()
    feats = TF.tfidf(corpus, None, STOP)
    w = I.nb_term_weights(feats, labelled.select("doc_id", F.col("label").cast("int").alias("label")))
    got = {(r.label, r.term): r.weight for r in w.collect()}
    for (label, term), weight in got.items():
        assert theta[label][vocab.index(term)] == pytest.approx(weight)


def test_top_terms_and_lemmas(spark):
    w = spark.createDataFrame([(0, "horses", -1.0), (0, "horse", -2.0), (0, "cats", -0.5),
                               (0, "class", -3.0), (1, "x", -1.0)], "label int, term string, weight double")
    top = I.top_terms(w, 3)
    assert [(r.term, r.rank) for r in top.filter("label = 0").orderBy("rank").collect()] == \
        [("cats", 1), ("horses", 2), ("horse", 3)]
    lem = {r.term: r.lemma for r in I.plural_lemmas(w).collect()}
    # a final s goes unless the word ends in ss or would fall below 4 letters
    assert lem["horses"] == "horse" and lem["class"] == "class" and lem["cats"] == "cats"
    weights = {(r.label, r.lemma): r.weight for r in I.lemma_weights(top, I.plural_lemmas(top), 3).collect()}
    # ascending list of class 0: horse (0), horses (1), cats (2); the lemma keeps 3 + 0
    assert weights == {(0, "horse"): 3, (0, "cats"): 5, (1, "x"): 5}


def test_detached_lemmas_are_words_of_the_vocabulary(spark):
    words = ["cats", "cat", "wolves", "wolf", "wolve", "boxes", "box", "boxe", "parties", "party", "women", "woman", "class", "gas",
             "buses", "bus", "buse", "s", "men", "dishes", "dogs", None]
    terms = spark.createDataFrame([(w,) for w in words + ["cats"]], "term string")
    vocabulary = spark.createDataFrame([(w,) for w in words if w != "dogs"] + [("bus",), ("dish",)], "term string")
    got = {r.term: r.lemma for r in I.detached_lemmas(terms, vocabulary).collect()}
    changed = {"cats": "cat", "wolves": "wolf", "boxes": "box", "parties": "party", "women": "woman", "buses": "bus", "dishes": "dish"}
    # No rule gives a word for gas, class, dogs (dog isn't known) and men (man isn't).
    assert got == {w: changed.get(w, w) for w in words if w}
    assert I.detached_lemmas(terms.limit(0), vocabulary).count() == 0


def test_word_index_sequences_and_padding(spark):
    corpus = spark.createDataFrame([(1, "b a c a"), (2, "c b zz"), (3, "")], "doc_id long, text string")
    idx = {r.word: r.id for r in TF.word_index(corpus, num_words=3).collect()}
    assert idx == {"a": 1, "b": 2}          # ties (a, b, c all twice) by word; ids < 3 only
    seq = {r.doc_id: r.seq for r in TF.token_sequences(corpus, TF.word_index(corpus, 3)).collect()}
    assert seq == {1: [2, 1, 1], 2: [2], 3: []}
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([7],), ([],)], "s array<int>")
    got = [r.p for r in df.select(TF.pad_sequences("s", 3).alias("p")).collect()]
    assert got == [[3, 4, 5], [0, 0, 7], [0, 0, 0]]


def test_embedding_table_zero_rows(spark):
    idx = spark.createDataFrame([("a", 1), ("b", 2)], "word string, id int")
    vec = spark.createDataFrame([("b", [1.0, 2.0])], "word string, vec array<float>")
    got = {r.id: (r.word, r.vec) for r in TF.embedding_table(idx, vec, 2).collect()}
    assert got == {0: (None, [0.0, 0.0]), 1: ("a", [0.0, 0.0]), 2: ("b", [1.0, 2.0])}


def test_corpus_builder(spark):
    docs = spark.createDataFrame(
        [(i, f"word{i % 3} text here", t) for i, t in
         enumerate(["a"] * 5 + ["b"] * 3 + ["c"] * 2 + ["d"])] + [(99, "", "a"), (100, "text", "")],
        "doc_id long, text string, topic string")
    corpus = C.clean_corpus(docs)
    assert corpus.count() == 11 and corpus.filter("doc_id = 99").count() == 0
    ranks = {r.topic: (r.n, r.rank) for r in C.topic_rank(corpus).collect()}
    assert ranks == {"a": (5, 1), "b": (3, 2), "c": (2, 3), "d": (1, 4)}
    corp = C.topic_corpora(corpus, (2, 3))
    sizes = {r.topic_n: r["count"] for r in corp.groupBy("topic_n").count().collect()}
    assert sizes == {2: 8, 3: 10}
    assert {r.topic: r.label for r in corp.select("topic", "label").distinct().collect()} == \
        {"a": 0, "b": 1, "c": 2}
    ids = spark.createDataFrame([("a", 14), ("b", 3), ("c", 7)], "topic string, topic_id int")
    mapped = C.topic_corpora(corpus, (2,), topic_ids=ids)
    assert {r.label for r in mapped.collect()} == {14, 3}
    # the split is a function of doc_id only
    split = {r.doc_id: r.split for r in corp.collect()}
    split2 = {r.doc_id: r.split for r in C.train_test_split(corpus).collect()}
    assert all(split[k] == split2[k] for k in split)

