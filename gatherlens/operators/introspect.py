"""What a topic is about: class term weights and lemma-merged keywords.

M6 reads the multinomial naive Bayes weights of every (class, term) -- the log
of the smoothed share of the class's feature mass that falls on the term --
straight from the feature table, in long form:

    w_ct = ln((O_ct + alpha) / (O_c + alpha * V))

with O_ct the sum of the term's feature values over the class's documents,
O_c = sum_t O_ct and V the number of features.  It equals the fitted model's
log conditional probabilities (``NaiveBayesModel.theta``), without a model.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayesModel, OneVsRestModel
from pyspark.ml.feature import CountVectorizerModel, VarianceThresholdSelectorModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the reference: smoothing of the naive Bayes model and the
# number of keywords per topic.
ALPHA = 0.01
TOP_TERMS = 25


def nb_term_weights(features: DataFrame, labels: DataFrame, alpha: float = ALPHA,
                    value_col: str = "tfidf", n_features: int | None = None) -> DataFrame:
    """M6: (label, term, weight) for every term that occurs in a class.

    ``n_features`` is V; by default the number of distinct terms of ``features``.
    """
    obs = (features.select("doc_id", "term", F.col(value_col).alias("x"))
                   .join(labels.select("doc_id", "label"), "doc_id")
                   .groupBy("label", "term").agg(F.sum("x").alias("o")))
    if n_features is None:
        n_features = features.select(F.count_distinct("term")).scalar()
    # Summed by class and joined back (one row per class), so that the terms of a class
    # never meet in one task.
    total = obs.groupBy("label").agg(F.sum("o").alias("total"))
    weight = F.log((F.col("o") + alpha) / (F.col("total") + F.lit(alpha) * n_features))
    return obs.join(total, "label").select("label", "term", weight.alias("weight"))


def fitted_term_weights(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """M6 of a fitted linear pipeline: (label, term, weight), ``label`` the class number.

    Naive Bayes gives the log conditional probabilities, one-vs-rest models the
    coefficients of each class against the rest, a binary linear model those of class 1.
    Weights are led back through the selector to the vocabulary.  There is a row for every
    class and selected term (at most the selector's k, or the vocabulary's size).
    """
    last = model.stages[-1]
    terms = np.array(next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary, dtype=object)
    for s in model.stages:
        if isinstance(s, VarianceThresholdSelectorModel):
            terms = terms[s.selectedFeatures]
    if isinstance(last, NaiveBayesModel):
        rows = last.theta.toArray()
    elif isinstance(last, OneVsRestModel):
        rows = np.vstack([m.coefficients.toArray() for m in last.models])
    elif hasattr(last, "coefficients"):
        rows = last.coefficients.toArray()[None, :]
    else:
        raise ValueError(f"{type(last).__name__} has no weights of terms")
    labels = range(len(rows)) if len(rows) > 1 else [1]
    frame = pd.DataFrame({"label": np.repeat(np.array(labels, np.int32), rows.shape[1]), "term": np.tile(terms, len(rows)),
                          "weight": rows.ravel()})
    return spark.createDataFrame(frame, "label int, term string, weight double")


def top_terms(weights: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """The n heaviest terms per class, ``rank`` 1 = heaviest (ties by term).

    A class in which fewer than n terms occur returns only those terms.
    """
    w = Window.partitionBy("label").orderBy(F.desc("weight"), F.asc("term"))
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def plural_lemmas(terms: DataFrame) -> DataFrame:
    """A (term, lemma) table by a plural rule: a final 's' is dropped unless the
    term ends in 'ss' or would become shorter than 4 letters.  A stand-in for a
    dictionary lemmatiser; any (term, lemma) table can be used instead."""
    t = F.col("term")
    strip = t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 4)
    lemma = F.when(strip, F.expr("substring(term, 1, length(term) - 1)")).otherwise(t)
    return terms.select("term").distinct().select("term", lemma.alias("lemma"))


# The suffixes of nouns and what stands in their place in the base form.
DETACHMENTS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
               ("men", "man"), ("ies", "y"))


def detached_lemmas(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """M7: a (term, lemma) table by detaching noun suffixes, where ``vocabulary`` (a table
    with a column ``term``) holds what is left.

    Each rule whose suffix a term ends in gives a candidate; of those that the vocabulary
    holds the shortest is the lemma (of equally short ones the first by name), and a term
    without any is its own.  Terms are looked up by an equi-join, once each; null terms
    are left out.
    """
    own = terms.where("term IS NOT NULL").select("term").distinct()
    t = F.col("term")
    forms = [F.when(t.endswith(end) & (F.length(t) > len(end)), F.concat(F.substring(t, F.lit(1), F.length(t) - len(end)), F.lit(base)))
             for end, base in DETACHMENTS]
    candidates = own.select("term", F.explode(F.array_compact(F.array(*forms))).alias("lemma"))
    known = vocabulary.select(F.col("term").alias("lemma")).distinct()
    best = candidates.join(known, "lemma", "left_semi").groupBy("term").agg(
        F.min(F.struct(F.length("lemma").alias("n"), "lemma")).alias("best"))
    return own.join(best, "term", "left").select("term", F.coalesce("best.lemma", "term").alias("lemma"))


def lemma_weights(top: DataFrame, lemmas: DataFrame | None = None,
                  n: int = TOP_TERMS) -> DataFrame:
    """M7: keyword weights per (label, lemma) for a word cloud.

    The top-n list of a class is read from lightest (position 0) to heaviest
    (position n - 1); a lemma weighs n + its first (lightest) position, as in
    the reference.  ``lemmas`` maps term -> lemma; missing terms are their own
    lemma.
    """
    df = top.withColumn("pos", F.lit(n) - F.col("rank"))
    if lemmas is not None:
        df = df.join(lemmas.select("term", "lemma"), "term", "left")
        df = df.withColumn("lemma", F.coalesce("lemma", "term"))
    else:
        df = df.withColumn("lemma", F.col("term"))
    return df.groupBy("label", "lemma").agg((F.lit(n) + F.min("pos")).alias("weight"))
