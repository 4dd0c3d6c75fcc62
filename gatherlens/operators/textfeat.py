"""Text features in long form.

* N1 ``tfidf``: the vectoriser of the reference -- tokens of two or more word
  characters, lower-cased, stop words removed, vocabulary = the
  ``max_features`` most frequent terms of the corpus (ties by term),
  idf = ln((1 + n) / (1 + df)) + 1, raw term counts, rows L2-normalised.
* N2 ``chi2_scores`` / ``chi2_top_k``: the chi-square statistic of every term
  against the class labels, computed on the feature values, and the k best.
* N3 ``word_index`` / ``token_sequences``: words ranked by count from 1, each
  document as the sequence of its word ids below ``num_words``.
* N4 ``pad_sequences``: left zero-pad, keep the last ``maxlen`` ids.
* N5 ``embedding_table``: id -> word vector, zeros when the word has none.

Scale notes.  Term counts are aggregated per (document, term) before anything
else, and corpus-wide statistics per term; the vocabulary is cut to
``max_features`` rows by a top-k (each partition keeps its k best; one task
merges them -- few partitions, as AQE sizes the aggregated vocabulary), so
every side that is broadcast has a proven size bound.
"""
from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatherlens.functions.text import TOKEN_PATTERN, tokens, words
from gatherlens.session import materialize

# Fixed values of the reference's feature settings.
MAX_FEATURES = 20000
SELECT_K = 10000
NUM_WORDS = 20000
MAX_SEQUENCE_LENGTH = 500
# An index or table of up to so many rows is sent to the tasks whole; a larger one is joined.
LOCAL_ROWS = 1 << 17
LOOKED_UP = 1 << 10  # documents looked up at a time


def _doc_terms(corpus: DataFrame, stop_words: Iterable[str] | None, pattern: str) -> DataFrame:
    """(doc_id, term, tf) plus one (doc_id, null, 1) row for a document without terms."""
    term = F.explode_outer(tokens("text", pattern)).alias("term")
    toks = corpus.select("doc_id", term)
    if stop_words:
        toks = toks.withColumn(
            "term", F.when(~F.col("term").isin(list(stop_words)), F.col("term")))
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(corpus: DataFrame, stop_words: Iterable[str] | None = None,
                pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(doc_id, term, tf): occurrences of each token in each document."""
    return _doc_terms(corpus, stop_words, pattern).filter(F.col("term").isNotNull())


def vocabulary(tf: DataFrame, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(term, freq, df): corpus frequency and document frequency of the kept terms."""
    stats = tf.groupBy("term").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df"))
    if max_features:
        stats = stats.orderBy(F.desc("freq"), F.asc("term")).limit(max_features)
    return stats


def tfidf(corpus: DataFrame, max_features: int | None = MAX_FEATURES,
          stop_words: Iterable[str] | None = None, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(doc_id, term, tf, tfidf) for the vocabulary terms of each document."""
    # The counts feed the document count, the vocabulary and the weights:
    # materialise them once (to the shared checkpoint folder when there is one)
    # instead of cleaning and tokenising the corpus three times.  A document
    # without terms keeps one row with a null term, so it still counts in n.
    counts = materialize(_doc_terms(corpus, stop_words, pattern))
    n_docs = counts.select(F.count_distinct("doc_id")).scalar()
    tf = counts.filter(F.col("term").isNotNull())
    vocab = vocabulary(tf, max_features).select(
        "term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    if max_features:
        vocab = F.broadcast(vocab)  # at most max_features rows
    w = tf.join(vocab, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", "tf", (F.col("w") / norm).alias("tfidf"))


def chi2_scores(features: DataFrame, labels: DataFrame, value_col: str = "tfidf") -> DataFrame:
    """(term, chi2) of every term against ``labels`` (doc_id, label).

    With observed O_ct = sum of the term's values in class c, feature total
    F_t = sum_c O_ct and class prior p_c = n_c / n,

        chi2_t = sum_c (O_ct - p_c F_t)^2 / (p_c F_t) = sum_c O_ct^2 / (p_c F_t) - F_t

    so only (term, class) pairs that occur are visited; no term x class grid.
    """
    n = labels.select(F.count(F.lit(1))).scalar()
    priors = labels.groupBy("label").agg((F.count(F.lit(1)) / n).alias("p"))
    obs = (features.select("doc_id", "term", F.col(value_col).alias("x"))
                   .join(labels.select("doc_id", "label"), "doc_id")
                   .groupBy("term", "label").agg(F.sum("x").alias("o")))
    # priors: one row per class.
    per_term = (obs.join(F.broadcast(priors), "label")
                   .groupBy("term")
                   .agg(F.sum(F.col("o") * F.col("o") / F.col("p")).alias("a"),
                        F.sum("o").alias("f")))
    return per_term.select("term", (F.col("a") / F.col("f") - F.col("f")).alias("chi2"))


def chi2_top_k(scores: DataFrame, k: int = SELECT_K, digits: int | None = 6) -> DataFrame:
    """The k terms with the highest score (ties by term), with their rank.

    Scores are rounded to ``digits`` before ranking so that floating-point noise
    from summation order cannot reorder equal scores.
    """
    s = scores.withColumn("chi2", F.round("chi2", digits)) if digits is not None else scores
    top = s.orderBy(F.desc("chi2"), F.asc("term")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("chi2"), F.asc("term"))))


def word_index(corpus: DataFrame, num_words: int | None = NUM_WORDS) -> DataFrame:
    """(word, id, n) with ids from 1 by count desc, ties by word; only ids < num_words.

    The corpus text is split on blanks (it is already cleaned).
    """
    counts = (corpus.select(F.explode(words("text")).alias("word"))
                    .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    if num_words:
        counts = counts.orderBy(F.desc("n"), F.asc("word")).limit(num_words - 1)
    ids = counts.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("word"))))
    return ids.select("word", "id", "n")


def token_sequences(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, seq) -- each document's words replaced by their ids, unknown words skipped.

    An index of at most ``LOCAL_ROWS`` words (one cut by :func:`word_index` has fewer than
    ``num_words``) is sent to the tasks, which look a text's words up in one pass: only
    texts move, once, to bring together those of equal ``doc_id``, whose words go by
    position, then id.  A larger index, or one with repeated words, is joined with the
    exploded words.  Documents without a known word get an empty sequence.
    """
    known = index.select("word", "id").filter(F.col("word").isNotNull() & (F.col("word") != ""))
    local = known.limit(LOCAL_ROWS + 1).toArrow()
    if local.num_rows > LOCAL_ROWS or len(local["word"].unique()) < local.num_rows:
        return _joined_sequences(corpus, index)
    kind = corpus.schema["doc_id"].dataType.simpleString()
    sent = corpus.sparkSession.sparkContext.broadcast(local.combine_chunks())
    texts = corpus.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def look_up(batches):
        table = sent.value
        found, ids = table["word"].combine_chunks(), table["id"].combine_chunks()
        for batch in batches:
            for at in range(0, batch.num_rows, LOOKED_UP):
                part = batch.slice(at, LOOKED_UP)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _sequences(part.column("texts"), found, ids)],
                                                 names=["doc_id", "seq"])

    return texts.mapInArrow(look_up, f"doc_id {kind}, seq array<{index.schema['id'].dataType.simpleString()}>")


def _sequences(texts: pa.ListArray, found: pa.Array, ids: pa.Array) -> pa.ListArray:
    """The ids of the words of each list of texts, by position in their text, then id."""
    split = pc.split_pattern(pc.list_flatten(texts), " ")
    doc_of_text = pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)
    words, text_of_word = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    place = pc.index_in(words, value_set=found)
    hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
    place, doc = place.take(pa.array(hit)), doc_of_text[text_of_word[hit]]
    if len(doc_of_text) and (np.diff(doc_of_text) == 0).any():
        # Places in a text count its words, not the empty strings between blanks.
        word = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0).cumsum()
        first = np.concatenate([[0], np.flatnonzero(np.diff(text_of_word)) + 1])
        start = np.zeros(len(doc_of_text), np.int64)
        start[text_of_word[first]] = word[first]
        # A text that begins with a blank counts from its first word.
        blank = pc.binary_length(words).to_numpy(zero_copy_only=False)[first] == 0
        start[text_of_word[first]] += blank
        order = np.lexsort((ids.take(place).to_numpy(zero_copy_only=False), word[hit] - start[text_of_word[hit]], doc))
        place = place.take(pa.array(order))
    ends = np.concatenate([[0], np.bincount(doc, minlength=len(texts)).cumsum()])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(place))


def _joined_sequences(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """``token_sequences`` by an equi-join of the words with an index of any size.  The
    per-document ``collect_list`` aggregates partially: the words of a document come
    from one input row, so one partial list per document is shuffled, not the words.
    """
    pos = corpus.select("doc_id", F.posexplode_outer(words("text")).alias("pos", "word"))
    hits = pos.join(index.select("word", "id"), "word", "left")
    item = F.when(F.col("id").isNotNull(), F.struct("pos", "id"))
    seqs = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return seqs.select("doc_id", F.transform("items", lambda x: x["id"]).alias("seq"))


def pad_sequences(seq, maxlen: int = MAX_SEQUENCE_LENGTH):
    """N4 (Column): left zero-pad to ``maxlen``; longer sequences keep their last ``maxlen`` ids."""
    s = F.col(seq) if isinstance(seq, str) else seq
    start = F.greatest(F.size(s) - maxlen, F.lit(0)) + 1
    tail = F.slice(s, start, F.lit(maxlen))
    return F.concat(F.array_repeat(F.lit(0), F.lit(maxlen) - F.size(tail)), tail)


def embedding_table(index: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """N5 + J8: (id, word, vec) for id 0 and every id of ``index``.

    ``vectors`` has (word, vec ARRAY<FLOAT>).  Row 0 and words without a vector
    get a zero vector of length ``dim``.  ``index`` already stops below
    ``num_words`` (see :func:`word_index`).
    """
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    rows = (index.select("id", "word")
                 .join(vectors.select("word", "vec"), "word", "left")
                 .select("id", "word", F.coalesce(F.col("vec"), zeros).alias("vec")))
    zero_row = index.sparkSession.range(1).select(
        F.lit(0).cast("int").alias("id"), F.lit(None).cast("string").alias("word"),
        zeros.alias("vec"))
    return zero_row.unionByName(rows)
