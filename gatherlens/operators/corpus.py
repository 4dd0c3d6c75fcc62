"""Topic corpora for classification.

A document table has ``doc_id``, ``text`` and ``topic``.  The corpus builder
cleans the text (X5), drops rows with an empty topic or text (F2), ranks topics
by document count, and for every N in ``topic_ns`` keeps the documents of the
N most frequent topics with an integer label and a train/test flag -- one job,
no driver-side loop over N.

Scale notes: topic ranking aggregates to one row per topic before the (global)
rank, so the single-partition step sees only distinct topics.  The top topics
joined back are at most max(topic_ns) rows, a proven bound, so that side is
broadcast.  The split is a per-document hash, needing no shuffle at all.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherlens.functions.text import clean_text

# Fixed values of the reference: the four corpus sizes and the split.
TOPIC_NS = (5, 10, 15, 20)
TEST_FRACTION = 0.2
SEED = 42


def clean_corpus(docs: DataFrame, text_col: str = "text", topic_col: str = "topic") -> DataFrame:
    """F2 + X5: (doc_id, topic, text) with cleaned text; empty topic or text dropped.

    The rows are dealt by ``doc_id`` once, before the cleaning; the steps that follow per
    document (term counts, norms, label joins) keep to that partitioning.
    """
    docs = docs.select("doc_id", F.col(topic_col).alias("topic"), F.col(text_col).alias("text"))
    docs = docs.filter(F.col("topic") != "").repartition("doc_id")
    # Keep rows whose cleaned text is neither null nor empty with a generator
    # (zero or one row per document): a filter on the cleaned text would be
    # pushed below the projection and the exchange, cleaning every text twice.
    kept = F.array_compact(F.array_remove(F.array(clean_text("text")), ""))
    return docs.select("doc_id", "topic", F.explode(kept).alias("text"))


def topic_rank(corpus: DataFrame) -> DataFrame:
    """A7 + T2: documents per topic and the topic's rank (count desc, then name)."""
    counts = corpus.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), F.asc("topic"))
    return counts.withColumn("rank", F.row_number().over(order))


def split_bucket(key, seed: int = SEED) -> Column:
    """M2 helper: a stable bucket 0..99 from the md5 of ``key:seed``."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))


def split_flag(key="doc_id", test_fraction: float = TEST_FRACTION, seed: int = SEED) -> Column:
    """M2: 'test' for about ``test_fraction`` of the keys, else 'train'; deterministic."""
    cut = int(round(test_fraction * 100))
    return F.when(split_bucket(key, seed) < cut, F.lit("test")).otherwise(F.lit("train"))


def train_test_split(corpus: DataFrame, test_fraction: float = TEST_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """M2: adds ``split`` ('train' | 'test') by a hash of doc_id (not stratified)."""
    return corpus.withColumn("split", split_flag("doc_id", test_fraction, seed))


def topic_corpora(corpus: DataFrame, topic_ns: Sequence[int] = TOPIC_NS,
                  topic_ids: DataFrame | None = None,
                  test_fraction: float = TEST_FRACTION, seed: int = SEED, body: str = "text") -> DataFrame:
    """M1 (T3, F3, J7, M2): the corpora of the top-N topics for each N.

    ``topic_ids`` (topic, topic_id) maps topic names to label ids (J7); without it
    the label is the topic's rank - 1.  Columns: topic_n, doc_id, topic, label,
    split, text (or ``body``, what the corpus has instead of it).
    """
    ns = sorted(set(int(n) for n in topic_ns))
    top = topic_rank(corpus).filter(F.col("rank") <= ns[-1])
    if topic_ids is not None:
        top = top.join(topic_ids.select("topic", F.col("topic_id").alias("label")), "topic")
    else:
        top = top.withColumn("label", (F.col("rank") - 1).cast("int"))
    sizes = F.filter(F.array(*[F.lit(n) for n in ns]), lambda n: F.col("rank") <= n)
    top = top.select("topic", "label", F.explode(sizes).alias("topic_n"))
    # ``top`` has at most len(ns) * max(ns) rows.
    out = corpus.join(F.broadcast(top), "topic")
    return out.select("topic_n", "doc_id", "topic", "label",
                      split_flag("doc_id", test_fraction, seed).alias("split"), body)


def ranked_corpus(corpus: DataFrame, max_topics: int = TOPIC_NS[-1],
                  test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """M1 without copies: (doc_id, topic, rank, split, text), one row per document of the
    ``max_topics`` most frequent topics.  The corpus of the top N is ``rank <= N``."""
    top = topic_rank(corpus).filter(F.col("rank") <= max_topics).select("topic", "rank")
    # at most max_topics rows
    return corpus.join(F.broadcast(top), "topic").select(
        "doc_id", "topic", "rank", split_flag("doc_id", test_fraction, seed).alias("split"), "text")


def category_topics(groups: DataFrame, mapping: DataFrame, unmapped: str = "error") -> DataFrame:
    """Attach ``topic`` from a (category_id, topic) table to rows with ``category``.

    ``unmapped``: 'error' (the reference's) fails the job on the first row whose
    category is not in the table, 'keep' keeps such rows with a null topic, 'drop'
    removes them.
    """
    m = mapping.select(F.col("category_id").alias("category"), "topic")
    if unmapped == "drop":
        return groups.join(m, "category")
    joined = groups.join(m, "category", "left")
    if unmapped == "keep":
        return joined
    if unmapped == "error":
        check = F.assert_true(F.col("topic").isNotNull() | F.col("category").isNull(),
                              F.concat(F.lit("unmapped category "), F.col("category").cast("string")))
        return joined.withColumn("topic", F.coalesce(check.cast("string"), F.col("topic")))
    raise ValueError(f"unmapped must be 'drop', 'keep' or 'error', not {unmapped!r}")
