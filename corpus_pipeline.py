"""Corpus pipeline: language ID, near-duplicate groups, secrets, source mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept
and returns a DataFrame; all but the last return the columns of ``docs`` as they are.
``run`` writes each result as Parquet in the shared folder and rereads it for the next.

Decisions are found on short rows (no texts) and staged.  The rows that must go are then
taken out by an anti join on a row key, which the planner broadcasts only if the staged
table is small; else it shuffles (near_duplicates: only rows that may be in it, ``_split``).  Empty tables pass through; nulls and repeated rows are
handled as the stages say; other columns stay as they are, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm import langid, mixing, ngram_join, pieces, secret_scan
from gatherlens.llm.common import free_name, row_hash, staged

# A bitmap of keys: bits of a page (as bitmap_construct_agg makes them), pages at most, bits a key.
PAGE, PAGES, KEY_BITS = 1 << 15, 1 << 11, 16


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of the whole row (128 bits), and the name of that column, which
    no other column has."""
    key = free_name(docs, "row_key")
    return docs.withColumn(key, row_hash(*[F.col(f"`{c}`") for c in docs.columns])), key


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _split(rows: DataFrame, key: str, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key is surely not in ``listed``, and the rest, which may be: a bitmap of
    the listed keys' hashes tells them apart, so that joins move the texts of the rest only.
    The bitmap has PAGES pages of PAGE bits at most; more keys only make the rest larger."""
    pages = max(1, min(PAGES, -(-listed.count() * KEY_BITS // PAGE)))
    slot = F.pmod(F.xxhash64(key), F.lit(pages * PAGE))
    page, bits = free_name(rows, "page"), free_name(rows, "bits")
    place = (slot % PAGE).cast("long")
    filled = staged(listed.select(F.floor(slot / PAGE).alias(page), place.alias("place")).groupBy(page).agg(
        F.bitmap_construct_agg("place").alias(bits)), "listed-bits")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    # at most PAGES rows of PAGE bits: 8 MB
    marked = rows.withColumn(page, F.floor(slot / PAGE)).join(F.broadcast(filled), page, "left").withColumn(bits, found).drop(page)
    return marked.where(~F.col(bits)).drop(bits), marked.where(bits).drop(bits)


def language_id(spark, docs, sf_dir):
    """Drops documents whose language can't be told (no words, noise, undecided).  The
    text model is fitted on a bounded sample of ``docs`` labelled by ``lang``."""
    keyed, key = _keyed(docs)
    model = langid.train(docs, "text", "lang")
    found = langid.identify(keyed, model, key, F.col("text"), host=F.col("source"))
    rejected = staged(found.where(~F.col("kept")).select(key).distinct(), "rejected")
    return keyed.join(rejected, key, "left_anti").select(*_columns(docs))


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document, that of the smallest doc_id, of each component of documents
    whose 5-word shingle sets have a Jaccard of 0.8 or more.  Of rows that repeat as a
    whole one stays; documents without words have no partner."""
    keyed, key = _keyed(docs)
    row = F.struct(F.col("doc_id"), F.col(key).alias("key"))
    groups = ngram_join.join_groups(keyed.select(row.alias("row"), "text"), "row")
    rows = staged(groups.select(F.col("row.key").alias(key), F.col("component_id.key").alias("head")), "groups")
    others = staged(rows.where(F.col(key) != F.col("head")).select(key).distinct(), "others")
    repeated = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    clear, rest = _split(keyed, key, others.union(repeated))
    kept = rest.join(others, key, "left_anti")
    single = kept.join(repeated, key, "left_anti")
    first = kept.join(repeated, key, "left_semi").dropDuplicates([key])
    return clear.unionByName(single).unionByName(first).select(*_columns(docs))


def secrets(spark, docs, sf_dir):
    """Replaces every secret in the texts and sets ``n_chars`` anew; keeps all rows."""
    out = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*_columns(docs))


def mix(spark, docs, sf_dir):
    """Repeats each document by its source's Poisson rate and shuffles globally."""
    return mixing.mix_sources(docs).select(*_columns(docs))


def encode(spark, docs, sf_dir):
    """Two sampled segmentations of each row, each checked to decode to its text."""
    return pieces.encode(docs, pieces.load())


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets),
          ("mixing sources", mix), ("SentencePiece encoding", encode)]

#: Trained models, components and sampled lattices have no SQL form; the tests run the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i + 1}")
    return docs
