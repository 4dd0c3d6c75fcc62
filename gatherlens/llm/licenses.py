"""License scans by diagonal voting.

Template notices are a fixed set of word sequences.  The hashes of all rolling word
pairs of every text are joined by Spark to the (broadcast, constant-size) template
positions.  A hit votes for the diagonal text position minus template position; votes
are aggregated per diagonal, neighbouring diagonals of one template are merged (a word
was added or left out), and a merged span counts if it holds enough of the template's
distinct positions.  A short phrase counts where every position of it votes on one
diagonal, that is, where its words stand consecutively.

Only hits (and one mark per text) are shuffled, by text, once.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatherlens.llm.common import chunks, hash_words, utf8, windows

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices whose spans add labels of the method's own.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
# Word pairs of two of these say nothing about a license; they are no template positions.
COMMON = frozenset("a and any are as by for in is it of or that the this to under use with you".split())
SLACK, MIN_COVER = 3, 0.75
MARK = -1

TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32
                 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and non-ASCII characters."""
    return text.translate(TO_WORDS).split()


def template_rows() -> list[tuple]:
    """(t_id, t_pos, gram, label, is_base, t_size): the positions of all templates; the
    mark row is met once by every text."""
    rows = [(-1, 0, MARK, None, False, 0)]
    for t, (phrase, label) in enumerate(BASE + NOTICES):
        words = phrase.encode().split()
        base = t < len(BASE)
        at = [i for i in range(len(words) - 1) if base or not {w.decode() for w in words[i:i + 2]} <= COMMON]
        codes = windows(hash_words(words), 2).view(np.int64)
        rows += [(t, i, int(codes[i]), label, base, len(at)) for i in at]
    return rows


def _grams(batches):
    for batch in chunks(batches, "text", 2 << 20):
        words = [split_words(t) for t in utf8(batch.column("text"))]
        sizes = np.array([len(w) for w in words], np.int64)
        hashes = hash_words([w for ws in words for w in ws])
        codes, offsets, ends = [], [0], np.cumsum(sizes)
        for n, end in zip(sizes.tolist(), ends.tolist()):
            codes += [windows(hashes[end - n:end], 2).view(np.int64), np.array([MARK])]
            offsets.append(offsets[-1] + max(n - 1, 0) + 1)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(codes), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(sizes, pa.int64()), lists],
                                         names=["row", "id", "n_words", "grams"])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_base (places of base phrases),
    first_word, last_word (their smallest and largest start; else null), base_labels,
    labels (distinct, sorted), spans (label, start word, end word, cover of verified
    spans) and score (the best cover, 0 without spans).

    Null and empty texts have no words, no labels and score 0.  Repeated rows are
    scanned alike.  Other columns play no part.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    templates = F.broadcast(spark.createDataFrame(
        template_rows(), "t_id int, t_pos int, gram long, label string, is_base boolean, t_size int"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{text}`").alias("text"))
    grams = rows.mapInArrow(_grams, f"row long, id {kind}, n_words long, grams array<long>")
    hits = grams.select("row", "id", "n_words", F.posexplode("grams").alias("pos", "gram")).join(templates, "gram")
    # All that follows is per text: one shuffle of the hits serves every step.
    hits = hits.drop("gram").withColumn("diagonal", F.when(F.col("t_id") >= 0, F.col("pos") - F.col("t_pos"))).repartition("row")
    lines = hits.groupBy("row", "id", "n_words", "t_id", "label", "is_base", "t_size", "diagonal").agg(
        F.collect_set("t_pos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("row", "t_id").orderBy("diagonal")
    far = F.col("is_base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    lines = lines.withColumn("span", F.sum(far.cast("int")).over(order))
    spans = lines.groupBy("row", "id", "n_words", "t_id", "label", "is_base", "t_size", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.min("diagonal").alias("diagonal"))
    cover = F.when(F.col("t_id") >= 0, F.col("held") / F.col("t_size"))
    base = F.col("is_base") & (cover == 1.0)
    good = base | (~F.col("is_base") & (cover >= MIN_COVER))
    found = spans.groupBy("row", "id", "n_words").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("diagonal").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal").cast("long"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.array_sort(F.collect_list(F.when(good, F.struct("label", F.col("first").alias("start"), (F.col("last") + 2).alias("end"),
                                                          F.round(cover, 6).alias("cover"))))).alias("spans"),
        F.round(F.coalesce(F.max(F.when(good, cover)), F.lit(0.0)), 9).alias("score"))
    return found.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                        "spans", "score")
