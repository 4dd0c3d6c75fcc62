"""Quality rules: base rules on words, then a hashed n-gram log-likelihood ratio.

Words and neighbouring word pairs are hashed into buckets.  One multinomial over the
buckets is counted on trusted target documents, one on the whole raw corpus.  A
document's score is the mean over its n-grams of the log ratio of the two (target
over raw); it is kept if it passes the base rules and scores at least ``threshold``.

How low good documents score depends on how many n-grams the target was counted on.
So the threshold can be read off trusted documents that were held out of the target
(``held_out``): it is the score that all but ``HELD_OUT_SHARE`` of them reach, or their
mean less ``HELD_OUT_SPREAD`` standard deviations if that is lower (a few rows do not
show the lowest scores), and it moves with the scores at every size of the trusted set.

Every document is counted and scored, and every trusted row of the labels is counted or
held out.  Counting adds up vectors of a fixed number of buckets within each task before
the shuffle.  Trusted ids meet the documents in plain joins, broadcast only where the
planner finds them small.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import chunks, hash_words, mix, staged, utf8, windows

BITS = 16
# A kept document is at most exp(0.4) times as likely under the raw corpus, per n-gram.
THRESHOLD = -0.4
# Share of the held-out trusted documents that may score below the threshold.
HELD_OUT_SHARE = 0.001
HELD_OUT_SPREAD = 3.0
# Log ratios are whole numbers of 2^-20, so sums do not depend on their order.
UNIT = 1 << 20
PRIOR = float(1 << BITS)
# The symbols and limits of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def buckets(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the word pairs within each text, in text order,
    and how many each text has.  ``sizes``: words of each text."""
    ends = np.cumsum(sizes)
    pairs = windows(hashes, 2)
    inside = np.ones(len(pairs), bool)
    inside[(ends[(ends > 0) & (ends < len(hashes))]) - 1] = False
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.concatenate([mix(hashes), pairs[inside]]) >> np.uint64(64 - BITS)
    owners = np.concatenate([owner, owner[:-1][inside] if len(owner) else owner])
    order = np.argsort(owners, kind="stable")
    return codes[order].astype(np.int64), np.bincount(owners, minlength=len(sizes))


def _words(batch):
    words = [t.split() for t in utf8(batch.column("text"))]  # ASCII blanks, as the rules' words
    sizes = np.array([len(w) for w in words], np.int64)
    return words, sizes, hash_words([w for ws in words for w in ws])


def _counts(batches):
    raw, trusted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in chunks(batches, "text"):
        _, sizes, hashes = _words(batch)
        codes, per_text = buckets(hashes, sizes)
        raw += np.bincount(codes, minlength=1 << BITS)
        good = np.repeat(np.array(batch.column("trusted").to_pylist(), bool), per_text)
        trusted += np.bincount(codes[good], minlength=1 << BITS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "raw": pa.array(raw[at], pa.int64()),
                                      "trusted": pa.array(trusted[at], pa.int64())})


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside 5-word windows that occur twice or more in the text.  Hashes find
    the windows, the words themselves decide."""
    codes = windows(hashes, WINDOW)
    if len(codes) < 2:
        return 0
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    twice = np.zeros(len(codes) + 1, bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return 0
    found = [tuple(words[i:i + WINDOW]) for i in at.tolist()]
    n = Counter(found)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at.tolist(), found):
        if n[w] > 1:
            covered[i] += 1
            covered[min(i + WINDOW, len(words))] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_stats(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    inside = b"".join(words)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return chars, symbols, len(lines) - len(set(lines)), repeated_words(words, hashes)


def _judged(ratio: np.ndarray):
    def run(batches):
        for batch in chunks(batches, "text"):
            texts = utf8(batch.column("text"))
            words, sizes, hashes = _words(batch)
            codes, per_text = buckets(hashes, sizes)
            total = np.concatenate([[0], np.cumsum(ratio[codes], dtype=np.int64)])
            ends, stops = np.cumsum(per_text), np.cumsum(sizes)
            stats = [base_stats(t, w, hashes[e - len(w):e]) for t, w, e in zip(texts, words, stops.tolist())]
            columns = list(zip(*stats))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), *[pa.array(c, pa.int64()) for c in columns],
                 pa.array(per_text, pa.int64()), pa.array(total[ends] - total[ends - per_text], pa.int64())],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_ngrams", "units"])
    return run


def log_ratio(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text: str) -> np.ndarray:
    """Log ratio (in units) of each bucket: trusted target over raw corpus.  The raw
    corpus has one added to each bucket; the target is shrunk to it with the weight of
    PRIOR n-grams, so that few trusted rows tell little.  ``trusted_ids``: one column
    of ids."""
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("t_id")).where("t_id IS NOT NULL").distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).join(
        ids, F.col("id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("trusted"))
    found = rows.mapInArrow(_counts, "bucket long, raw long, trusted long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, target = np.ones(1 << BITS), np.zeros(1 << BITS)
    raw[found["bucket"].to_numpy(np.int64)] += found["raw"].to_numpy()
    target[found["bucket"].to_numpy(np.int64)] += found["trusted"].to_numpy()
    raw /= raw.sum()
    target = (target + PRIOR * raw) / (target.sum() + PRIOR)
    return np.round(UNIT * np.log(target / raw)).astype(np.int64)


def trusted_rows(labels: DataFrame, id_col: str, good) -> DataFrame:
    """Ids (not null) of all rows of ``labels`` for which the column ``good`` holds."""
    return staged(labels.where(good).select(F.col(f"`{id_col}`").alias("t_id")).where("t_id IS NOT NULL"), "trusted-ids")


trusted_sample = trusted_rows  # its name while it took a sample


def held_out_half(trusted_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trusted ids in two halves by a hash: those to count, those to hold out."""
    held = F.pmod(F.xxhash64("t_id", F.lit("held out")), F.lit(2)) == 1
    return trusted_ids.where(~held), trusted_ids.where(held)


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD, held_out: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: the base figures, base_failed, score, kept.

    Null and empty texts have no words and fail the base rules.  Repeated rows are
    judged alike; an empty table gives no rows; other columns play no part.  Without
    trusted rows every score is 0, and the base rules decide.  With ``held_out`` (one
    column of ids, none of them trusted) the threshold follows their scores;
    where fewer than two of them pass the base rules, the base rules decide alone.
    """
    ratio = log_ratio(docs, trusted_ids, id_col, text)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        _judged(ratio), f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                        f"n_repeat_words long, n_ngrams long, units long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    score = F.when(F.col("n_ngrams") > 0, F.col("units") / F.lit(float(UNIT)) / F.col("n_ngrams"))
    if held_out is not None:
        rows = staged(rows, "quality-scores")  # one row of numbers per document
        ids = held_out.select(F.col(held_out.columns[0]).alias("t_id")).distinct()
        scores = rows.join(ids, F.col("id") == F.col("t_id"), "left_semi").where(~failed).select(score.alias("score"))
        low, mean, spread = scores.agg(F.percentile("score", F.lit(HELD_OUT_SHARE)), F.avg("score"), F.stddev("score")).first()
        threshold = float("-inf") if spread is None else min(low, mean - HELD_OUT_SPREAD * spread)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), F.round(score, 9).alias("score"),
                       (~failed & F.coalesce(score >= F.lit(threshold), F.lit(False))).alias("kept"))
