"""Language identification by Bayesian evidence fusion.

For each language the evidence adds up in log space: the text's likelihood (hashed
byte 4-grams, multinomial), the declared markup language (right with a set
reliability), and the prior of the host.  Host priors are counts of text decisions
by grouped aggregation, smoothed hierarchically: host to address suffix, suffix to
the whole table.  A document goes (``kept`` false) if it has no 4-gram with letters,
if its text is likelier under uniform noise than under every language, or if no
language reaches ``min_confidence``.

Only the text model is fitted on a sample (``per_language`` labelled rows of each
language, expected).  Texts are read once to score; what then moves between tasks is
one short row per document.  The join of documents to host priors is between two
staged tables, so the adaptive planner can split a hot host.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import chunks, staged, tidy, utf8

LANGUAGES = ("de", "en", "es", "fr")
BITS = 16
CHUNK = 1 << 20  # bytes of text whose grams a task holds
PER_LANGUAGE = 2000
# Log-probabilities are whole numbers of 2^-16, so sums do not depend on their order.
UNIT = 1 << 16
# Each byte lies in four 4-grams: a gram counts as a quarter of an observation.
TEXT_WEIGHT = 0.25
RELIABILITY = 0.9
HOST_STRENGTH, SUFFIX_STRENGTH = 20.0, 50.0
MIN_CONFIDENCE = 0.5
MIN_GRAMS = 20

# Letters fold to lower case, bytes of non-ASCII characters stay, others are blanks.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 4-grams of each text whose two middle bytes are letters, and
    how many each text has.  Texts are set off by blanks."""
    joined = FOLD[np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)]
    n = len(joined) - 3
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    a, b, c, d = (joined[i:i + n] for i in range(4))
    at = np.flatnonzero((b != 32) & (c != 32))
    code = (a[at].astype(np.uint32) | b[at].astype(np.uint32) << 8 | c[at].astype(np.uint32) << 16
            | d[at].astype(np.uint32) << 24)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])
    per_text = np.diff(np.searchsorted(at, starts))
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), per_text


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches, "text", CHUNK):
        texts, labels = utf8(batch.column("text")), batch.column("label").to_pylist()
        for label in set(labels):
            own, _ = grams([t for t, x in zip(texts, labels) if x == label])
            n = np.bincount(own, minlength=1 << BITS)
            total[label] = total.get(label, 0) + n
    for label, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()),
                                          "n": pa.array(n[at], pa.int64())})


def train(labelled: DataFrame, text: str, label: str, languages=LANGUAGES, per_language: int = PER_LANGUAGE,
          id_col: str = "doc_id") -> np.ndarray:
    """Log-probabilities (in units) of each bucket under each language, fitted on
    about ``per_language`` rows of each, chosen by a hash of their id.  Rows with
    another label or a null text are left out; a language without rows is uniform."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"),
                           F.col(f"`{label}`").alias("label")).where(
        F.col("label").isin(list(languages)) & F.col("text").isNotNull())
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("label") == name, F.lit(per_language / n)).otherwise(share)
    place = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = rows.where(place < share).select("text", "label").mapInArrow(
        tidy(_counts), "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), 1 << BITS), 0.5)
    for i, name in enumerate(languages):
        own = found[found["label"] == name]
        counts[i, own["bucket"].to_numpy(np.int64)] += own["n"].to_numpy()
    return np.round(UNIT * np.log(counts / counts.sum(axis=1, keepdims=True))).astype(np.int32)


def _scores(model: np.ndarray):
    def run(batches):
        for batch in chunks(batches, "text", CHUNK):
            buckets, per_text = grams(utf8(batch.column("text")))
            ends = np.cumsum(per_text)
            sums = []
            for row in model:
                total = np.concatenate([[0], np.cumsum(row[buckets], dtype=np.int64)])
                sums.append(total[ends] - total[ends - per_text])
            lists = pa.ListArray.from_arrays(np.arange(0, (len(ends) + 1) * len(model), len(model), dtype=np.int32),
                                             pa.array(np.stack(sums, axis=1).ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("declared"), batch.column("host"), batch.column("suffix"),
                 pa.array(per_text, pa.int64()), lists], names=["id", "declared", "host", "suffix", "n_grams", "units"])
    return run


def identify(docs: DataFrame, model: np.ndarray, id_col: str, text, declared=None, host=None, suffix=None,
             languages=LANGUAGES, reliability: float = RELIABILITY, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per row of ``docs``: the id, lang, confidence (posterior), text_lang
    (by text alone), n_grams, kept.  ``text``, ``declared``, ``host`` and ``suffix``
    are columns; missing or null evidence adds nothing (a null host is one host of
    its own).  Null and empty texts are decided by the other evidence and not kept.
    Ties go to the language listed first.  Other columns of ``docs`` play no part."""
    null = F.lit(None).cast("string")
    size = len(languages)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(declared if declared is not None else null).alias("declared"),
                       F.coalesce(host if host is not None else null, F.lit("")).alias("host"),
                       F.coalesce(suffix if suffix is not None else null, F.lit("")).alias("suffix"), text.alias("text"))
    scored = rows.mapInArrow(tidy(_scores(model)), f"id {kind}, declared string, host string, suffix string, "
                                             f"n_grams long, units array<long>")
    best = F.array_position("units", F.array_max("units")).cast("int")
    noise = F.col("n_grams") * F.lit(-float(np.round(UNIT * np.log(1 << BITS))))
    scored = scored.withColumn("text_at", F.when(F.col("n_grams") > 0, best)).withColumn(
        "clear", (F.col("n_grams") >= MIN_GRAMS) & (F.array_max("units") > noise)).withColumn(
        "noise", F.array_max("units") <= noise)
    scored = staged(scored, "language-scores")

    # Counts of clear text decisions per host, then the smoothing from the top down.
    seen = F.array(*[F.sum(F.when(F.col("clear") & (F.col("text_at") == i + 1), 1).otherwise(0)) for i in range(size)])
    hosts = staged(scored.groupBy("host", "suffix").agg(seen.alias("n")), "host-counts")
    add = F.array(*[F.sum(F.col("n")[i]) for i in range(size)])
    top = hosts.agg(add.alias("n")).first()["n"]
    top = np.array([x or 0 for x in top], np.float64) + 1
    top = F.array(*[F.lit(float(x)) for x in top / top.sum()])

    def smoothed(counts, prior, strength):
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda n, p: (n + F.lit(strength) * p) / (total + F.lit(strength)))

    suffixes = staged(hosts.groupBy("suffix").agg(add.alias("n")).select(
        F.col("suffix"), smoothed(F.col("n"), top, SUFFIX_STRENGTH).alias("p_suffix")), "suffix-priors")
    priors = staged(hosts.join(suffixes, "suffix").select(
        "host", "suffix", smoothed(F.col("n"), F.col("p_suffix"), HOST_STRENGTH).alias("prior")), "host-priors")

    fused = scored.join(priors, ["host", "suffix"])
    known = F.coalesce(F.col("declared").isin(list(languages)), F.lit(False))
    miss = (1 - reliability) / max(size - 1, 1)
    logs = F.array(*[F.struct((F.col("units")[i] * F.lit(TEXT_WEIGHT / UNIT) + F.log(F.col("prior")[i])
                               + F.when(known, F.log(F.when(F.col("declared") == name, F.lit(reliability))
                                                     .otherwise(F.lit(miss)))).otherwise(F.lit(0.0))).alias("log"),
                              F.lit(-i).alias("at")) for i, name in enumerate(languages)])
    fused = fused.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x["log"] - F.col("most.log")))
    names = F.array(*[F.lit(x) for x in languages])
    fused = fused.withColumn("confidence", 1 / total)
    return fused.select(
        F.col("id").alias(id_col), F.get(names, -F.col("most.at")).alias("lang"),
        F.round("confidence", 9).alias("confidence"), F.get(names, F.col("text_at") - 1).alias("text_lang"), "n_grams",
        ((F.col("n_grams") > 0) & ~F.col("noise") & (F.col("confidence") >= min_confidence)).alias("kept"))
