"""Text scalar functions: cleaning (X5), tokenising, stop words (S13 default).

Everything is a built-in Spark SQL expression over whole texts; nothing truncates.
"""
from __future__ import annotations

import functools
import glob
import os
import pathlib
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning rule of the reference.  Markup tags and every
# character that is not an ASCII letter become blanks; words of 3 or fewer
# letters are dropped.
MIN_WORD_LEN = 4

# Fixed value: the vectoriser's token rule, runs of two or more word characters.
TOKEN_PATTERN = r"\b\w\w+\b"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text) -> Column:
    """Strip tags and non-letters, lower-case, keep words longer than 3 letters.

    Null or empty input gives null; input with no qualifying word gives ''.
    Done in one regular-expression pass that finds, left to right, either a tag
    (dropped) or a run of at least ``MIN_WORD_LEN`` letters (kept): the same
    words as blanking tags and non-letters first and splitting on blanks, but
    without array lambdas, which do not take part in code generation.
    """
    t = _col(text)
    pattern = r"<[^<]+?>|([a-zA-Z]{%d,})" % MIN_WORD_LEN
    found = F.array_remove(F.regexp_extract_all(t, F.lit(pattern), 1), "")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("string")) \
            .otherwise(F.lower(F.array_join(found, " ")))


def words(text) -> Column:
    """Split text on blanks into its non-empty words (order kept)."""
    return F.filter(F.split(_col(text), " +"), lambda w: w != "")


def tokens(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-case and extract every match of ``pattern`` (order kept)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), 0)


def _jar_folders() -> list[str]:
    """Where Spark's jars can lie: under SPARK_HOME, or beside any parent of the
    pyspark package (which may itself be imported out of ``pyspark.zip``)."""
    import pyspark
    found = [os.path.join(os.environ["SPARK_HOME"], "jars")] if os.environ.get("SPARK_HOME") else []
    return found + [str(p / "jars") for p in pathlib.Path(pyspark.__file__).resolve().parents]


@functools.lru_cache(maxsize=None)
def default_stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark MLlib's stop-word list for ``language``.

    Read from the MLlib jar that ships with pyspark (the same resource
    ``StopWordsRemover.loadDefaultStopWords`` reads), so no JVM is needed and the
    Spark side and the SQL oracle see one list.
    """
    for folder in _jar_folders():
        for jar in glob.glob(os.path.join(folder, "spark-mllib_*.jar")):
            with zipfile.ZipFile(jar) as z:
                name = f"org/apache/spark/ml/feature/stopwords/{language}.txt"
                if name in z.namelist():
                    return tuple(w for w in z.read(name).decode("utf-8").split() if w)
    from pyspark.ml.feature import StopWordsRemover
    return tuple(StopWordsRemover.loadDefaultStopWords(language))
