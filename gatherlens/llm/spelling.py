"""Groups of spelling variants, by reduced alphabets.

Every letter is hashed to one of a few symbols.  Two words that differ by one edit have
reduced words that are equal or differ by one edit, so the distinct reduced words are
joined with their full one-edit neighbourhoods (every deletion, replacement and insertion
over the few symbols), the words of each joined pair of reduced words meet, and the
distance of the original strings decides.

The number of symbols follows the number of words (about its sixth root), so that
reduced words stay rare and a neighbourhood stays short; it changes no result.  Words
meet in joins of two plain exchanges whose condition holds the check, so a pair that is
not near is never a row, and a frequent reduced word is split by the adaptive planner.
Only DataFrame functions are used.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import staged

#: Runs of letters: A-Z, a-z, and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]"
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
MIN_LENGTH, MIN_COUNT = 6, 5
RATIO = 5
ERROR_EVERY = 199
SYMBOLS = "abcdefghijklmnopqrstuvwxyz"
LEAST_SYMBOLS = 4
TASK_WORDS = 1 << 14   # reduced words whose neighbourhoods a task makes


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row ``word`` per maximal run of letters of the texts that has ``min_length``
    letters or more, A-Z in lower case.  Where ERROR_EVERY divides the CRC-32 of
    ``<id>:<run>``, the run loses the letter at CRC-32 modulo its length, and stays if it
    is still long enough.  Null texts have no runs; a null id is the text 'null'."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"),
                       F.explode(F.regexp_extract_all(lower_ascii(F.col(f"`{text}`")),
                                                      F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("crc", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("crc") % F.length("run")).cast("int")
    word = F.when(F.col("crc") % ERROR_EVERY == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run"))))
    return runs.select(F.coalesce(word, F.col("run")).alias("word")).where(F.length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``min_count`` times or more; sums within tasks first."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet for a number of words."""
    return min(len(SYMBOLS), max(LEAST_SYMBOLS, round(words ** (1 / 6))))


def reduced(word: Column, symbols: int) -> Column:
    """The word with each letter hashed to one of the symbols (others count as one letter)."""
    # A multiplicative hash of the code point.
    image = "".join(SYMBOLS[(ord(c) * 0x9E3779B1 & 0xFFFFFFFF) * symbols >> 32] for c in LETTERS)
    return F.translate(F.regexp_replace(word, f"[^{LETTERS}]", LETTERS[0]), LETTERS, image)


def neighbourhood(word: Column, symbols: int) -> Column:
    """All distinct words within one edit of ``word`` over the symbols, itself included."""
    n = F.length(word)
    letters = F.array(*[F.lit(s) for s in SYMBOLS[:symbols]])
    before = lambda i: F.substring(word, F.lit(1), i)            # the first i letters
    after = lambda i: F.substring(word, i + F.lit(1), n)         # all but the first i
    places = F.sequence(F.lit(0), n - 1)
    dropped = F.transform(places, lambda i: F.concat(before(i), after(i + 1)))
    changed = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda s: F.concat(before(i), s, after(i + 1)))))
    added = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda s: F.concat(before(i), s, after(i)))))
    return F.array_distinct(F.concat(F.array(word), dropped, changed, added))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of rows of ``words`` (word, n; each word
    once, none empty or null) that differ by exactly one letter more, less or other."""
    words = staged(words.select("word", "n"), "words")
    number = words.count()
    symbols = symbols_for(number)
    words = staged(words.select("word", "n", reduced(F.col("word"), symbols).alias("r")), "reduced-words")
    # Small rows that grow a hundredfold: dealt to tasks by their number, not by their bytes.
    known = staged(words.select("r").distinct(), "reduced").repartition(number // TASK_WORDS + 1, "r")
    pairs = known.select("r", F.explode(neighbourhood(F.col("r"), symbols)).alias("near_r")).join(
        known.select(F.col("r").alias("near_r")), "near_r")
    pairs = staged(pairs, "reduced-pairs")
    left = words.join(pairs, "r").select("word", "n", "near_r")
    right = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("r").alias("near_r"))
    return left.join(right, (left["near_r"] == right["near_r"]) & (F.levenshtein("word", "near", 1) == 1)).select(
        "word", "n", "near", "near_n")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest word in code-point
    order), if that n is at least ``ratio`` times (2 or more) the word's; else null.  The root is found by
    following forms; a word without form is its own.  n_near counts the near words;
    form_n is the form's n.  Empty tables give empty results.
    """
    if ratio < 2:
        raise ValueError("forms could lead back to a word")
    words = staged(words.select("word", "n"), "vocabulary")
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    best = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                   F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    has = F.col("near_n") >= ratio * F.col("n")
    best = staged(best.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"),
                              F.when(has, F.col("near_n")).alias("form_n")), "forms")
    # Pointer doubling: n grows by the ratio at each step, so paths are short.
    roots = staged(best.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return best.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``forms`` of the frequent words of the texts (see ``noisy_words``, ``vocabulary``).
    Null and empty texts have no words; rows that repeat count each; tables without
    frequent words give no rows; other columns play no part, whatever their names."""
    return forms(vocabulary(noisy_words(docs, id_col, text, min_length), min_count), ratio)
