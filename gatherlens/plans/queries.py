"""Registered queries: the library's operators run over the driver's tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables.  Doubles are rounded to 6 decimals at the end so that the result can be
compared with the SQL oracle (:mod:`gatherlens.plans.oracle`) value by value.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherlens.functions import scalars as X
from gatherlens.functions import text as T
from gatherlens.operators import corpus as C
from gatherlens.operators import density as K
from gatherlens.operators import extratrees as XT
from gatherlens.operators import introspect as I
from gatherlens.operators import metrics as M
from gatherlens.operators import models as ML
from gatherlens.operators import occurrence as O
from gatherlens.operators import quantiles as Q
from gatherlens.operators import textfeat as TF
from gatherlens.operators import venues as V
from gatherlens.session import configure, materialize, scratch_dir, stored
from gatherlens.sources import entities as E
from gatherlens.sources import lookups as L
from gatherlens.sources import sinks as SK
from gatherlens.sources import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DIGITS = 6


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, *cols: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _eti(spark, sf_dir):
    return O.event_time_info(S.timed_events(spark, sf_dir), S.groups(spark, sf_dir))


# --------------------------------------------------------------------------- #
# Occurrence

@query
def event_time_info(spark, sf_dir):
    """Events with their group's city, topic, zone and local year/weekday/hour."""
    return _eti(spark, sf_dir).select("event_id", "group_id", "time", "city", "topic",
                                      "timezone", "local_time", "year", "weekday", "hour")


@query
def occurrence_yearly(spark, sf_dir):
    """A1 + A9: events per city, topic and local year, plus the 'US' roll-up."""
    return O.occurrence(_eti(spark, sf_dir), "year")


@query
def occurrence_daily(spark, sf_dir):
    """A2 + A9: events per city, topic and local weekday, plus the 'US' roll-up."""
    return O.occurrence(_eti(spark, sf_dir), "weekday")


@query
def occurrence_hourly(spark, sf_dir):
    """A3 + A4 + A9: events per city, topic, day type (Sunday = weekend) and local hour."""
    return O.occurrence(_eti(spark, sf_dir), "hour", weekend_start=6)


@query
def occurrence_daily_pivot(spark, sf_dir):
    """A10: the weekday table pivoted to one column per day, missing days = 0."""
    daily = O.occurrence(_eti(spark, sf_dir), "weekday")
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    return O.bucket_pivot(daily, ["city", "topic"], "weekday", range(7), names)


# The years of the pivot's columns: a parameter, so that no job looks for them.
YEARS = range(2010, 2031)
OTHER_YEAR = -1


@query
def occurrence_yearly_pivot(spark, sf_dir):
    """A10: the yearly table pivoted to one column per year of YEARS and one for all other
    years, missing years = 0, so that every event is in one cell."""
    yearly = O.occurrence(_eti(spark, sf_dir), "year")
    yearly = yearly.withColumn("year", F.when(F.col("year").isin(*YEARS), F.col("year")).otherwise(OTHER_YEAR))
    return O.bucket_pivot(yearly, ["city", "topic"], "year", [*YEARS, OTHER_YEAR], [*[f"y{y}" for y in YEARS], "other_years"])


@query
def occurrence_hourly_pivot(spark, sf_dir):
    """A10: the hourly table pivoted to one column per hour, missing hours = 0."""
    return O.bucket_pivot(_hourly(spark, sf_dir), ["city", "topic", "day_type"], "hour", range(24),
                          [f"h{h}" for h in range(24)])


@query
def occurrence_months(spark, sf_dir):
    """X9 + F7: events per local year and month, of the years 2015 to 2024."""
    eti = _eti(spark, sf_dir).filter(F.col("year").between(2015, 2024))
    return eti.groupBy("year", X.month("local_time").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query
def occurrence_all_months(spark, sf_dir):
    """Events per local year and month, of all years."""
    return _eti(spark, sf_dir).groupBy("year", X.month("local_time").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query
def occurrence_round_trip(spark, sf_dir):
    """S15 + S17: the occurrence table written by grain, the daily grain read back."""
    path = scratch_dir(spark, "occurrence")
    SK.write_occurrence(O.occurrence_cube(_eti(spark, sf_dir)), path)
    return SK.read_occurrence(spark, path, "daily").select("city", "topic", "bucket", "n")


@query
def city_topic_round_trip(spark, sf_dir):
    """Event times written by (city, topic), the first city's first topic read back."""
    path = scratch_dir(spark, "city-topic")
    eti = _eti(spark, sf_dir)
    SK.write_city_topic(eti.select("event_id", "city", "topic", "year", "hour"), path)
    city, topic = eti.agg(F.min(F.struct("city", "topic")).alias("first")).select("first.*").first() or (None, None)
    return SK.read_city_topic(spark, path, city, topic).select("event_id", "city", "topic", "year", "hour")


@query
def city_topic_round_trip_whole(spark, sf_dir):
    """Event times written by (city, topic), all folders read back."""
    path = scratch_dir(spark, "city-topic")
    eti = _eti(spark, sf_dir)
    SK.write_city_topic(eti.select("event_id", "city", "topic", "year", "hour"), path)
    return spark.read.parquet(path).select("event_id", "city", "topic", "year", "hour")


@query
def region_topic_share(spark, sf_dir):
    """Topic shares within the cities of one region only."""
    cities = S.read(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias("city"))
    counts = O.city_topic_counts(O.within_cities(_eti(spark, sf_dir), cities))
    return rounded(O.topic_share_city(counts), "pct")


@query
def occurrence_cube(spark, sf_dir):
    """S15 table: all four occurrence grains (+ 'US') from one grouping-sets pass."""
    return O.occurrence_cube(_eti(spark, sf_dir))


@query
def topic_share_us(spark, sf_dir):
    """A14 + A8: each topic's percentage of all events."""
    return rounded(O.topic_share_all(_eti(spark, sf_dir)), "pct")


@query
def topic_share_city(spark, sf_dir):
    """Topic percentage within each city."""
    counts = O.city_topic_counts(_eti(spark, sf_dir))
    return rounded(O.topic_share_city(counts), "pct")


@query
def topic_lift(spark, sf_dir):
    """Location quotient of each (city, topic); 100 = national average."""
    counts = O.city_topic_counts(_eti(spark, sf_dir))
    return rounded(O.topic_lift(counts), "lift")


@query
def distinct_topics(spark, sf_dir):
    """The topics that have events."""
    return O.distinct_topics(_eti(spark, sf_dir))


# The cities that become columns; a parameter, so that no job looks for them.
PIVOT_CITIES = ("NATION_0", "NATION_3", "NATION_6", "NATION_9", "NATION_12", "NATION_15", "NATION_18", "NATION_21")


@query
def topic_city_pivot(spark, sf_dir):
    """Events per topic, one column per city of PIVOT_CITIES and one for all other
    cities (missing = 0)."""
    return _city_pivot(spark, sf_dir, PIVOT_CITIES)


def _city_pivot(spark, sf_dir, cities):
    city = F.when(F.col("city").isin(*cities), F.col("city")).otherwise(F.lit("other"))
    return O.topic_city_pivot(O.city_topic_counts(_eti(spark, sf_dir).withColumn("city", city)), (*cities, "other"))


# All cities of the driver's nation table.
ALL_CITIES = tuple(f"NATION_{i}" for i in range(25))


@query
def topic_all_cities_pivot(spark, sf_dir):
    """Events per topic, one column per city of ALL_CITIES and one for any other
    city (missing = 0), so that every event is in one cell."""
    return _city_pivot(spark, sf_dir, ALL_CITIES)


@query
def top_topics_per_city(spark, sf_dir):
    """T4: the 5 topics with the largest share in each city (ties by name)."""
    shares = O.topic_share_city(O.city_topic_counts(_eti(spark, sf_dir)))
    return rounded(O.top_k_per(shares, "city", "pct", 5), "pct")


@query
def top_topics_us(spark, sf_dir):
    """T5: the 10 topics with the largest national share (a top-k report)."""
    return rounded(O.top_k(O.topic_share_all(_eti(spark, sf_dir)), "pct", 10), "pct")


@query
def daily_heat(spark, sf_dir):
    """Weekday shares of each scope's top-10 topics, ordered by weekend share."""
    daily = O.occurrence(_eti(spark, sf_dir), "weekday")
    return rounded(O.daily_heat(daily, top_n=10, weekend_start=5), "pct", "weekend_prop")


@query
def event_scatter(spark, sf_dir):
    """Every event's weekday and fractional local hour (all years)."""
    return rounded(O.event_scatter(_eti(spark, sf_dir)), "time_of_day")


@query
def event_scatter_years(spark, sf_dir):
    """R4 + F7: the scatter of the years 2023 and 2024 only."""
    return rounded(O.event_scatter(_eti(spark, sf_dir), years=(2023, 2024)), "time_of_day")


def _hourly(spark, sf_dir):
    return O.occurrence(_eti(spark, sf_dir), "hour", weekend_start=6)


@query
def hourly_density(spark, sf_dir):
    """K1: hour-of-day density curves per scope, topic and day type."""
    return rounded(K.hourly_density(_hourly(spark, sf_dir)), "x", "density")


@query
def best_hour(spark, sf_dir):
    """K2: the peak of each density curve."""
    dens = K.hourly_density(_hourly(spark, sf_dir))
    return rounded(K.best_hour(dens), "peak_x", "peak_density")


# --------------------------------------------------------------------------- #
# Venues (R7-R9)

def _gvi(spark, sf_dir):
    return V.group_venue_info(S.hosted_events(spark, sf_dir), S.venues(spark, sf_dir),
                              S.groups(spark, sf_dir))


@query
def canonical_location(spark, sf_dir):
    """A5: one location per distinct (lat, lon), named by its smallest venue id."""
    return V.canonical_locations(S.venues(spark, sf_dir))


@query
def group_venue_info(spark, sf_dir):
    """Hostings per (group, location) with group and venue attributes."""
    return _gvi(spark, sf_dir)


@query
def group_venue_flag(spark, sf_dir):
    """R7 with the binary host flag (at least 2 hostings)."""
    return V.group_venue_flag(_gvi(spark, sf_dir))


# Few (group, location) pairs of the driver's tables have more than 3 hostings, the
# feature's cut; the map is also made with more than 1, so that it has points.
MIN_HOSTS = 1


@query
def frequent_venues_cut(spark, sf_dir):
    """(group, location) pairs with more than 3 hostings, the default cut."""
    return V.frequent_venues(_gvi(spark, sf_dir))


@query
def city_venues_round_trip(spark, sf_dir):
    """S16 + S17: frequent venues written by city, the first city read back."""
    path = scratch_dir(spark, "city-venues")
    SK.write_by_city(V.frequent_venues(_gvi(spark, sf_dir), min_hosts=MIN_HOSTS), path)
    city = spark.read.parquet(path).agg(F.min("city")).scalar()
    return SK.read_city(spark, path, city).select("city", "venue_id", "group_id", "lat", "lon", "topic", "host_num")


@query
def city_venues_round_trip_whole(spark, sf_dir):
    """S16 + S17: frequent venues written by city, all cities read back."""
    path = scratch_dir(spark, "city-venues")
    SK.write_by_city(V.frequent_venues(_gvi(spark, sf_dir), min_hosts=MIN_HOSTS), path)
    return spark.read.parquet(path).select("city", "venue_id", "group_id", "lat", "lon", "topic", "host_num")


@query
def venue_map_topics(spark, sf_dir):
    """R9 + F8: the map of two topics only."""
    freq = V.frequent_venues(_gvi(spark, sf_dir), min_hosts=MIN_HOSTS)
    m = V.venue_map(freq, S.city_coordinates(spark, sf_dir), topics=("BUILDING 2", "MACHINERY 0"))
    return rounded(m, "x", "y", "size", "city_x", "city_y", digits=3)


@query
def frequent_venues(spark, sf_dir):
    """(group, location) pairs with more than MIN_HOSTS hostings, per city."""
    return V.frequent_venues(_gvi(spark, sf_dir), min_hosts=MIN_HOSTS)


@query
def venue_map(spark, sf_dir):
    """Frequent venues projected to Web Mercator with viewport flags."""
    freq = V.frequent_venues(_gvi(spark, sf_dir), min_hosts=MIN_HOSTS)
    m = V.venue_map(freq, S.city_coordinates(spark, sf_dir))
    return rounded(m, "x", "y", "size", "city_x", "city_y", digits=3)


# --------------------------------------------------------------------------- #
# Text, corpora and text features

def _corpus(spark, sf_dir, topic="lang"):
    return C.clean_corpus(S.documents(spark, sf_dir, topic=topic))


@query
def clean_text(spark, sf_dir):
    """X5 on documents: tags and non-letters removed, words longer than 3 letters."""
    d = S.read(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean_text("text").alias("clean"))


@query
def clean_html(spark, sf_dir):
    """X5 on raw web pages."""
    p = S.read(spark, sf_dir, "pages")
    return p.select("page_id", T.clean_text("html").alias("clean"))


@query
def json_extract(spark, sf_dir):
    """P5: a field of a JSON string column, parsed with a declared schema."""
    e = S.read(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k INT").getField("k").alias("k"))


@query
def topic_rank(spark, sf_dir):
    """A7 + T2: documents per topic (topic := source) and the topics' rank."""
    return C.topic_rank(_corpus(spark, sf_dir, "source"))


@query
def corpus_topn(spark, sf_dir):
    """M1 (T3, F3, J7, M2): corpora of the top 5/10/15/20 topics with labels and split."""
    return C.topic_corpora(_corpus(spark, sf_dir, "source"))


@query
def corpus_topic_ids(spark, sf_dir):
    """M1 + J7: the corpora with label ids from a topic table instead of the rank."""
    corpora = C.topic_corpora(_corpus(spark, sf_dir, "source"), topic_ids=S.topic_ids(spark, sf_dir))
    return corpora.select("topic_n", "doc_id", "topic", "label", "split")


@query
def corpus_round_trip(spark, sf_dir):
    """The ranked corpus written once, the test split of the top 5 topics read back."""
    path = scratch_dir(spark, "corpus")
    SK.write_corpora(C.ranked_corpus(_corpus(spark, sf_dir, "source")), path)
    return SK.read_corpus(spark, path, "test", 5).select("doc_id", "topic", "label", "split", "text")


@query
def train_test_split(spark, sf_dir):
    """M2: deterministic 80/20 split of the documents by a hash of doc_id."""
    return C.train_test_split(_corpus(spark, sf_dir)).select("doc_id", "split")


def _tfidf(corpus):
    return TF.tfidf(corpus, TF.MAX_FEATURES, T.default_stop_words())


@query
def tfidf(spark, sf_dir):
    """TF-IDF of every document (20,000-term vocabulary, stop words removed)."""
    return rounded(_tfidf(_corpus(spark, sf_dir)), "tfidf")


@query
def chi2_topk(spark, sf_dir):
    """The 10,000 terms with the highest chi-square against the language label."""
    corpus = materialize(_corpus(spark, sf_dir))
    scores = TF.chi2_scores(_tfidf(corpus), corpus.select("doc_id", F.col("topic").alias("label")))
    return TF.chi2_top_k(scores, TF.SELECT_K)


def _term_weights(spark, sf_dir):
    """Vectoriser, chi-square selection and naive Bayes weights fitted on the
    training split, as the reference's pipeline is."""
    # The cleaned training corpus feeds the features and the labels: clean once.
    train = materialize(C.train_test_split(_corpus(spark, sf_dir)).filter(F.col("split") == "train"))
    labels = train.select("doc_id", F.col("topic").alias("label"))
    feats = _tfidf(train)
    selected = TF.chi2_top_k(TF.chi2_scores(feats, labels), TF.SELECT_K)
    # at most SELECT_K rows
    feats = feats.join(F.broadcast(selected.select("term")), "term", "left_semi")
    n_features = selected.select(F.count(F.lit(1))).scalar()
    return I.nb_term_weights(feats, labels, I.ALPHA, n_features=n_features)


def _top_terms(spark, sf_dir):
    return I.top_terms(_term_weights(spark, sf_dir), I.TOP_TERMS)


@query
def top_terms(spark, sf_dir):
    """M6: the 25 heaviest naive Bayes terms of each language."""
    return rounded(_top_terms(spark, sf_dir), "weight")


@query
def top_terms_fitted(spark, sf_dir):
    """M6: the 25 heaviest terms of each language, read from the fitted pipeline."""
    corpora = C.topic_corpora(_corpus(spark, sf_dir), (20,)).filter(F.col("split") == "train")
    train = materialize(corpora.select("doc_id", "text", "topic", F.col("label").cast("double").alias("label")))
    model = ML.build_pipeline("MNB", params={"alpha": I.ALPHA}).fit(train)
    names = train.select(F.col("label").cast("int").alias("number"), F.col("topic").alias("name")).distinct()
    weights = I.fitted_term_weights(spark, model).join(names, F.col("label") == F.col("number")).select(
        F.col("name").alias("label"), "term", F.round("weight", 12).alias("weight"))
    return rounded(I.top_terms(weights, I.TOP_TERMS), "weight")


@query
def lemma_weights(spark, sf_dir):
    """M7: keyword weights of each language merged by a lemma table."""
    top = _top_terms(spark, sf_dir)
    return I.lemma_weights(top, S.stem_table(top), I.TOP_TERMS)


@query
def detached_lemma_weights(spark, sf_dir):
    """M7: keyword weights of each language merged by noun suffixes that the selected terms
    show to be such; the lemmas of all terms, the weights of the heaviest."""
    weights = materialize(_term_weights(spark, sf_dir))
    top = I.top_terms(weights, I.TOP_TERMS)
    return I.lemma_weights(top, I.detached_lemmas(top, weights), I.TOP_TERMS)


@query
def term_lemmas(spark, sf_dir):
    """M7: the lemma of every selected term, by noun suffixes detached."""
    weights = materialize(_term_weights(spark, sf_dir))
    return I.detached_lemmas(weights, weights)


def _word_index(spark, sf_dir):
    # The cleaned corpus feeds the index (training split) and the sequences; the index feeds
    # the sequences and the embedding table.
    corpus = stored(C.train_test_split(_corpus(spark, sf_dir)), "corpus")
    index = stored(TF.word_index(corpus.filter(F.col("split") == "train"), TF.NUM_WORDS), "index")
    return corpus, index


@query
def token_sequences(spark, sf_dir):
    """Every document as word ids (index fitted on the training split)."""
    corpus, index = _word_index(spark, sf_dir)
    seq = TF.token_sequences(corpus, index)
    return seq.select("doc_id", F.size("seq").alias("n_ids"),
                      F.array_join("seq", ",").alias("seq"))


@query
def padded_sequences(spark, sf_dir):
    """The id sequences left-padded / cut to 500."""
    corpus, index = _word_index(spark, sf_dir)
    seq = TF.token_sequences(corpus, index)
    return seq.select("doc_id", F.array_join(TF.pad_sequences("seq"), ",").alias("padded"))


# The driver's embeddings have 64 dimensions.
EMBEDDING_DIM = 64


@query
def embedding_table(spark, sf_dir):
    """N5 + J8: word id -> vector (zeros for id 0 and words without a vector)."""
    corpus, index = _word_index(spark, sf_dir)
    # The table holds the index's words only: the vectors of others are not looked up.
    table = TF.embedding_table(index, S.word_vectors(spark, sf_dir, index), EMBEDDING_DIM)
    text = F.array_join(F.transform("vec", lambda x: F.format_string("%.6f", x.cast("double"))), ",")
    return table.select("id", "word", text.alias("vec"))


# --------------------------------------------------------------------------- #
# Metrics (A22-A26, A12, T8, A19)

@query
def confusion(spark, sf_dir):
    """A22 + A25: confusion cells of a rule predictor, with % of the true class."""
    return rounded(M.confusion(S.rule_predictions(spark, sf_dir)), "pct")


def _cells(spark, sf_dir):
    pred = S.rule_predictions(spark, sf_dir)
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query
def weighted_f1(spark, sf_dir):
    """Weighted F1 by true-class sizes and by predicted-class sizes."""
    cells = _cells(spark, sf_dir)
    by_label = M.weighted_f1(cells, weight_by="label").select(F.lit("label").alias("weight_by"), "f1")
    by_pred = M.weighted_f1(cells, weight_by="prediction").select(F.lit("prediction").alias("weight_by"), "f1")
    return rounded(by_label.unionByName(by_pred), "f1")


@query
def accuracy(spark, sf_dir):
    """Accuracy of a rule predictor."""
    return rounded(M.accuracy(_cells(spark, sf_dir)), "acc")


def _sweep(spark, sf_dir):
    return M.evaluate(S.rule_sweep_predictions(spark, sf_dir), ["task", "model"]) \
            .select("task", "model", "f1", "acc")


@query
def model_sweep(spark, sf_dir):
    """A26 + M8: f1 and accuracy of every (task, model) of a prediction table."""
    return rounded(_sweep(spark, sf_dir), "f1", "acc")


@query
def metric_pivot(spark, sf_dir):
    """The sweep's F1 as a task x model table."""
    models = [f"chars_gt_{m}" for m in S.RULE_THRESHOLDS]
    return rounded(M.metric_pivot(_sweep(spark, sf_dir), "task", "model", "f1", models), *models)


@query
def model_rank(spark, sf_dir):
    """Models ranked by F1 on the quality task."""
    return rounded(M.rank_models(_sweep(spark, sf_dir), {"task": "quality"}), "f1", "acc")


@query
def nan_median(spark, sf_dir):
    """Median event value per event type (NaN skipped), rounded half-even."""
    return Q.nan_median_int(S.rated_events(spark, sf_dir), ["event_type"], "value")


# --------------------------------------------------------------------------- #
# Models (M3-M5, M9, A26): fitted on the training split, scored on the test
# split.  No SQL oracle: the driver checks row counts.

def _labelled(spark, sf_dir, topic="lang", topic_n=20):
    """(doc_id, text, label DOUBLE, split) for the top ``topic_n`` topics.  The cleaned corpus
    is stored: the topics' ranks, the fits and the evaluation read it."""
    corpora = C.topic_corpora(stored(_corpus(spark, sf_dir, topic), "corpus"), (topic_n,))
    return corpora.select("doc_id", "text", F.col("label").cast("double").alias("label"), "split")


def _benchmark(spark, sf_dir, model_type, params=None):
    data = _labelled(spark, sf_dir)
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    if model_type == "SVC":
        params = {"n_rows": train.count(), **(params or {})}
    model = ML.build_pipeline(model_type, params=params).fit(train)
    return rounded(ML.evaluate(model, test, {"model": model_type, "task": "lang"}),
                   "f1", "f1_by_prediction", "acc")


@query
def nb_benchmark(spark, sf_dir):
    """M3a + M5: TF-IDF -> chi2 top-k -> multinomial naive Bayes, language labels."""
    return _benchmark(spark, sf_dir, "MNB")


@query
def svm_benchmark(spark, sf_dir):
    """M3b + M5: TF-IDF -> chi2 top-k -> one-vs-rest linear SVM."""
    return _benchmark(spark, sf_dir, "SVC")


@query
def ovo_benchmark(spark, sf_dir):
    """M3b + M5: TF-IDF -> chi2 top-k -> a linear SVM for each pair of classes, votes."""
    return _benchmark(spark, sf_dir, "OVO")


@query
def rf_benchmark(spark, sf_dir):
    """M3c + M5: TF-IDF -> chi2 top-k -> random forest (200 trees)."""
    return _benchmark(spark, sf_dir, "RFC")


@query
def etc_benchmark(spark, sf_dir):
    """M3d + M5: the extra-trees slot, as a random forest without bootstrap."""
    return _benchmark(spark, sf_dir, "ETC")


@query
def extra_trees_benchmark(spark, sf_dir):
    """M3d + M5: TF-IDF -> chi2 top-k -> extremely randomised trees (200, random cuts)."""
    data = _labelled(spark, sf_dir)
    text, rows = ML.TextPipeline(stages=ML.text_stages()).fit_rows(data.filter(F.col("split") == "train"))
    model = XT.fit(rows)
    scores = ML.evaluate(model, text.transform(data.filter(F.col("split") == "test")), {"model": "EXT", "task": "lang"})
    return rounded(scores, "f1", "f1_by_prediction", "acc")


@query
def cv_best(spark, sf_dir):
    """M4: 3-fold grid search of the naive Bayes smoothing, best model refit and scored."""
    data = _labelled(spark, sf_dir)
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    best, model, _ = ML.grid_search(train, "MNB", {"alpha": [0.01, 0.1, 1.0]})
    scores = ML.evaluate(model, test, {"model": "MNB", "task": "lang"})
    return rounded(scores.withColumn("best_alpha", F.lit(best["alpha"])), "f1", "f1_by_prediction", "acc")


@query
def mlp_benchmark(spark, sf_dir):
    """M9: mean word-embedding of each document -> multilayer perceptron (256, 256)."""
    corpus, index = _word_index(spark, sf_dir)
    # The table holds the index's words only: the vectors of others are not looked up.
    table = TF.embedding_table(index, S.word_vectors(spark, sf_dir, index), EMBEDDING_DIM)
    feats = ML.mean_sequence_vectors(TF.token_sequences(corpus, index), table, EMBEDDING_DIM)
    # Labels from the corpus that is cleaned already.
    labelled = C.topic_corpora(corpus, (20,)).select("doc_id", F.col("label").cast("double").alias("label"), "split")
    data = stored(feats.join(labelled, "doc_id"), "vectors")
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    n_classes = train.select(F.max("label")).first()[0]
    model = ML.mlp(EMBEDDING_DIM, int(n_classes) + 1).fit(train)
    return rounded(ML.evaluate(model, test, {"model": "MLP", "task": "lang"}),
                   "f1", "f1_by_prediction", "acc")


@query
def topic_sweep(spark, sf_dir):
    """A26 + M8: naive Bayes on the corpora of the top 5/10/15/20 topics (topic := source)."""
    # Cleaned and tokenised once; the four corpora are no copies of the texts.
    corpus = stored(ML.with_terms(_corpus(spark, sf_dir, "source")), "terms")
    data = C.topic_corpora(corpus, body=ML.TERMS).withColumn("label", F.col("label").cast("double"))
    parts = []
    for n in C.TOPIC_NS:
        sub = data.filter(F.col("topic_n") == n)
        model = ML.build_pipeline("MNB").fit(sub.filter(F.col("split") == "train"))
        parts.append(ML.evaluate(ML.of_terms(model), sub.filter(F.col("split") == "test"),
                                 {"topic_num": n, "model": "MNB"}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, "f1", "f1_by_prediction", "acc")


# --------------------------------------------------------------------------- #
# Sources

@query
def parse_events(spark, sf_dir):
    """S4 + S7 (P5, X1-X5): raw event JSON lines parsed into the typed event table."""
    raw = E.parse_lines(S.raw_event_lines(spark, sf_dir), "event")
    typed = E.typed_event(raw)
    return typed.select("event_id", "time", "rating", "rating_count", "group_id",
                        "venue_id", "event_time_stamp", "name", "description")


@query
def vector_median(spark, sf_dir):
    """A19 per row: the NaN-skipping median of each embedding vector, rounded half-even."""
    e = S.wide_vectors(spark, sf_dir)
    return e.select("vec_id", X.nan_median("embedding").alias("median_value"))


@query
def parse_groups(spark, sf_dir):
    """S3 + S7 + F1 + J6: raw group JSON lines parsed, topics from the category table
    (null for categories that it lacks)."""
    raw = E.parse_lines(S.raw_group_lines(spark, sf_dir), "group")
    g = E.typed_group(raw, L.category_topics(spark))
    return g.select("group_id", "name", "city", "timezone", "rating", "category", "topic",
                    F.array_join("tags", ",").alias("tags"), "description")


@query
def parse_venues(spark, sf_dir):
    """S5 + S7: raw venue JSON lines parsed into the typed venue table."""
    return E.typed_venue(E.parse_lines(S.raw_venue_lines(spark, sf_dir), "venue"))


@query
def parse_rsvps(spark, sf_dir):
    """S6 + S7: raw RSVP JSON lines parsed into the typed RSVP table."""
    return E.typed_rsvp(E.parse_lines(S.raw_rsvp_lines(spark, sf_dir), "rsvp"))


@query
def load_groups(spark, sf_dir):
    """S1 + S7: raw group lines written as files, scanned and typed by the loader."""
    base = scratch_dir(spark, "raw")
    S.raw_group_lines(spark, sf_dir).write.text(f"{base}/groups")
    g = E.load_entity(spark, base, "group", L.category_topics(spark))
    return g.select("group_id", "name", "city", "rating", "category", "topic")


@query
def rechunked_events(spark, sf_dir):
    """S8 + S1: raw event lines copied into gzip files of 200 lines, then loaded."""
    base = scratch_dir(spark, "raw")
    S.raw_event_lines(spark, sf_dir).write.text(f"{base}/lines")
    E.rechunk_lines(spark, f"{base}/lines", f"{base}/events")
    return E.load_entity(spark, base, "event").select("event_id", "time", "rating_count", "group_id")


@query
def rechunked_first_events(spark, sf_dir):
    """S8 + T10 + S1: the first 3,000 raw event lines in file order, copied into gzip files of
    200 lines, then loaded (the limit is the feature)."""
    base = scratch_dir(spark, "raw")
    S.raw_event_lines(spark, sf_dir).orderBy(F.get_json_object("value", "$.id").cast("long")).write.text(f"{base}/lines")
    E.rechunk_lines(spark, f"{base}/lines", f"{base}/events", max_num=3000)
    return E.load_entity(spark, base, "event").select("event_id", "time", "rating_count", "group_id")


@query
def metrics_round_trip(spark, sf_dir):
    """The sweep's scores written as CSV and read back."""
    path = scratch_dir(spark, "metrics")
    scores = _sweep(spark, sf_dir).select(F.lit(2).alias("topic_num"), F.concat_ws("/", "task", "model").alias("model"), "f1", "acc")
    SK.write_metrics(scores, path)
    return rounded(SK.read_metrics(spark, path), "f1", "acc")


@query
def ranked_models(spark, sf_dir):
    """T1 + T8: the sweep ordered for presentation, by task and falling F1."""
    return rounded(_sweep(spark, sf_dir), "f1", "acc").orderBy("task", F.desc("f1"), "model")

