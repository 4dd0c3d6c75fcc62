"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

the pre-registered views region, nation, customer, supplier, part, orders,
lineitem, events, documents, embeddings, pages, benchmark, labels, conversations.
"""
from __future__ import annotations

ORACLE: dict[str, str] = {}

# Stand-in roles (FIXTURES.md section 5) as common table expressions.
GROUPS = """
grp AS (
  SELECT c.c_custkey AS group_id, c.c_name AS name, n.n_name AS city,
         c.c_mktsegment || ' ' || CAST(c.c_custkey % 5 AS VARCHAR) AS topic,
         CASE n.n_regionkey WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
              WHEN 2 THEN 'America/Denver' WHEN 3 THEN 'America/Los_Angeles'
              WHEN 4 THEN 'UTC' END AS timezone
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

ETI = GROUPS + """,
eti0 AS (
  SELECT e.event_id, e.user_id AS group_id, e.ts AS time, g.city, g.topic, g.timezone,
         (e.ts AT TIME ZONE 'UTC') AT TIME ZONE g.timezone AS local_time
  FROM events e JOIN grp g ON e.user_id = g.group_id),
eti AS (
  SELECT *, CAST(year(local_time) AS INTEGER) AS year,
         CAST(isodow(local_time) - 1 AS INTEGER) AS weekday,
         CAST(hour(local_time) AS INTEGER) AS hour,
         CASE WHEN isodow(local_time) - 1 >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type
  FROM eti0)"""

US = "CASE WHEN grouping(city) = 1 THEN 'US' ELSE city END"


def _with(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body.strip()


ORACLE["event_time_info"] = _with(ETI, """
SELECT event_id, group_id, time, city, topic, timezone, local_time, year, weekday, hour FROM eti""")

ORACLE["occurrence_yearly"] = _with(ETI, f"""
SELECT {US} AS city, topic, year, count(*) AS n FROM eti
GROUP BY GROUPING SETS ((city, topic, year), (topic, year))""")

ORACLE["occurrence_daily"] = _with(ETI, f"""
SELECT {US} AS city, topic, weekday, count(*) AS n FROM eti
GROUP BY GROUPING SETS ((city, topic, weekday), (topic, weekday))""")

ORACLE["occurrence_hourly"] = _with(ETI, f"""
SELECT {US} AS city, topic, day_type, hour, count(*) AS n FROM eti
GROUP BY GROUPING SETS ((city, topic, day_type, hour), (topic, day_type, hour))""")

_DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
ORACLE["occurrence_daily_pivot"] = _with(ETI, f"""
SELECT {US} AS city, topic,
  {', '.join(f'count(*) FILTER (WHERE weekday = {i}) AS {d}' for i, d in enumerate(_DAYS))}
FROM eti GROUP BY GROUPING SETS ((city, topic), (topic))""")

ORACLE["occurrence_cube"] = _with(ETI, f"""
SELECT 'yearly' AS grain, {US} AS city, topic, year AS bucket, count(*) AS n FROM eti
GROUP BY GROUPING SETS ((city, topic, year), (topic, year))
UNION ALL
SELECT 'daily', {US}, topic, weekday, count(*) FROM eti
GROUP BY GROUPING SETS ((city, topic, weekday), (topic, weekday))
UNION ALL
SELECT 'hourly_' || day_type, {US}, topic, hour, count(*) FROM eti
GROUP BY GROUPING SETS ((city, topic, day_type, hour), (topic, day_type, hour))""")

ORACLE["topic_share_us"] = _with(ETI, """
SELECT topic, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM eti), 6) AS pct
FROM eti GROUP BY topic""")

CT = ETI + """,
ct AS (SELECT city, topic, count(*) AS n FROM eti GROUP BY city, topic),
share AS (SELECT city, topic, n, n * 100.0 / sum(n) OVER (PARTITION BY city) AS pct FROM ct)"""

ORACLE["topic_share_city"] = _with(CT, "SELECT city, topic, n, round(pct, 6) AS pct FROM share")

ORACLE["topic_lift"] = _with(CT, """
SELECT city, topic, n,
  round(n * (SELECT sum(n) FROM ct) * 100.0
        / (sum(n) OVER (PARTITION BY city) * sum(n) OVER (PARTITION BY topic)), 6) AS lift
FROM ct""")

ORACLE["top_topics_per_city"] = _with(CT, """
SELECT city, topic, n, round(pct, 6) AS pct, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY city ORDER BY pct DESC, topic) AS INTEGER) AS rank
  FROM share) WHERE rank <= 5""")

ORACLE["top_topics_us"] = _with(ETI, """
SELECT topic, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM eti), 6) AS pct
FROM eti GROUP BY topic ORDER BY pct DESC, topic LIMIT 10""")

ORACLE["daily_heat"] = _with(ETI + f""",
d AS (SELECT {US} AS city, topic, weekday, count(*) AS n FROM eti
      GROUP BY GROUPING SETS ((city, topic, weekday), (topic, weekday))),
t AS (SELECT city, topic, sum(n) AS total,
             sum(n) FILTER (WHERE weekday >= 5) * 1.0 / sum(n) AS weekend_prop
      FROM d GROUP BY city, topic),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY total DESC, topic) AS topic_rank
      FROM t),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY city ORDER BY weekend_prop, topic) AS INTEGER)
                  AS heat_order FROM r WHERE topic_rank <= 10),
days AS (SELECT CAST(i AS INTEGER) AS weekday,
                ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][i + 1] AS day FROM range(7) r(i))""", """
SELECT top.city, top.topic, days.weekday, days.day, coalesce(d.n, 0) AS n,
       round(coalesce(d.n, 0) * 100.0 / top.total, 6) AS pct,
       round(top.weekend_prop, 6) AS weekend_prop, top.heat_order
FROM top CROSS JOIN days
LEFT JOIN d ON d.city = top.city AND d.topic = top.topic AND d.weekday = days.weekday""")

ORACLE["event_scatter"] = _with(ETI, """
SELECT city, topic, event_id, year, weekday,
       ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][weekday + 1] AS day,
       round(hour(local_time) + minute(local_time) / 60.0, 6) AS time_of_day
FROM eti""")

KDE = ETI + f""",
h AS (SELECT {US} AS city, topic, day_type, hour, count(*) AS c FROM eti
      GROUP BY GROUPING SETS ((city, topic, day_type, hour), (topic, day_type, hour))),
s AS (SELECT city, topic, day_type, CAST(sum(c) AS DOUBLE) AS n,
             sum(c * hour) / CAST(sum(c) AS DOUBLE) AS mean
      FROM h GROUP BY city, topic, day_type),
v AS (SELECT s.city, s.topic, s.day_type, s.n,
             sum(h.c * pow(h.hour - s.mean, 2)) / (s.n - 1) AS var
      FROM h JOIN s USING (city, topic, day_type) GROUP BY s.city, s.topic, s.day_type, s.n, s.mean),
b AS (SELECT *, CASE WHEN n >= 2 AND var > 0 THEN pow(n * 0.75, -0.2) / 0.6 * sqrt(var) END AS bw
      FROM v),
g AS (SELECT CAST(i AS INTEGER) AS grid_i,
             CAST(6.0 AS DOUBLE) + i * (CAST(18.0 AS DOUBLE) / CAST(89.0 AS DOUBLE)) AS x
      FROM range(90) t(i)),
dens AS (
  SELECT b.city, b.topic, b.day_type, g.grid_i, g.x,
         sum(h.c * exp(-0.5 * pow((g.x - h.hour) / b.bw, 2))) / (b.n * b.bw * sqrt(2 * pi())) AS density
  FROM b JOIN h USING (city, topic, day_type) CROSS JOIN g
  GROUP BY b.city, b.topic, b.day_type, g.grid_i, g.x, b.n, b.bw)"""

ORACLE["hourly_density"] = _with(KDE, """
SELECT city, topic, day_type, grid_i, round(x, 6) AS x, round(density, 6) AS density FROM dens""")

ORACLE["best_hour"] = _with(KDE, """
SELECT city, topic, day_type, round(arg_max(x, density), 6) AS peak_x,
       round(max(density), 6) AS peak_density
FROM dens GROUP BY city, topic, day_type""")

# --------------------------------------------------------------------------- #
# Venues: the plan as the reference states it (join, count by point, join the
# point's smallest venue id, join group and venue attributes).

VENUES = GROUPS + r""",
v AS (SELECT p_partkey AS venue_id, p_name AS name,
             CAST(regexp_extract(p_brand, '(\d+)$', 1) AS DOUBLE) AS lat,
             CAST(p_size AS DOUBLE) / 1000 AS lon, p_retailprice AS rating FROM part),
canon AS (SELECT lat, lon, min(venue_id) AS loc_id FROM v GROUP BY lat, lon),
ev AS (SELECT o.o_custkey AS group_id, l.l_partkey AS venue_id
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
gl AS (SELECT ev.group_id, v.lat, v.lon, count(*) AS host_num
       FROM ev JOIN v ON ev.venue_id = v.venue_id GROUP BY ev.group_id, v.lat, v.lon),
gvi AS (SELECT canon.loc_id AS venue_id, gl.group_id, gl.lat, gl.lon, gl.host_num,
               g.topic, g.name AS "group", g.city, v.name AS venue, v.rating
        FROM gl JOIN canon ON gl.lat = canon.lat AND gl.lon = canon.lon
        JOIN grp g ON gl.group_id = g.group_id
        JOIN v ON v.venue_id = canon.loc_id),
freq AS (SELECT city, venue_id, group_id, lat, lon, topic, host_num FROM gvi WHERE host_num > 1),
cc AS (SELECT n_name AS city, CAST(11 + 10 * (n_nationkey // 5) + n_nationkey % 5 AS DOUBLE) AS lat,
              CAST(0.02 AS DOUBLE) AS lon FROM nation)"""

ORACLE["canonical_location"] = _with(VENUES, "SELECT lat, lon, loc_id FROM canon")

ORACLE["group_venue_info"] = _with(VENUES, "SELECT * FROM gvi")

ORACLE["group_venue_flag"] = _with(VENUES, """
SELECT *, CAST(host_num >= 2 AS INTEGER) AS host FROM gvi""")

ORACLE["frequent_venues"] = _with(VENUES, "SELECT * FROM freq")

ORACLE["venue_map"] = _with(VENUES + """,
m AS (SELECT f.*, 
        f.lon * (6378137.0 * pi() / 180.0) AS x,
        CASE WHEN f.lat > -90 AND f.lat < 90
             THEN ln(tan((f.lat + 90) * (pi() / 360.0))) * 6378137.0 END AS y,
        ln(f.host_num) * 3 AS size,
        CAST(c.lon AS DOUBLE) * (6378137.0 * pi() / 180.0) AS city_x,
        CASE WHEN c.lat > -90 AND c.lat < 90
             THEN ln(tan((CAST(c.lat AS DOUBLE) + 90) * (pi() / 360.0))) * 6378137.0 END AS city_y
      FROM freq f JOIN cc c ON f.city = c.city)""", """
SELECT city, venue_id, group_id, lat, lon, topic, host_num,
       round(x, 3) AS x, round(y, 3) AS y, round(size, 3) AS size,
       round(city_x, 3) AS city_x, round(city_y, 3) AS city_y,
       (x BETWEEN city_x - 10000.0 AND city_x + 10000.0)
         AND (y BETWEEN city_y - 10000.0 AND city_y + 10000.0) AS in_view
FROM m""")

# --------------------------------------------------------------------------- #
# Text, corpora and text features


def _clean(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL OR {col} = '' THEN NULL ELSE array_to_string("
            f"list_filter(string_split_regex(trim(lower(regexp_replace({col}, "
            f"'<[^<]+?>|[^a-zA-Z]', ' ', 'g'))), ' +'), lambda w: length(w) > 3), ' ') END")


def _split(col: str) -> str:
    return (f"CASE WHEN CAST(('0x' || substr(md5(CAST({col} AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)"
            f" % 100 < 20 THEN 'test' ELSE 'train' END")


def _stop_list() -> str:
    from gatherlens.functions.text import default_stop_words
    return ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words())


ORACLE["clean_text"] = f"SELECT doc_id, {_clean('text')} AS clean FROM documents"

ORACLE["clean_html"] = f"SELECT page_id, {_clean('html')} AS clean FROM pages"

ORACLE["json_extract"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"


def _corpus(topic: str) -> str:
    return f"""
corpus0 AS (SELECT doc_id, {topic} AS topic, {_clean('text')} AS text FROM documents),
corpus AS (SELECT *, {_split('doc_id')} AS split FROM corpus0 WHERE topic <> '' AND text <> '')"""


RANK = _corpus("source") + """,
tr AS (SELECT topic, count(*) AS n,
              CAST(row_number() OVER (ORDER BY count(*) DESC, topic) AS INTEGER) AS rank
       FROM corpus GROUP BY topic)"""

ORACLE["topic_rank"] = _with(RANK, "SELECT topic, n, rank FROM tr")

ORACLE["corpus_topn"] = _with(RANK + """,
ns AS (SELECT unnest([5, 10, 15, 20]) AS topic_n)""", """
SELECT ns.topic_n, c.doc_id, c.topic, CAST(tr.rank - 1 AS INTEGER) AS label, c.split, c.text
FROM corpus c JOIN tr ON c.topic = tr.topic JOIN ns ON tr.rank <= ns.topic_n""")

ORACLE["train_test_split"] = _with(_corpus("lang"), "SELECT doc_id, split FROM corpus")


def _tfidf(name: str, source: str) -> str:
    return f""",
{name}_tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) AS term
               FROM {source}),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM {name}_tok
              WHERE term NOT IN ({_stop_list()}) GROUP BY doc_id, term),
{name}_voc AS (SELECT term, sum(tf) AS freq, count(*) AS df FROM {name}_tf
               GROUP BY term ORDER BY freq DESC, term LIMIT 20000),
{name}_w AS (SELECT t.doc_id, t.term, t.tf,
                    t.tf * (ln((1 + (SELECT count(*) FROM {source})) / (1 + v.df)) + 1) AS w
             FROM {name}_tf t JOIN {name}_voc v USING (term)),
{name} AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf
           FROM {name}_w)"""


def _chi2(name: str, feats: str, labels: str) -> str:
    return f""",
{name}_pri AS (SELECT label, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {labels}) AS p
               FROM {labels} GROUP BY label),
{name}_obs AS (SELECT f.term, l.label, sum(f.tfidf) AS o
               FROM {feats} f JOIN {labels} l USING (doc_id) GROUP BY f.term, l.label),
{name}_sc AS (SELECT term, round(sum(o * o / p) / sum(o) - sum(o), 6) AS chi2
              FROM {name}_obs JOIN {name}_pri USING (label) GROUP BY term),
{name} AS (SELECT term, chi2, CAST(row_number() OVER (ORDER BY chi2 DESC, term) AS INTEGER) AS rank
           FROM {name}_sc QUALIFY rank <= 10000)"""


ORACLE["tfidf"] = _with(_corpus("lang") + _tfidf("tfidf", "corpus"), """
SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM tfidf""")

ORACLE["chi2_topk"] = _with(
    _corpus("lang") + _tfidf("tfidf", "corpus")
    + ",\nlab AS (SELECT doc_id, topic AS label FROM corpus)" + _chi2("chi", "tfidf", "lab"),
    "SELECT term, chi2, rank FROM chi")

TOP_TERMS = (_corpus("lang") + ",\ntrain AS (SELECT * FROM corpus WHERE split = 'train')"
             + _tfidf("feat", "train")
             + ",\nlab AS (SELECT doc_id, topic AS label FROM train)" + _chi2("chi", "feat", "lab")
             + """,
sel AS (SELECT f.* FROM feat f WHERE f.term IN (SELECT term FROM chi)),
nbo AS (SELECT l.label, s.term, sum(s.tfidf) AS o FROM sel s JOIN lab l USING (doc_id)
        GROUP BY l.label, s.term),
nbw AS (SELECT label, term,
               ln((o + 0.01) / (sum(o) OVER (PARTITION BY label)
                                + 0.01 * (SELECT count(DISTINCT term) FROM sel))) AS weight
        FROM nbo),
top AS (SELECT label, term, weight,
               CAST(row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS INTEGER) AS rank
        FROM nbw QUALIFY rank <= 25)""")

ORACLE["top_terms"] = _with(TOP_TERMS, "SELECT label, term, round(weight, 6) AS weight, rank FROM top")

ORACLE["lemma_weights"] = _with(TOP_TERMS, """
SELECT label, substr(term, 1, 3) AS lemma, 25 + min(25 - rank) AS weight FROM top
GROUP BY label, lemma""")

LEMMAS = TOP_TERMS + """,
rules AS (SELECT * FROM (VALUES ('s', ''), ('ses', 's'), ('ves', 'f'), ('xes', 'x'), ('zes', 'z'), ('ches', 'ch'),
                                ('shes', 'sh'), ('men', 'man'), ('ies', 'y')) AS r(ending, base)),
voc AS (SELECT DISTINCT term FROM nbw),
forms AS (SELECT term, left(term, length(term) - length(ending)) || base AS lemma FROM voc JOIN rules
          ON suffix(term, ending) AND length(term) > length(ending)),
short AS (SELECT term, lemma FROM forms WHERE lemma IN (SELECT term FROM voc)
          QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(lemma), lemma) = 1),
lemmas AS (SELECT term, coalesce(lemma, term) AS lemma FROM voc LEFT JOIN short USING (term))"""

ORACLE["term_lemmas"] = _with(LEMMAS, "SELECT term, lemma FROM lemmas")

ORACLE["detached_lemma_weights"] = _with(LEMMAS, """
SELECT label, lemma, 25 + min(25 - rank) AS weight FROM top JOIN lemmas USING (term)
GROUP BY label, lemma""")

SEQ = _corpus("lang") + """,
trw AS (SELECT unnest(string_split_regex(text, ' +')) AS word FROM corpus WHERE split = 'train'),
idx AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id, count(*) AS n
        FROM trw WHERE word <> '' GROUP BY word QUALIFY id < 20000),
ws AS (SELECT doc_id, string_split_regex(text, ' +') AS ws FROM corpus),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM ws),
sq AS (SELECT pos.doc_id, list(idx.id ORDER BY pos.p) AS seq FROM pos JOIN idx USING (word)
       GROUP BY pos.doc_id),
seqs AS (SELECT c.doc_id, coalesce(sq.seq, []) AS seq FROM corpus c LEFT JOIN sq USING (doc_id))"""

ORACLE["token_sequences"] = _with(SEQ, """
SELECT doc_id, CAST(len(seq) AS INTEGER) AS n_ids, array_to_string(seq, ',') AS seq FROM seqs""")

ORACLE["padded_sequences"] = _with(SEQ + """,
tl AS (SELECT doc_id, list_slice(seq, greatest(len(seq) - 500, 0) + 1,
                                 greatest(len(seq) - 500, 0) + 500) AS t FROM seqs)""", """
SELECT doc_id, array_to_string(list_concat([0 FOR x IN range(500 - len(t))], t), ',') AS padded
FROM tl""")

ORACLE["embedding_table"] = _with(SEQ + """,
vw AS (SELECT DISTINCT unnest(string_split_regex(text, ' +')) AS word FROM corpus),
vecs AS (SELECT vw.word, e.embedding AS vec FROM vw JOIN embeddings e
         ON e.vec_id = CAST(('0x' || substr(md5(vw.word), 1, 8)) AS BIGINT)
                       % (2 * (SELECT count(*) FROM embeddings))
         WHERE vw.word <> ''),
tab AS (SELECT 0 AS id, NULL AS word, NULL AS vec
        UNION ALL
        SELECT CAST(idx.id AS INTEGER), idx.word, vecs.vec FROM idx LEFT JOIN vecs USING (word))""", """
SELECT id, word,
       CASE WHEN vec IS NULL THEN array_to_string([printf('%.6f', 0.0::DOUBLE) FOR x IN range(64)], ',')
            ELSE array_to_string(list_transform(vec, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') END AS vec
FROM tab""")

# --------------------------------------------------------------------------- #
# Metrics

PRED = """
pred AS (SELECT d.doc_id, l.quality AS label, CAST(d.n_chars > 1000 AS INTEGER) AS prediction
         FROM documents d JOIN labels l USING (doc_id)),
cells AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY label, prediction)"""

ORACLE["confusion"] = _with(PRED, """
SELECT label, prediction, n, round(n * 100.0 / sum(n) OVER (PARTITION BY label), 6) AS pct FROM cells""")

F1 = PRED + """,
cls AS (SELECT label AS cls FROM cells UNION SELECT prediction FROM cells),
per AS (SELECT cls,
               sum(CASE WHEN label = cls THEN n ELSE 0 END) AS actual,
               sum(CASE WHEN prediction = cls THEN n ELSE 0 END) AS predicted,
               sum(CASE WHEN label = cls AND prediction = cls THEN n ELSE 0 END) AS tp
        FROM cls CROSS JOIN cells GROUP BY cls)"""

ORACLE["weighted_f1"] = _with(F1, """
SELECT 'label' AS weight_by, round(sum(2.0 * tp / (actual + predicted) * actual) / sum(actual), 6) AS f1
FROM per
UNION ALL
SELECT 'prediction', round(sum(2.0 * tp / (actual + predicted) * predicted) / sum(predicted), 6) FROM per""")

ORACLE["accuracy"] = _with(PRED, """
SELECT round(sum(CASE WHEN label = prediction THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS acc
FROM cells""")

_RULES = [(t, m) for t in ("quality", "toxic") for m in (500, 1000, 2000)]
SWEEP = ("""
sp AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{t}' AS task, 'chars_gt_{m}' AS model, d.doc_id, l.{t} AS label, "
    f"CAST(d.n_chars > {m} AS INTEGER) AS prediction FROM documents d JOIN labels l USING (doc_id)"
    for t, m in _RULES) + """),
sc AS (SELECT task, model, label, prediction, count(*) AS n FROM sp GROUP BY ALL),
scls AS (SELECT DISTINCT task, model, label AS cls FROM sc
         UNION SELECT DISTINCT task, model, prediction FROM sc),
sper AS (SELECT k.task, k.model, k.cls,
                sum(CASE WHEN c.label = k.cls THEN c.n ELSE 0 END) AS actual,
                sum(CASE WHEN c.prediction = k.cls THEN c.n ELSE 0 END) AS predicted,
                sum(CASE WHEN c.label = k.cls AND c.prediction = k.cls THEN c.n ELSE 0 END) AS tp
         FROM scls k JOIN sc c ON c.task = k.task AND c.model = k.model
         GROUP BY k.task, k.model, k.cls),
sf1 AS (SELECT task, model, sum(2.0 * tp / (actual + predicted) * actual) / sum(actual) AS f1
        FROM sper GROUP BY task, model),
sacc AS (SELECT task, model,
                sum(CASE WHEN label = prediction THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS acc
         FROM sc GROUP BY task, model),
sweep AS (SELECT task, model, f1, acc FROM sf1 JOIN sacc USING (task, model))""")

ORACLE["model_sweep"] = _with(SWEEP, "SELECT task, model, round(f1, 6) AS f1, round(acc, 6) AS acc FROM sweep")

ORACLE["metric_pivot"] = _with(SWEEP, "SELECT task, " + ", ".join(
    f"round(max(f1) FILTER (WHERE model = 'chars_gt_{m}'), 6) AS chars_gt_{m}" for m in (500, 1000, 2000))
    + " FROM sweep GROUP BY task")

ORACLE["model_rank"] = _with(SWEEP, """
SELECT task, model, round(f1, 6) AS f1, round(acc, 6) AS acc,
       CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank
FROM sweep WHERE task = 'quality'""")

ORACLE["nan_median"] = """
SELECT event_type,
       CAST(round_even(median(v) FILTER (WHERE NOT isnan(v)), 0) AS INTEGER) AS median_value
FROM (SELECT event_type, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 7 = 0 THEN CAST('nan' AS DOUBLE)
                              ELSE value END AS v FROM events)
GROUP BY event_type HAVING count(v) FILTER (WHERE NOT isnan(v)) > 0"""

# --------------------------------------------------------------------------- #
# Sources

ORACLE["parse_events"] = f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, date_trunc('second', ts) AS time,
       nullif(value, 0) AS rating,
       CAST(nullif(CAST(trunc(value) AS BIGINT), 0) AS INTEGER) AS rating_count,
       user_id AS group_id, CAST(NULL AS BIGINT) AS venue_id,
       CAST(epoch_us(ts) // 1000000 AS BIGINT) AS event_time_stamp,
       {_clean('event_type')} AS name, {_clean('props')} AS description
FROM events"""

_CITIES = ("NATION_0", "NATION_3", "NATION_6", "NATION_9", "NATION_12", "NATION_15", "NATION_18", "NATION_21")
ORACLE["topic_city_pivot"] = _with(CT, "SELECT topic, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE city = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in _CITIES)
    + f", CAST(coalesce(sum(n) FILTER (WHERE coalesce(city NOT IN {_CITIES}, true)), 0) AS BIGINT) AS other"
    + " FROM ct GROUP BY topic")

_ALL_CITIES = tuple(f"NATION_{i}" for i in range(25))
ORACLE["topic_all_cities_pivot"] = _with(CT, "SELECT topic, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE city = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in _ALL_CITIES)
    + f", CAST(coalesce(sum(n) FILTER (WHERE coalesce(city NOT IN {_ALL_CITIES}, true)), 0) AS BIGINT) AS other"
    + " FROM ct GROUP BY topic")

ORACLE["vector_median"] = """
SELECT vec_id,
       CAST(round_even(list_median([x * 1000 FOR x IN CAST(embedding AS DOUBLE[]) IF NOT isnan(x)]), 0)
            AS INTEGER) AS median_value
FROM embeddings"""

ORACLE["distinct_topics"] = _with(ETI, "SELECT DISTINCT topic FROM eti")


def _category_values() -> str:
    from gatherlens.sources.lookups import CATEGORY_TOPICS
    rows = ", ".join(f"({i}, '{t}')" for i, t in CATEGORY_TOPICS)
    return f"(VALUES {rows}) AS cat(category_id, topic)"


ORACLE["parse_groups"] = f"""
SELECT c.c_custkey AS group_id, {_clean('c.c_name')} AS name, n.n_name AS city,
       CASE n.n_regionkey WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
            WHEN 2 THEN 'America/Denver' WHEN 3 THEN 'America/Los_Angeles'
            WHEN 4 THEN 'UTC' END AS timezone,
       nullif(c.c_acctbal, 0) AS rating, c.c_nationkey AS category, cat.topic,
       c.c_mktsegment AS tags, {_clean('c.c_mktsegment')} AS description
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN {_category_values()} ON cat.category_id = c.c_nationkey"""

ORACLE["parse_venues"] = f"""
SELECT p_partkey AS venue_id, {_clean('p_name')} AS name, p_type AS city,
       CAST(NULL AS VARCHAR) AS state,
       nullif(CAST(p_size AS DOUBLE), 0) AS lat, nullif(CAST(-p_size AS DOUBLE), 0) AS lon,
       p_brand AS zip, nullif(p_retailprice, 0) AS rating,
       CAST(nullif(p_size, 0) AS INTEGER) AS rating_count, p_brand AS address
FROM part"""

ORACLE["parse_rsvps"] = """
SELECT o_orderkey AS rsvp_id,
       date_trunc('second', o_orderdate) AS created,
       to_timestamp(floor((epoch_us(o_orderdate) // 1000 + CAST(trunc(o_totalprice) AS BIGINT)) / 1000))::TIMESTAMP AS mtime,
       o_orderstatus AS response, o_custkey AS member_id, CAST(o_orderkey AS VARCHAR) AS event_id,
       CAST(NULL AS BIGINT) AS venue_id,
       CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS rsvp_create_stamp,
       CAST((epoch_us(o_orderdate) // 1000 + CAST(trunc(o_totalprice) AS BIGINT)) // 1000 AS BIGINT) AS rsvp_mtime_stamp,
       CAST(NULL AS BIGINT) AS group_id
FROM orders"""

# --------------------------------------------------------------------------- #
# Pivots, subsets and round trips through the sinks

ORACLE["occurrence_yearly_pivot"] = _with(ETI, f"""
SELECT {US} AS city, topic,
  {', '.join(f'count(*) FILTER (WHERE year = {y}) AS y{y}' for y in range(2010, 2031))},
  count(*) FILTER (WHERE year NOT BETWEEN 2010 AND 2030) AS other_years
FROM eti GROUP BY GROUPING SETS ((city, topic), (topic))""")

ORACLE["occurrence_hourly_pivot"] = _with(ETI, f"""
SELECT {US} AS city, topic, day_type,
  {', '.join(f'count(*) FILTER (WHERE hour = {h}) AS h{h}' for h in range(24))}
FROM eti GROUP BY GROUPING SETS ((city, topic, day_type), (topic, day_type))""")

ORACLE["occurrence_months"] = _with(ETI, """
SELECT year, CAST(month(local_time) AS INTEGER) AS month, count(*) AS n FROM eti
WHERE year BETWEEN 2015 AND 2024 GROUP BY ALL""")

ORACLE["occurrence_all_months"] = _with(ETI, """
SELECT year, CAST(month(local_time) AS INTEGER) AS month, count(*) AS n FROM eti GROUP BY ALL""")

ORACLE["occurrence_round_trip"] = _with(ETI, f"""
SELECT {US} AS city, topic, weekday AS bucket, count(*) AS n FROM eti
GROUP BY GROUPING SETS ((city, topic, weekday), (topic, weekday))""")

ORACLE["city_topic_round_trip"] = _with(ETI, """
SELECT event_id, city, topic, year, hour FROM eti
WHERE city = (SELECT min(city) FROM eti)
  AND topic = (SELECT min(topic) FROM eti WHERE city = (SELECT min(city) FROM eti))""")

ORACLE["city_topic_round_trip_whole"] = _with(ETI, "SELECT event_id, city, topic, year, hour FROM eti")

ORACLE["region_topic_share"] = _with(ETI + """,
sub AS (SELECT city, topic, count(*) AS n FROM eti
        WHERE city IN (SELECT n_name FROM nation WHERE n_regionkey = 2) GROUP BY city, topic)""", """
SELECT city, topic, n, round(n * 100.0 / sum(n) OVER (PARTITION BY city), 6) AS pct FROM sub""")

ORACLE["event_scatter_years"] = ORACLE["event_scatter"] + " WHERE year IN (2023, 2024)"

ORACLE["frequent_venues_cut"] = _with(VENUES, """
SELECT city, venue_id, group_id, lat, lon, topic, host_num FROM gvi WHERE host_num > 3""")

ORACLE["city_venues_round_trip"] = _with(VENUES, "SELECT * FROM freq WHERE city = (SELECT min(city) FROM freq)")

ORACLE["city_venues_round_trip_whole"] = _with(VENUES, "SELECT * FROM freq")

ORACLE["venue_map_topics"] = ORACLE["venue_map"] + " WHERE topic IN ('BUILDING 2', 'MACHINERY 0')"

ORACLE["corpus_topic_ids"] = _with(RANK + """,
ns AS (SELECT unnest([5, 10, 15, 20]) AS topic_n)""", r"""
SELECT ns.topic_n, c.doc_id, c.topic, CAST(regexp_extract(c.topic, '(\d+)$', 1) AS INTEGER) * 10 AS label, c.split
FROM corpus c JOIN tr ON c.topic = tr.topic JOIN ns ON tr.rank <= ns.topic_n""")

ORACLE["corpus_round_trip"] = _with(RANK, """
SELECT c.doc_id, c.topic, CAST(tr.rank - 1 AS INTEGER) AS label, c.split, c.text
FROM corpus c JOIN tr ON c.topic = tr.topic WHERE tr.rank <= 5 AND c.split = 'test'""")

ORACLE["load_groups"] = f"""
SELECT c.c_custkey AS group_id, {_clean('c.c_name')} AS name, n.n_name AS city, nullif(c.c_acctbal, 0) AS rating,
       c.c_nationkey AS category, cat.topic
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN {_category_values()} ON cat.category_id = c.c_nationkey"""

ORACLE["rechunked_events"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, date_trunc('second', ts) AS time,
       CAST(nullif(CAST(trunc(value) AS BIGINT), 0) AS INTEGER) AS rating_count, user_id AS group_id
FROM events"""

ORACLE["rechunked_first_events"] = ORACLE["rechunked_events"] + " QUALIFY row_number() OVER (ORDER BY event_id) <= 3000"

ORACLE["metrics_round_trip"] = _with(SWEEP, """
SELECT CAST(2 AS INTEGER) AS topic_num, task || '/' || model AS model, round(f1, 6) AS f1, round(acc, 6) AS acc FROM sweep""")

ORACLE["ranked_models"] = ORACLE["model_sweep"]
