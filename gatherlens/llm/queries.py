"""Registered queries of the training-data operators, over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from gatherlens.llm import (alignment, langid, licenses, mixing, ngram_join, pieces, quality, secret_scan, spelling,
                            substring_dedup, token_files, vafile, warc)


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    """Language of every document: text evidence and the prior of its source."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, "text", "lang")
    return langid.identify(docs, model, "doc_id", F.col("text"), host=F.col("source"))


def language_id_pages(spark, sf_dir):
    """Language of every page: visible text, declared markup language, host, suffix."""
    pages = _read(spark, sf_dir, "pages")
    model = langid.train(_read(spark, sf_dir, "documents"), "text", "lang")
    text = F.regexp_replace("html", r"(?is)<(script|style)\b[^<>]*>[^<]*|<[^<>]*>|&[a-z]+;", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?i)<html\b[^<>]*\blang=[\"']?([a-z]+)", 1), F.lit(""))
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return langid.identify(pages, model, "page_id", text, declared=declared, host=host,
                           suffix=F.substring_index(host, ".", -1))


def op2_quality_rules(spark, sf_dir):
    """Base rules and log-likelihood ratio; trusted target: half of those labelled quality 1,
    threshold from the other half."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    trusted, held_out = quality.held_out_half(quality.trusted_rows(labels, "doc_id", F.col("quality") == 1))
    return quality.judge(docs, trusted, held_out=held_out)


def op3_ngram_join(spark, sf_dir):
    """Components of documents whose 5-word shingle sets have a Jaccard of 0.8 or more."""
    return ngram_join.join_groups(_read(spark, sf_dir, "documents"))


def op3_ngram_links(spark, sf_dir):
    """op3_ngram_join and the number of links of every document, all links verified."""
    return ngram_join.join_groups(_read(spark, sf_dir, "documents"), n_links=True)


def op4_sentencepiece(spark, sf_dir):
    """Two sampled segmentations of every document, with the check that each decodes to
    the text."""
    return pieces.encode(_read(spark, sf_dir, "documents"), pieces.load())


def op5_secret_scan(spark, sf_dir):
    """Secrets of every document: counts and digests of the spans of the base rules,
    and the spans of all rules."""
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE]

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        line("spans").alias("spans"))


def op6_top_k(spark, sf_dir):
    """The 10 best inner products of every hundredth vector against all others."""
    return vafile.top_k(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("v_id") % 100 == 0)


def op7_warc(spark, sf_dir):
    """Pages written to WARC archives with revisits and read back."""
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("target_uri")


def op8_license_scan(spark, sf_dir):
    """License phrases and notices of every document."""
    return licenses.find(_read(spark, sf_dir, "documents")).drop("spans")


def op9_substring_dedup(spark, sf_dir):
    """Bytes of every document covered by a 400-byte string that starts elsewhere too, and
    what is left as text."""
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"),
                      F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(F.lit(0.0)).alias("removed_share"),
                      "text")


def op10_mix_sources(spark, sf_dir):
    """Every document repeated by its source's Poisson rate, shuffled globally."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizers' tokens for every document, and how frequent the
    linked id pairs are in all documents."""
    out = alignment.align(_read(spark, sf_dir, "documents"), groups="sha256")
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_spelling_variants(spark, sf_dir):
    """Frequent words of all documents, each with the spelling that it is a variant of."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_token_files(spark, sf_dir):
    """Token ids of all documents written in order to binary files, and read back."""
    return token_files.round_trip(_read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES = {f.__name__: f for f in (op1_language_id, language_id_pages, op2_quality_rules, op3_ngram_join, op3_ngram_links, op4_sentencepiece, op5_secret_scan, op6_top_k,
                                       op7_warc, op8_license_scan, op9_substring_dedup, op10_mix_sources,
                                       op11_token_alignment, op12_spelling_variants, op13_token_files,
                                       pipeline)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LLM_ORACLE = {
    "op3_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                       '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(sh) AS t FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT doc_id, list_sort(sh) AS sh FROM s),
c AS (SELECT doc_id, CASE WHEN len(sh) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY sh) END AS n_copies FROM k)
SELECT doc_id, n_shingles, component_id, n_copies FROM n JOIN m ON m.a = doc_id JOIN c USING (doc_id)""",
    "op6_top_k": """
WITH ok AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM pairs QUALIFY rank <= 10""",
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, md5(h[2 * p + 1:2 * p + 800]) AS m
      FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 - 399 AS BIGINT))) AS p FROM d WHERE len(h) >= 800)),
r AS (SELECT doc_id, p FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 400 THEN 0 ELSE 1 END AS new FROM r
      WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
x AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span, p FROM g),
y AS (SELECT doc_id, span, min(p) AS a, max(p) + 400 AS z FROM x GROUP BY doc_id, span),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM y),
t AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS last FROM k GROUP BY doc_id),
q AS (SELECT doc_id, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS parts FROM k JOIN d USING (doc_id) GROUP BY doc_id),
o AS (SELECT doc_id, h, a - CASE WHEN h[2 * a + 1:2 * a + 1] NOT IN ('8', '9', 'A', 'B') THEN 0
                              WHEN h[2 * a - 1:2 * a - 1] NOT IN ('8', '9', 'A', 'B') THEN 1
                              WHEN h[2 * a - 3:2 * a - 3] NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS a,
             z + CASE WHEN h[2 * z + 1:2 * z + 1] NOT IN ('8', '9', 'A', 'B') THEN 0
                      WHEN h[2 * z + 3:2 * z + 3] NOT IN ('8', '9', 'A', 'B') THEN 1
                      WHEN h[2 * z + 5:2 * z + 5] NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS z
      FROM k JOIN d USING (doc_id)),
l AS (SELECT doc_id, h, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) AS before FROM o),
u AS (SELECT doc_id, max(z) AS last, string_agg(CASE WHEN a > before THEN h[2 * before + 1:2 * a] ELSE '' END, '' ORDER BY a, z) AS parts
      FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(q.parts, '') || h[2 * coalesce(t.last, 0) + 1:])) AS kept_sha256,
       CAST(len(d.h) / 2 - coalesce(n_removed, 0) AS BIGINT) AS n_kept,
       CASE WHEN len(d.h) > 0 THEN coalesce(n_removed, 0) / (len(d.h) / 2) ELSE 0.0 END AS removed_share,
       decode(unhex(coalesce(u.parts, '') || h[2 * coalesce(u.last, 0) + 1:])) AS text
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN u USING (doc_id)""",
    "op12_spelling_variants": f"""
WITH RECURSIVE t AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, i:
                       CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab
           FROM (SELECT unnest(range(256)) AS n)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS h
      FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
c AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], [CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)
             FOR i IN range(CAST(len(h) / 2 AS BIGINT))]), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS crc FROM d, t),
w AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2)
             ELSE run END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k, 0 AS gone FROM p
      UNION SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1), 1 FROM p
      UNION SELECT word, n, word, 2 FROM v),
e AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM g a JOIN g b
      ON a.k = b.k AND a.word <> b.word AND ((a.gone = 0 AND b.gone = 0) OR a.gone + b.gone = 3)),
f AS (SELECT word, count(*) AS n_near, min(ROW(-near_n, near)) AS best FROM e GROUP BY word),
b AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n
      FROM v LEFT JOIN f USING (word)),
x AS (SELECT word, word AS root, 0 AS depth FROM b UNION ALL SELECT x.word, b.form, depth + 1 FROM x JOIN b ON b.word = x.root WHERE b.form IS NOT NULL),
z AS (SELECT word, arg_max(root, depth) AS root FROM x GROUP BY word)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM b JOIN z USING (word)""",
    "op10_mix_sources": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c) * pow(n, 0.7) / (SELECT sum(pow(n, 0.7)) FROM c) / n AS rate FROM c),
p AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER
             (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(0, 200)) AS k)),
t AS (SELECT source, any_value(rate) AS rate, list(cdf ORDER BY k) AS cdf FROM p GROUP BY source),
d AS (SELECT documents.*, rate, len(list_filter(cdf, lambda x: x <=
             CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
             / 4503599627370496.0)) AS n
      FROM documents JOIN t ON documents.source IS NOT DISTINCT FROM t.source),
e AS (SELECT * EXCLUDE (n, rate), rate AS mix_rate, CAST(unnest(range(0, n)) AS INTEGER) AS mix_copy FROM d)
SELECT *, CAST('0x' || substr(md5('7:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || mix_copy), 1, 13)
               AS BIGINT) / 4503599627370496.0 AS mix_order
FROM e""",
}
LLM_ORACLE["op3_ngram_links"] = LLM_ORACLE["op3_ngram_join"].replace(
    "component_id, n_copies FROM n", "component_id, n_copies, coalesce(n_links, 0) AS n_links FROM n") + """
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a) USING (doc_id)"""
