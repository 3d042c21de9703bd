"""The registered queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from awardgrid.llm import decontamination, language, near_dedup, packing, quality_classifier, quality_rules, search, secrets, sharding, spelling, substring_dedup, toxicity, url_filter
from awardgrid.llm.common import parquet

#: The URL list that op6 screens against, made by a rule and not from the pages: on each of these hosts,
#: in each language, every third number below ``LISTED_BELOW``. Fixed values.
LISTED_HOSTS = ("blog.tionsh.example.com", "tionble.example.org", "www.tiontion.example.net", "ththan.example.com", "ththti.example.net", "spam-farm.example.com", "thther.example.org", "blog.tiontion.example.com", "www.ththhe.example.com", "blog.theres.example.com", "ththed.example.org", "www.cheap-pills.example.com")
LISTED_LANGS = ("en", "de", "fr", "es")
LISTED_BELOW = 10_000


TOKENIZER = "word_bpe_49k.json"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, parquet(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(spark, parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, parquet(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, parquet(spark, sf_dir, "documents"), with_spans=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(spark, parquet(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parquet(spark, sf_dir, "pages")
    listed = spark.range(0, LISTED_BELOW, 3).select(
        F.explode(F.array(*[F.lit(f"https://{host}/{lang}/") for host in LISTED_HOSTS for lang in LISTED_LANGS])).alias("at"), "id"
    ).select(F.concat("at", F.col("id").cast("string")).alias("url"))
    return url_filter.filter_urls(spark, pages, listed).drop("maybe_listed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(spark, parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(spark, parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(spark, parquet(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(parquet(spark, sf_dir, "documents"), with_redacted=False)


def slip(doc_id: Column, word: Column) -> Column:
    """The word, without one letter if 31 divides the unsigned crc32 of ``<doc_id>:<word>``; the crc32 says which."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word).cast("long")).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spark, parquet(spark, sf_dir, "documents"), edit=slip)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(spark, parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"), k=20)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(spark, parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language": op9_language,
    "op10_secrets": op10_secrets,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_toxicity": op13_toxicity,
}

ORACLES = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) = 1 THEN ws
                      ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2),
link AS (SELECT u, v FROM common WHERE 100 * i >= 80 * (na + nb - i)),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT link.v, reach.root FROM reach JOIN link ON reach.node = link.u)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(reach.root) AS component_id, s.doc_id = min(reach.root) AS kept
FROM s JOIN reach ON reach.node = s.doc_id GROUP BY s.doc_id, len(s.sh)""",
    "op6_url_filter": rf"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
k AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html)?/*$', '') END AS key,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u),
l AS (SELECT regexp_replace(h.host, '^www\.', '') || '/' || g.lang || '/' || n.id AS key
      FROM unnest([{", ".join(f"'{h}'" for h in LISTED_HOSTS)}]) h(host), unnest([{", ".join(f"'{x}'" for x in LISTED_LANGS)}]) g(lang), range(0, {LISTED_BELOW}, 3) n(id))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(key IN (SELECT key FROM l), FALSE) AS listed
FROM k""",
    "op11_spelling_variants": r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(CAST([i, 1, 2, 3, 4, 5, 6, 7, 8] AS UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(r AS UBIGINT) AS i FROM range(256) x(r))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS UBIGINT))),
                                 lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS h
  FROM each, tab),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
dict AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM dict, unnest(range(1, length(word) + 1)) u(i)),
pair AS (
  SELECT a.word AS u, b.word AS v, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dict a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM dict a JOIN cut b ON a.word = b.rest),
near AS (SELECT u, count(*) AS n_near, first(v ORDER BY n DESC, v) AS best, max(n) AS best_n FROM pair GROUP BY 1),
told AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM dict LEFT JOIN near ON word = u),
chain AS (
  SELECT word, form AS reached, 1 AS step FROM told WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, told.form, step + 1 FROM chain JOIN told ON chain.reached = told.word WHERE told.form IS NOT NULL),
root AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY 1)
SELECT told.word, form, coalesce(root, told.word) AS root, n, n_near, form_n FROM told LEFT JOIN root ON told.word = root.word""",
    "op12_ranked_search": r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
size AS (SELECT doc_id, len(ts) AS n FROM low WHERE len(ts) > 0),
alls AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM low) GROUP BY 1, 2),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY 1),
scored AS (
  SELECT item_id, tf.doc_id, CAST(sum(times * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN size ON size.doc_id = tf.doc_id, alls GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
}
