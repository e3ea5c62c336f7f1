"""The subpackage's queries, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, hilbert, ngram_join, packing, quality, suffix_dedup, url_filter, vector_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.score(pages, url_filter.train_on(url_filter.labelled_pages(pages, _table(spark, sf_dir, "labels"))))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(_table(spark, sf_dir, "documents"))


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries, every row whose id is divisible by 20, against all rows."""
    return vector_file.top_k(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with its class and its number of links."""
    return ngram_join.near_classes(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train_on(docs, _table(spark, sf_dir, "labels")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_ids(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_url_filter, op2_suffix_dedup, op3_hilbert_sharding, op4_ngram_join, op5_packing, op6_chat_repair, op7_top_k, op8_bpe, op9_quality, op10_exact_dedup)
    return {f.__name__: f for f in found}


#: Words of a text as the n-gram join sees them.
_GRAMS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(lower(x), '[^\\pL\\pN]+', '', 'g')), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {ngram_join.N} + 1, 1) + 1), lambda i: array_to_string(w[i:i + {ngram_join.N} - 1], ' ')))) AS g
  FROM w WHERE len(w) > 0),
r AS (SELECT g, min(doc_id) AS doc_id, len(g) AS n, count(*) AS copies FROM g GROUP BY g),
p AS (SELECT doc_id, n, unnest(g) AS x FROM r),
o AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n AS na, b.n AS nb, count(*) AS c
  FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL)
"""

ORACLES = {
    "op7_top_k": f"""
WITH p AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id)::INT AS rank, neighbor_id, round(d, 6) AS distance
FROM p QUALIFY rank <= {vector_file.K}""",
    "op4_ngram_join": _GRAMS
    + f""",
l AS (SELECT doc_a, doc_b FROM o WHERE c / (na + nb - c) >= {ngram_join.THRESHOLD}),
e AS (SELECT doc_a AS a, doc_b AS b FROM l UNION ALL SELECT doc_b, doc_a FROM l),
c AS (SELECT a AS doc_id, a AS class_id FROM e UNION SELECT e.b, c.class_id FROM c JOIN e ON e.a = c.doc_id WHERE c.class_id < e.b),
k AS (SELECT doc_id, min(class_id) AS class_id FROM c GROUP BY doc_id),
m AS (SELECT a AS doc_id, sum(r.copies) AS n FROM e JOIN r ON r.doc_id = e.b GROUP BY a),
s AS (
  SELECT g.doc_id, coalesce(k.class_id, r.doc_id) AS class_id, coalesce(m.n, 0) + r.copies - 1 AS n
  FROM g JOIN r ON g.g = r.g LEFT JOIN k ON k.doc_id = r.doc_id LEFT JOIN m ON m.doc_id = r.doc_id)
SELECT d.doc_id, coalesce(s.class_id, d.doc_id) AS class_id, coalesce(s.n, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN s ON s.doc_id = d.doc_id""",
    "op2_suffix_dedup": f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(0, len(w) - {suffix_dedup.MIN_WORDS} + 1)) AS p FROM w),
h AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + {suffix_dedup.MIN_WORDS}], ' ')) AS h FROM s),
f AS (SELECT h, min((doc_id, p)) AS f FROM h GROUP BY h HAVING count(*) > 1),
d AS (SELECT doc_id, p, f[1] AS source FROM h JOIN f USING (h) WHERE (doc_id, p) <> f),
m AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {suffix_dedup.MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM d),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m)
SELECT doc_id, min(p)::INT AS begin_word, (max(p) + {suffix_dedup.MIN_WORDS})::INT AS end_word, arg_min(source, p) AS source_doc_id FROM n GROUP BY doc_id, k""",
    "op10_exact_dedup": "SELECT min(doc_id) AS doc_id, md5(text) AS content_hash FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
