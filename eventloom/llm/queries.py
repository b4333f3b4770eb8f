"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, line_dedup, mixing, pitman_yor, quality, secrets, token_counts, token_files
from .shared import shared_dir, word_count

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir), k=3, num=90, den=100)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), gaps=True)


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), BYTE_BPE)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


#: Block-level text of a page: what stands between tags.
PAGE_LINES = r"<[^>]*>"


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1))
    out = line_dedup.drop_boilerplate(pages, "page_id", host, F.regexp_replace("html", PAGE_LINES, "\n"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


OP6 = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host,
         CASE WHEN html IS NULL OR html = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) END AS lines FROM pages),
own AS (SELECT page_id, host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM p),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
bad AS (SELECT o.host, o.line FROM own o JOIN totals t ON o.host = t.host GROUP BY o.host, o.line, t.pages HAVING count(*) >= 3 AND count(*) * 100 > t.pages * 30),
lists AS (SELECT host, list(line) AS bad FROM bad GROUP BY host),
kept AS (SELECT p.page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]), trim(x, ' ' || chr(9) || chr(13)))) AS kept FROM p LEFT JOIN lists USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS clean_sha256 FROM kept
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP7 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: Two tokenizer versions: words, and words with marks of punctuation apart.
PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches: all documents by words; those of odd number revised to the second version; every seventh deleted; the second
    batch sent again, which changes nothing; what was deleted put in again, under the first version. So all documents count."""
    docs = documents(spark, sf_dir)
    words = word_count(F.col("text"))
    pieces = F.coalesce(F.regexp_count("text", F.lit(PIECES)), F.lit(0)).cast("long")
    odd = docs.where("doc_id % 2 = 1")
    store = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{spark._jvm.java.util.UUID.randomUUID().toString()}")
    store.commit("1-load", token_counts.inserts(docs, words, "words-1"))
    revised = token_counts.revisions(odd, words, "words-1", pieces, "pieces-2")
    store.commit("2-revise", revised)
    gone = docs.where("doc_id % 7 = 0")
    store.commit("3-delete", token_counts.deletes(gone.where("doc_id % 2 = 0"), words, "words-1").unionByName(token_counts.deletes(gone.where("doc_id % 2 = 1"), pieces, "pieces-2")))
    store.commit("2-revise", revised)
    store.compact()
    store.commit("4-again", token_counts.inserts(gone, words, "words-1"))
    return store.totals()


OP8 = r"""
WITH d AS (SELECT source, lang, CASE WHEN doc_id % 2 = 1 AND doc_id % 7 <> 0 THEN 'pieces-2' ELSE 'words-1' END AS tokenizer,
  coalesce(CASE WHEN doc_id % 2 = 1 AND doc_id % 7 <> 0 THEN len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END, 0) AS n
  FROM documents)
SELECT source, lang, tokenizer, count(*) AS docs, sum(n)::BIGINT AS tokens FROM d GROUP BY source, lang, tokenizer
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), WORD_BPE)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17/' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w, source_size * 3 AS cap FROM s),
b AS (SELECT *, cap / w AS r, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open, sum(source_size) OVER ()::BIGINT AS total FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source))),
l AS (SELECT (total - before) / open AS level FROM b WHERE r >= (total - before) / open ORDER BY r, before LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM b, l),
x AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken FROM x
"""

QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_secrets, op3_pitman_yor, op4_bpe, op5_mixing, op6_line_dedup, op7_exact_dedup, op8_token_counts, op9_token_files, op10_quality)}
ORACLE_SQL = {"op5_mixing": OP5, "op6_line_dedup": OP6, "op7_exact_dedup": OP7, "op8_token_counts": OP8}
