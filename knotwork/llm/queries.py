"""The thin queries of this subpackage, by the names under which __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, flac, html_text, langid, licenses, lm, merkle, pipeline, secrets, simhash, substrings, toxicity, trie, twins
from .common import fold, table

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(0, 20) t(k)),
word AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_chars = substrings.characters(docs, "text")
    return lm.score(docs, lm.fit(docs, n_chars=n_chars), n_chars=n_chars)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"), secrets.train()).drop("redacted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.predict(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs, model).withColumn("held_out", fold("doc_id", 4) == 2)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x20\x09-\x0D]+') AS w FROM documents, lower),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x20\x09-\x0D]+') AS w FROM benchmark, lower),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (k, s) GROUP BY ALL),
size AS (SELECT item_id, count(*) AS shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, shared::BIGINT AS shared, shingles::BIGINT AS shingles, round(shared / shingles, 6) AS containment
FROM hit JOIN size USING (item_id) WHERE shared >= 0.8 * shingles
"""


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.tries(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html": op1_html, "op2_simhash": op2_simhash, "op3_lm": op3_lm, "op4_secrets": op4_secrets, "op5_toxicity": op5_toxicity, "op6_substrings": op6_substrings, "op7_flac": op7_flac, "op8_langid": op8_langid, "op9_bpe": op9_bpe, "op10_decontam": op10_decontam, "op11_merkle": op11_merkle, "op12_licenses": op12_licenses, "op13_trie": op13_trie, "pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_substrings": OP6_SQL, "op10_decontam": OP10_SQL, "op11_merkle": twins.merkle_sql(), "op12_licenses": twins.license_sql(), "op13_trie": twins.trie_sql()}
