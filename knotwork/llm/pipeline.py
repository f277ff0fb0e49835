"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.

* language ID: learns from three of four rows (as op8), and drops rows without a language (`und`: null
  texts and texts without a letter) or without a main one: mixtures no language of which has MAIN of the text, by
  the model's shares.  So the model decides what the later stages see.  The others keep their lang.
* near-dedup: keeps one row of each group of linked fingerprints, that with the smallest id (null ids last).
* decontamination: drops rows that contain a test item of the benchmark.
* secret scans: every finding is replaced by [SECRET]; n_chars follows.  No row is dropped.
* BPE: (doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

Rows go by all of their columns, not by doc_id: rows with a null doc_id, or with one that others have too, are judged by their own
text in every stage.  Of several rows with one doc_id near-dedup keeps one of each group; repeated rows are one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, secrets, simhash
from .common import fold, stage_folder, table

#: Least share of a text's main language.
MAIN = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    return langid.keep_known(docs.select(COLUMNS), model, MAIN)


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with two hashes of all of them and of which are null; rows that are the same in all of them, and no others, share both.

    One hash is the row's number where an operator wants one; it decides about a row only together with the other, or
    (in decontamination) where a wrong decision takes an equal hash of 64 bits."""
    what = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    return docs.select(*COLUMNS, F.xxhash64(*what).alias("_key"), F.xxhash64(F.lit("again"), *what).alias("_more"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs)
    members = simhash.groups(docs, "_key").select("_key", "component_id").distinct()
    known = members.join(docs.select("_key", "_more", "doc_id").distinct(), "_key")
    first = known.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "_more")).alias("first")).select("first._key", "first._more")
    return docs.join(first, ["_key", "_more"], "left_semi").dropDuplicates(["_key", "_more"]).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs)
    hits = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), "_key").select("_key").distinct()
    return docs.join(hits, "_key", "left_anti").select(COLUMNS)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs.select(COLUMNS), secrets.train()).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scans", scan_secrets),
    ("bpe", encode),
]

#: Models decide in the first and the fourth stage, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage_folder(spark, name)
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
