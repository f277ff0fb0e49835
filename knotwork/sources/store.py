"""Graphs, names and documents at rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..operators import graph as G

EDGE_SCHEMA = "src_type short, src_name string, dst_type short, dst_name string, mass10 long"
NAME_SCHEMA = "type short, name string, plain_name string, disambig_name string"

#: A document of any kind; what a kind lacks is null.
DOCUMENT = (
    "type string, eid string, lang string, title string, speaker string, canon string, book string, chapter int, year int, phase string, conference string, talk_id string, "
    "song_id string, number int, credits string, topic string, prev string, next string, date date, "
    "paragraphs array<struct<eid:string,t:string,c:int,r:array<struct<eid:string,start:int,end:int>>>>"
)
HEADER = "type string, eid string, lang string"


def save_graph(graph: DataFrame, path: str, partitions: int | None = None) -> None:
    """Edges by type of their source; within a file by source, so that a look-up reads few row groups."""
    _save(_by_source(graph, partitions), path)


def save_sum(graphs: list[DataFrame], path: str, partitions: int | None = None) -> None:
    """The same for the sum of graphs (graph.merge), whose edges are dealt by their source once, summed and sorted there."""
    edges = reduce(DataFrame.unionByName, [g.select(*G.EDGE, "mass10") for g in graphs])
    _save(_by_source(edges, partitions).groupBy(*G.EDGE).agg(F.sum("mass10").alias("mass10")), path)


def _by_source(graph: DataFrame, partitions: int | None) -> DataFrame:
    return graph.repartition(partitions, *G.SRC) if partitions else graph.repartition(*G.SRC)


def _save(rows: DataFrame, path: str) -> None:
    rows.sortWithinPartitions("src_type", "src_name", F.desc("mass10"), "dst_type", "dst_name").write.mode("overwrite").partitionBy("src_type").parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE_SCHEMA).parquet(path).select(*G.EDGE, "mass10")


def save_names(names: DataFrame, path: str) -> None:
    names.select("type", "name", "plain_name", "disambig_name").write.mode("overwrite").parquet(path)


def load_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NAME_SCHEMA).parquet(path)


def save_documents(docs: DataFrame, path: str) -> None:
    """JSON lines by language and kind."""
    docs.withColumn("doc_type", F.col("type")).withColumn("language", F.col("lang")).write.mode("overwrite").partitionBy("language", "doc_type").option("compression", "gzip").json(path)


def load_documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Documents of all kinds, or of one, with one schema."""
    docs = spark.read.schema(DOCUMENT).option("recursiveFileLookup", "true").json(path)
    return docs.where(F.col("type") == kind) if kind else docs


def load_headers(spark: SparkSession, path: str) -> DataFrame:
    """Kind, id and language only; the rest isn't parsed."""
    return spark.read.schema(HEADER).option("recursiveFileLookup", "true").json(path)


def parse_documents(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Documents from a column of JSON."""
    return rows.select(F.from_json(json_col, DOCUMENT).alias("d")).select("d.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(eid, path): where each document lies."""
    return load_headers(spark, path).select("eid", F.input_file_name().alias("path"))


def find_document(docs: DataFrame, kind: int, name: str) -> DataFrame:
    """The document that an entity belongs to."""
    d = N.to_document(F.lit(kind).cast("short"), F.lit(name))
    return docs.where(F.col("eid") == N.to_text(d["type"], d["name"]))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_eid, pos, eid, type, name, text, class, regions)."""
    p = docs.select(F.col("eid").alias("doc_eid"), F.posexplode("paragraphs").alias("pos", "p"))
    n = N.from_text(F.col("p.eid"))
    return p.select("doc_eid", "pos", F.col("p.eid").alias("eid"), n["type"].alias("type"), n["name"].alias("name"), F.col("p.t").alias("text"), F.col("p.c").alias("class"), F.col("p.r").alias("regions"))


def known_talks(talks: DataFrame, known: DataFrame) -> DataFrame:
    """Talks (year, phase, talk) that the known ones (year, phase, talk) have, or whose conference they don't know."""
    k = known.select("year", "phase", F.lower("talk").alias("_t")).distinct().withColumn("_hit", F.lit(True))
    conferences = known.select("year", "phase").distinct().withColumn("_known", F.lit(True))
    t = talks.withColumn("_t", F.lower("talk")).join(k, ["year", "phase", "_t"], "left").join(F.broadcast(conferences), ["year", "phase"], "left")
    return t.where(F.col("_hit") | F.col("_known").isNull()).drop("_t", "_hit", "_known")
