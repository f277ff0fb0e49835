"""Edges at rest for look-ups and hops: buckets of nodes as folders, sorted row groups within.

An edge lies in the bucket of its source, so that what starts from few nodes reads few folders, and is sorted by
source within a file, so that a file's row groups are skipped by their least and greatest name.  The edges of a node with
very many are dealt to several files of its bucket.  With each edge goes what a hop needs to judge it by itself: its
source's number of edges and total mass, and the mass of the edge before it in the order in which the node passes on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import cut, dealt

SRC = ["src_type", "src_name"]
#: Edges of a node that one task orders and one file holds; nodes with more are dealt by their neighbours.
NODE_EDGES = 1 << 20
SCHEMA = "src_type short, src_name string, dst_type short, dst_name string, mass10 long, num_edges long, total10 long, before10 long, hub boolean, of int, bucket int"
COLUMNS = [*SRC, "dst_type", "dst_name", "mass10", "num_edges", "total10", "before10"]


def ordered_masses(hubs: DataFrame) -> DataFrame:
    """Edges of nodes with very many, with before10, without ordering a node's edges.

    Ties go to the smaller neighbour, so an edge's predecessor has its own mass but for the first edge of each mass.  Only the
    different masses of a node are ordered, whose number grows with the root of its total."""
    masses = hubs.groupBy(*SRC, "mass10").agg(F.min(F.struct("dst_type", "dst_name")).alias("_first"))
    masses = masses.withColumn("_heavier", F.lead("mass10").over(Window.partitionBy(*SRC).orderBy("mass10")))
    first = F.struct("dst_type", "dst_name") == F.col("_first")
    found = hubs.join(masses, [*SRC, "mass10"]).withColumn("before10", F.when(first, F.col("_heavier")).otherwise(F.col("mass10")))
    return found.drop("_first", "_heavier")


@dataclass(frozen=True)
class EdgeStore:
    """A stored graph: its edges with their `bucket`, a partition of the table, and how many buckets there are."""

    edges: DataFrame
    buckets: int

    @staticmethod
    def write(graph: DataFrame, path: str, buckets: int | None = None) -> EdgeStore:
        """Store a graph; by default with as many buckets as shuffle partitions, and 64 at least.

        The graph is read twice: nodes with very many edges are told first, of which there are few; then all edges are dealt once, and
        the other nodes' totals are found where their edges meet, in the order in which these are written."""
        n = buckets or most_buckets(graph.sparkSession)
        _write(graph, path, n)
        return EdgeStore.open(graph.sparkSession, path)

    @staticmethod
    def write_sides(one: DataFrame, path: str, buckets: int) -> EdgeStore:
        """Store a graph whose edges go between two kinds of nodes: `one` has those that start at one kind, with their `bucket`, each bucket's in one task.

        They are ordered and written where they are, and read again for the other kind's, so that only these are shuffled."""
        _put(_before(one.withColumn("_n", F.lit(None).cast("long")).withColumn("_t", F.lit(None).cast("long")), ["bucket"]), f"{path}/all", buckets)
        back = one.sparkSession.read.schema(SCHEMA).parquet(f"{path}/all")
        _write(back.select(F.col("dst_type").alias("src_type"), F.col("dst_name").alias("src_name"), F.col("src_type").alias("dst_type"), F.col("src_name").alias("dst_name"), "mass10"), path, buckets, "append")
        return EdgeStore.open(one.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> EdgeStore:
        table = spark.read.schema(SCHEMA).parquet(f"{path}/all")
        found = table.select("of").first()
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/hubs")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            table = table.where("NOT hub").unionByName(spark.read.schema(SCHEMA).parquet(f"{path}/hubs"))
        return EdgeStore(table.drop("of", "hub"), found["of"] if found else 1)

    def bucket(self, kind: Column, name: Column) -> Column:
        return bucket_of(kind, name, self.buckets)

    def within(self, buckets: list[int]) -> DataFrame:
        """The edges of some buckets; the others' folders aren't read."""
        return self.edges.where(F.col("bucket").isin(buckets)) if len(buckets) < self.buckets else self.edges

    def of_nodes(self, nodes: DataFrame) -> DataFrame:
        """The edges of few nodes (type, name): their buckets are told to the scan before it starts."""
        wanted = nodes.select(F.col("type").cast("short").alias("src_type"), F.col("name").alias("src_name")).distinct()
        found = wanted.agg(F.collect_set(self.bucket(F.col("src_type"), F.col("src_name")))).first()[0]
        return self.within(found).join(wanted, SRC, "left_semi")

    def lookup(self, kind: int, name: str) -> DataFrame:
        """The edges of one node, heaviest first."""
        here = self.bucket(F.lit(kind).cast("short"), F.lit(name))
        return self.edges.where((F.col("bucket") == here) & (F.col("src_type") == F.lit(kind).cast("short")) & (F.col("src_name") == name)).orderBy(F.desc("mass10"), "dst_type", "dst_name")


def most_buckets(spark: SparkSession) -> int:
    """As many as shuffle partitions, and 64 at least."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _before(rows: DataFrame, part: list[str]) -> DataFrame:
    """Edges, dealt by `part`, with num_edges, total10 and before10; those of hubs, which have them as _n and _t, without before10."""
    node = Window.partitionBy(*part, *SRC)
    lag = F.lag("mass10").over(node.orderBy(F.desc("mass10"), "dst_type", "dst_name"))
    rows = rows.withColumn("before10", F.when(F.col("_n").isNull(), lag))
    return rows.withColumn("num_edges", F.coalesce("_n", F.count("*").over(node))).withColumn("total10", F.coalesce("_t", F.sum("mass10").over(node)))


def _put(rows: DataFrame, path: str, n: int, mode: str = "error") -> None:
    rows.select(*COLUMNS, F.col("_n").isNotNull().alias("hub"), F.lit(n).alias("of"), "bucket").write.mode(mode).partitionBy("of", "bucket").parquet(path)


def _write(graph: DataFrame, path: str, n: int, mode: str = "error") -> None:
    spark, c = graph.sparkSession, F.col
    hubs = cut(graph.groupBy(*SRC).agg(F.count("*").alias("_n"), F.sum("mass10").alias("_t")).where(c("_n") > NODE_EDGES))
    rows = graph.select(*SRC, "dst_type", "dst_name", "mass10").join(F.broadcast(hubs), SRC, "left").withColumn("bucket", bucket_of(c("src_type"), c("src_name"), n))
    part = F.when(c("_n").isNotNull(), F.pmod(F.xxhash64("dst_type", "dst_name"), F.floor(c("_n") / F.lit(NODE_EDGES)) + 1)).otherwise(0).cast("int")
    # one shuffle and one sort for the totals, the order and the files: a node's edges of a part are together, as its bucket is
    _put(_before(dealt(rows.withColumn("part", part), "bucket", "part"), ["bucket", "part"]), f"{path}/all", n, mode)
    if not hubs.isEmpty():
        large = ordered_masses(spark.read.schema(SCHEMA).parquet(f"{path}/all").where("hub")).withColumn("_n", c("num_edges"))
        _put(large.repartition("bucket", F.pmod(F.xxhash64("dst_name"), F.lit(16))).sortWithinPartitions("bucket", *SRC), f"{path}/hubs", n)


def bucket_of(kind: Column, name: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(kind, name), F.lit(n).cast("long")).cast("int")
