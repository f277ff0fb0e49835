"""The weighted graph: features summed to edges in both directions, totals, pruning, increments.

Masses are whole tenths, so that sums and orders are exact.  Ties go to the smaller node.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most edges that a node keeps.
CAPACITY = 96
EDGE = ["src_type", "src_name", "dst_type", "dst_name"]
SRC = EDGE[:2]
PAIR = ["u_type", "u_name", "v_type", "v_name"]


def pairs(features: DataFrame) -> DataFrame:
    """(u_type, u_name, v_type, v_name, mass10): every pair of nodes summed once, under its smaller node."""
    c = F.col
    swap = (c("a_type") > c("b_type")) | ((c("a_type") == c("b_type")) & (c("a_name") > c("b_name")))
    either = lambda x, y, name: F.when(swap, c(y)).otherwise(c(x)).alias(name)
    rows = features.select(either("a_type", "b_type", "u_type"), either("a_name", "b_name", "u_name"), either("b_type", "a_type", "v_type"), either("b_name", "a_name", "v_name"), "weight10")
    return rows.groupBy(*PAIR).agg(F.sum("weight10").alias("mass10"))


def both(sums: DataFrame) -> DataFrame:
    """(src_type, src_name, dst_type, dst_name, mass10): pairs() turned to both directions, a node's pair with itself counting twice."""
    c = F.col
    own = (c("u_type") == c("v_type")) & (c("u_name") == c("v_name"))
    edge = lambda s, d, m: F.struct(c(f"{s}_type").alias("src_type"), c(f"{s}_name").alias("src_name"), c(f"{d}_type").alias("dst_type"), c(f"{d}_name").alias("dst_name"), m.alias("mass10"))
    return sums.select(F.inline(F.when(own, F.array(edge("u", "v", 2 * c("mass10")))).otherwise(F.array(edge("u", "v", c("mass10")), edge("v", "u", c("mass10"))))))


def edges(features: DataFrame) -> DataFrame:
    """(src_type, src_name, dst_type, dst_name, mass10): every feature counts in both directions, a node's pair with itself twice.

    Pairs are summed once, under their smaller node; only the sums are turned to both directions.  That is one
    shuffle of half the rows, after which every directed edge is already complete.
    """
    return both(pairs(features))


def merge(*graphs: DataFrame) -> DataFrame:
    """The sum of graphs; training is additive, so old and new edges give the graph of all features."""
    out = graphs[0].select(*EDGE, "mass10")
    for g in graphs[1:]:
        out = out.unionByName(g.select(*EDGE, "mass10"))
    return out.groupBy(*EDGE).agg(F.sum("mass10").alias("mass10"))


def nodes(graph: DataFrame) -> DataFrame:
    """(src_type, src_name, num_edges, total10)."""
    return graph.groupBy(*SRC).agg(F.count("*").alias("num_edges"), F.sum("mass10").alias("total10"))


def ranked(graph: DataFrame) -> DataFrame:
    """Edges with their rank at their node, heaviest first."""
    return graph.withColumn("rank", F.row_number().over(Window.partitionBy(*SRC).orderBy(F.desc("mass10"), "dst_type", "dst_name")))


def prune(graph: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The heaviest edges of each node."""
    return ranked(graph).where(F.col("rank") <= max(1, capacity)).drop("rank")


def prune_by_replay(features: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Edges as online training in the order of `seq` leaves them.

    A node's list grows up to its capacity; an increment of a new neighbour then first drops the lightest
    quarter.  A feature trains a->b before b->a.  A node's list depends on its own increments only, so each
    node is replayed by itself.  All increments of one node meet in one task: this mode is for checking and
    for small graphs; prune() is the one that scales.
    """
    c = F.col
    ends = F.array(
        F.struct((c("seq") * 2).alias("k"), c("a_type").alias("src_type"), c("a_name").alias("src_name"), c("b_type").alias("dst_type"), c("b_name").alias("dst_name")),
        F.struct((c("seq") * 2 + 1).alias("k"), c("b_type").alias("src_type"), c("b_name").alias("src_name"), c("a_type").alias("dst_type"), c("a_name").alias("dst_name")),
    )
    limit = max(4, capacity)

    def replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []  # [neighbour, mass], heaviest first, earlier ones first on ties
        for t, n, w in rows.sort_values("k")[["dst_type", "dst_name", "weight10"]].itertuples(index=False):
            at = next((i for i, (x, _) in enumerate(kept) if x == (t, n)), None)
            if at is None:
                if len(kept) >= limit:
                    del kept[len(kept) - max(1, len(kept) // 4) :]
                entry = [(t, n), w]
            else:
                entry = kept.pop(at)
                entry[1] += w
            k = next((i for i, (_, m) in enumerate(kept) if m < entry[1]), len(kept))
            kept.insert(k, entry)
        return pd.DataFrame([(*key, *x, m, i + 1) for i, (x, m) in enumerate(kept)], columns=[*EDGE, "mass10", "rank"])

    rows = features.select(F.explode(ends).alias("e"), "weight10").select("e.*", "weight10")
    return rows.groupBy(*SRC).applyInPandas(replay, "src_type short, src_name string, dst_type short, dst_name string, mass10 long, rank int")


def lookup(graph: DataFrame, kind: int, name: str) -> DataFrame:
    """The edges of one node, heaviest first."""
    return graph.where((F.col("src_type") == kind) & (F.col("src_name") == name)).orderBy(F.desc("mass10"), "dst_type", "dst_name")


def degree_percentiles(graph: DataFrame) -> DataFrame:
    """(pct, num_edges): exact percentiles 1 to 99 of the number of edges of a node."""
    pct = list(range(1, 100))
    found = nodes(graph).agg(F.percentile("num_edges", F.array(*[F.lit(p / 100) for p in pct])).alias("v"))
    return found.select(F.posexplode("v").alias("pct", "num_edges")).select((F.col("pct") + 1).cast("long").alias("pct"), "num_edges")
