"""Spreading activation over the stored graph, for one scope of roots or several.

Activations of all scopes are one table keyed by the scope's mask.  They are spread in the same hops, compared in one join and
merged in one aggregate, so the number of jobs grows with the hops, not with the scopes.  A hop is one scan of the
buckets that have active nodes, one join and one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.activation import transfer
from ..plans import lattice
from ..plans.session import cut, new_folder, stored
from ..sources.edges import SRC, EdgeStore
from . import graph as G
from .features import Words

NODE = ["type", "name"]
#: Active nodes (of all scopes) that may be sent to every task, a name having 255 characters at most; more are joined by shuffle.
BROADCAST_NODES = 50_000


@dataclass
class Query:
    """Scopes of weighted roots, and three settings.

    Activation under min_activation is passed on no further; max_hops bounds the hops (activation halves with
    each, so that 16 are enough for the default); overlap multiplies what two scopes share.
    """

    min_activation: float = 1e-4
    max_hops: int = 16
    overlap: float = 4.0
    scopes: dict[int, dict[tuple[int, str], float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0 <= self.min_activation <= 1:
            raise ValueError("min_activation must be between 0 and 1")
        if self.overlap < 0:
            raise ValueError("overlap must not be negative")

    def add_root(self, kind: int, name: str, scope: int = 0, weight: float = 1.0) -> Query:
        """A root in a scope; the same root again adds to its weight."""
        if scope < 0:
            raise ValueError("scopes are numbered from 0")
        roots = self.scopes.setdefault(scope, {})
        roots[kind, name] = roots.get((kind, name), 0.0) + weight
        return self

    def roots(self, spark: SparkSession) -> DataFrame:
        """(scope, type, name, weight)."""
        rows = [(s, *n, w) for s, ns in sorted(self.scopes.items()) for n, w in ns.items()]
        return spark.createDataFrame(rows, "scope int, type short, name string, weight double")


def prepare(graph: DataFrame, buckets: int | None = None, kept: bool = False) -> EdgeStore:
    """The graph, stored once for all hops in the folder that the session's tasks share.  It is read twice, so it is kept in files before, unless it is already."""
    return EdgeStore.write(graph if kept else stored(graph.select(*G.EDGE, "mass10")), new_folder(graph.sparkSession, "edges"), buckets)


def prepare_words(words: Words) -> EdgeStore:
    """The same for the graph of entities and their words."""
    return words.stored(new_folder(words.docs.sparkSession, "edges"))


def hop(active: DataFrame, store: EdgeStore, min_activation: float, small: bool = True, buckets: list[int] | None = None) -> DataFrame:
    """(mask, type, name, v): what active nodes (mask, type, name, v) pass on; active ones without a mask count as one scope.

    A node passes over its edges from the heaviest on, up to and including the first one below the threshold.
    Since each edge knows the mass of the one before it, that is a filter: an edge is passed if the one before it is not below.
    No node's edges are sorted or held by one task, and the join may be dealt anew where a node has very many.
    """
    scoped = active if "mask" in active.columns else active.withColumn("mask", F.lit(1).cast("long"))
    live = scoped.where(F.col("v") >= min_activation).select("mask", F.col("type").alias("src_type"), F.col("name").alias("src_name"), "v")
    edges = store.edges if buckets is None else store.within(buckets)
    sent = edges.join(F.broadcast(live) if small else live, SRC)
    passed = F.col("before10").isNull() | (transfer(F.col("v"), F.col("before10"), F.col("total10"), F.col("num_edges")) >= min_activation)
    act = transfer(F.col("v"), F.col("mass10"), F.col("total10"), F.col("num_edges"))
    return sent.where(passed).groupBy("mask", F.col("dst_type").alias("type"), F.col("dst_name").alias("name")).agg(F.sum(act).alias("v"))


@dataclass(frozen=True)
class Unsummed:
    """A graph as its features (a_type, a_name, b_type, b_name, weight10), for spreading over it once.

    A hop sums only the edges of its active nodes: all features of a pair touch both its nodes, so these sums and their totals
    are those of the whole graph, of which nothing is shuffled or stored.  A graph that is read more often is stored by prepare().
    edges_of tells all edges of some nodes, as of_nodes() does, where that takes less than making all features."""

    features: DataFrame
    edges_of: Callable[[DataFrame, bool], DataFrame] | None = None

    @property
    def edges(self) -> DataFrame:
        return G.edges(self.features)

    def of_nodes(self, wanted: DataFrame, small: bool = True) -> DataFrame:
        """All edges of some nodes (src_type, src_name), which must be different."""
        if self.edges_of:
            return self.edges_of(wanted, small)
        end = lambda s, d: F.struct(*[F.col(f"{x}_{y}").alias(f"{z}_{y}") for x, z in ((s, "src"), (d, "dst")) for y in NODE])
        both = self.features.select(F.inline(F.array(end("a", "b"), end("b", "a"))), "weight10")
        return both.join(F.broadcast(wanted) if small else wanted, SRC).groupBy(*G.EDGE).agg(F.sum("weight10").alias("mass10"))

    def hop(self, active: DataFrame, min_activation: float, small: bool = True) -> DataFrame:
        """(mask, type, name, v): what active nodes (mask, type, name, v) pass on, as hop() tells it.

        An edge's activation grows with its mass, so a node passes its edges that are not below the threshold, and then the first of
        those that are: the heaviest, and of equal ones that to the smaller neighbour."""
        hint = F.broadcast if small else lambda d: d
        live = active.where(F.col("v") >= min_activation).select("mask", F.col("type").alias("src_type"), F.col("name").alias("src_name"), "v")
        found = stored(self.of_nodes(live.select(*SRC).distinct(), small))
        known = live.join(hint(found.groupBy(*SRC).agg(F.count("*").alias("num_edges"), F.sum("mass10").alias("total10"))), SRC)
        sent = found.join(hint(known), SRC).withColumn("act", transfer(F.col("v"), F.col("mass10"), F.col("total10"), F.col("num_edges")))
        under = sent.where(F.col("act") < min_activation)
        # names are compared among the heaviest only: sums and maxima of numbers are hashed, least names are sorted for
        most = under.groupBy("mask", *SRC).agg(F.max("mass10").alias("mass10"))
        below = under.join(hint(most), ["mask", *SRC, "mass10"]).groupBy("mask", *SRC).agg(F.min(F.struct("dst_type", "dst_name", "act")).alias("e"))
        passed = sent.where(F.col("act") >= min_activation).select("mask", "dst_type", "dst_name", "act").unionByName(below.select("mask", "e.dst_type", "e.dst_name", "e.act"))
        return passed.groupBy("mask", F.col("dst_type").alias("type"), F.col("dst_name").alias("name")).agg(F.sum("act").alias("v"))


def total(*parts: DataFrame) -> DataFrame:
    """The sum of activation maps, by mask if they have one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in ("mask", *NODE) if c in out.columns]).agg(F.sum("v").alias("v"))


def spread(start: DataFrame, store: EdgeStore | Unsummed, min_activation: float = 1e-4, max_hops: int = 16) -> DataFrame:
    """The start (mask, type, name, v) and all that it activates, summed over hops; each mask spreads by itself."""
    active = cut(start)
    parts = [active]
    for _ in range(max_hops):
        alive = active.where(F.col("v") >= min_activation)
        if isinstance(store, Unsummed):
            if not (n := alive.count()):
                break
            active = cut(store.hop(active, min_activation, n <= BROADCAST_NODES))
            parts.append(active)
            continue
        n, buckets = alive.agg(F.count("*"), F.collect_set(store.bucket(F.col("type"), F.col("name")))).first()
        if not n:
            break
        active = cut(hop(active, store, min_activation, n <= BROADCAST_NODES, buckets))
        parts.append(active)
    return cut(total(*parts))


#: Of a node's activation at most this share is passed on by all of its edges together: edges' x = mass * n / total are 1 on
#: average, and no mean of sigmoid((x - 1) / 2) over x >= 0 with that average exceeds it (its concave hull at 1).
MOST_PASSED = 0.501
#: Frontier classes of an octave of activation.
CLASSES = 8


@dataclass(frozen=True)
class BestFirst:
    """What was found, the edges that were read for it, and the most that is missing from it, over all nodes together (0: nothing)."""

    found: DataFrame
    edges: int
    bound: float


def best_first(start: DataFrame, store: EdgeStore, most_edges: int, min_activation: float = 1e-4, max_hops: int = 16) -> BestFirst:
    """Spreading of one scope that reads at most so many edges, from the nodes that can pass on most.

    Hops are as in spread().  The active nodes of a hop are dealt to classes by their activation, which bounds what they pass on; classes are
    taken from the highest on while their edges fit into the budget.  If some do not fit, they and later hops are left out,
    and what all of that could have brought is bounded: a hop passes on at most MOST_PASSED of what it gets."""
    active = cut(start.select(*NODE, "v"))
    parts, spent = [active], 0
    for k in range(max_hops):
        alive = active.where(F.col("v") >= min_activation)
        n, buckets = alive.agg(F.count("*"), F.collect_set(store.bucket(F.col("type"), F.col("name")))).first()
        if not n:
            break
        heads = store.within(buckets).where(F.col("before10").isNull()).select(F.col("src_type").alias("type"), F.col("src_name").alias("name"), "num_edges")
        sized = cut(alive.join(heads, NODE).withColumn("_class", F.floor(F.log2("v") * CLASSES)))
        # one row a class: eight for each doubling of activation
        classes = sorted(sized.groupBy("_class").agg(F.sum("num_edges").alias("n"), F.sum("v").alias("v")).collect(), key=lambda r: -r["_class"])
        taken, fits = [], most_edges - spent
        for r in classes:
            if r["n"] > fits:
                break
            taken.append(r)
            fits -= r["n"]
        spent = most_edges - fits
        if taken:
            first = sized.where(F.col("_class") >= taken[-1]["_class"]).select(*NODE, "v")
            active = cut(hop(first, store, min_activation, n <= BROADCAST_NODES, buckets).drop("mask"))
            parts.append(active)
        if len(taken) < len(classes):
            left, every = sum(r["v"] for r in classes[len(taken) :]), sum(r["v"] for r in classes)
            later = sum(MOST_PASSED ** (j + 1) for j in range(1, max_hops - k)) * every
            return BestFirst(cut(total(*parts)), spent, MOST_PASSED * left + later)
    return BestFirst(cut(total(*parts)), spent, 0.0)


def overlap(acts: DataFrame, pairs: list[lattice.Merge], factor: float) -> DataFrame:
    """(mask, type, name, v): what the two masks of each pair share, with `factor` times the sum of their activations."""
    named = acts.sparkSession.createDataFrame([(p.a, p.b, p.mask) for p in pairs], "a long, b long, union long")
    one = acts.select(F.col("mask").alias("a"), *NODE, F.col("v").alias("va")).join(F.broadcast(named), "a")
    both = one.join(acts.select(F.col("mask").alias("b"), *NODE, F.col("v").alias("vb")), ["b", *NODE])
    return both.select(F.col("union").alias("mask"), *NODE, (F.lit(factor) * (F.col("va") + F.col("vb"))).alias("v"))


class _Scopes:
    """The activations of all live masks as one table, and those that have been spread."""

    def __init__(self, query: Query, store: EdgeStore | Unsummed, roots: DataFrame):
        self.query, self.store, self.acts = query, store, roots
        self.found: list[DataFrame] = []
        self.shared: DataFrame | None = None

    def spread(self, masks: list[int]) -> None:
        here = F.col("mask").isin(masks)
        made = spread(self.acts.where(here), self.store, self.query.min_activation, self.query.max_hops)
        self.found.append(made)
        self.acts = self.acts.where(~here).unionByName(made)

    def share(self, pairs: list[lattice.Merge]) -> set[int]:
        self.shared = cut(overlap(self.acts, pairs, self.query.overlap))
        return {r.mask for r in self.shared.select("mask").distinct().collect()}  # at most one for each pair

    def merge(self, made: list[lattice.Merge], rest: list[int]) -> None:
        parts = [self.shared]
        if carried := [(m, p.mask) for p in made for m in p.carried]:
            moved = self.acts.sparkSession.createDataFrame(carried, "mask long, into long")
            parts.append(self.acts.join(F.broadcast(moved), "mask").select(F.col("into").alias("mask"), *NODE, "v"))
        self.acts = cut(total(*parts).unionByName(self.acts.where(F.col("mask").isin(rest))))


def run(query: Query, store: EdgeStore | Unsummed) -> DataFrame:
    """(type, name, score): all that the scopes and their overlaps activate, without the roots."""
    spark = store.edges.sparkSession
    roots = query.roots(spark)
    places = {s: 1 << k for k, s in enumerate(sorted(query.scopes))}
    mask = F.element_at(F.create_map(*[F.lit(x).cast("long") for s, m in places.items() for x in (s, m)]), F.col("scope").cast("long")) if places else F.lit(0).cast("long")
    scopes = _Scopes(query, store, roots.select(mask.alias("mask"), *NODE, F.col("weight").alias("v")))
    lattice.run(len(places), scopes.spread, scopes.share, scopes.merge)
    if not scopes.found:
        return roots.select(*NODE, F.col("weight").alias("score")).limit(0)
    found = total(*[f.select(*NODE, "v") for f in scopes.found])
    return found.join(roots.select(*NODE).distinct(), NODE, "left_anti").select(*NODE, F.col("v").alias("score"))


def ordered(results: DataFrame) -> DataFrame:
    """Highest score first; ties by node."""
    return results.orderBy(F.desc("score"), *NODE)
