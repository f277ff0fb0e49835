"""Merkle manifest of a dataset: one tree a source, a tree over the sources, proofs and their check.

Event-driven combine by key.  A node that is known is an event for its parent.  Events of a partition meet in partial
parents, which accumulate the digests of children by their index; how many children a parent will have follows from
the number of leaves of its tree (its arity).  A partial parent that has them all becomes a node, and so the next event,
up to the top if the partition holds that much.  What is left over, the frontier of each partition, is dealt anew by
blocks of ever more leaves (ARITY**2 times as many a round), until every tree has its top.  A round's block has at most
ARITY**2 unresolved nodes, whatever the size of a tree, so no task gathers a source.

Every node that is made leaves a reverse link: its own place and the digests of its run of children.  Proofs follow
these links from the top downwards, one join a level (each level has an ARITY-th of the rows of the next), and a leaf's proof is
joined to its run of ARITY leaves at the end.

Defined results: a null field is hashed as "-", so a null and a text "-" differ; null ids come first, equal ids are
ordered by leaf; a null source is a source of its own, before all others; repeated rows are leaves of their own; columns other than the
five are not read; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, stage_folder
from .ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a task of the climb holds before it hands them on.
OUT_ROWS = 1 << 14
MADE, WAITING, TOP = 0, 1, 2
_EVENT = "tree string, size long, level int, idx long, digest binary"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**replaced: Column) -> Column:
    """The digest of a row (32 bytes), some of whose fields may be replaced."""
    return F.unhex(F.sha2(F.concat(*[field(replaced.get(c, F.col(c))) for c in FIELDS]), 256))


def joined(digests: list[bytes]) -> bytes:
    """The digest of a run of digests, concatenated as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def width(size: int, level: int) -> int:
    """Nodes of a tree of `size` leaves at a level."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a partition, turned into nodes as far as their children are here.

    Yields nodes that were made (with the digests of their children), tops, and events that still wait for siblings."""
    partial: dict[tuple[str, int, int], dict[int, bytes]] = {}
    sizes: dict[tuple[str, int, int], int] = {}
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        names = ("kind", "tree", "size", "level", "idx", "digest", "run")
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        batch = arrow_batch({n: (list(c), t) for n, c, t in zip(names, columns, kinds, strict=True)})
        out.clear()
        return batch

    for batch in batches:
        for tree, size, level, idx, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n = width(size, level)
            while n > 1:
                key = (tree, level + 1, idx // ARITY)
                children = partial.setdefault(key, {})
                children[idx % ARITY] = digest
                if len(children) < min(ARITY, n - ARITY * key[2]):
                    sizes[key] = size
                    break
                run = [children[k] for k in sorted(children)]
                del partial[key]
                sizes.pop(key, None)
                digest, level, idx, n = joined(run), level + 1, key[2], -(-n // ARITY)
                out.append((MADE, tree, size, level, idx, digest, b"".join(run)))
            else:
                out.append((TOP, tree, size, level, idx, digest, None))
            if len(out) >= OUT_ROWS:
                yield flush()
    for (tree, level, parent), children in partial.items():
        for k, digest in children.items():
            out.append((WAITING, tree, sizes[tree, level, parent], level - 1, parent * ARITY + k, digest, None))
            if len(out) >= OUT_ROWS:
                yield flush()
    yield flush()


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Tops and made nodes of the trees of (tree, size, pos, digest), and the height of the tallest."""
    spark = leaves.sparkSession
    folder = stage_folder(spark, "merkle")
    schema = f"kind int, {_EVENT}, run binary"
    events = leaves.select("tree", "size", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest")
    rounds, block = 0, 1
    while True:
        events.mapInArrow(climb, schema).write.parquet(f"{folder}/round={rounds}")
        made = spark.read.parquet(f"{folder}/round={rounds}")
        waiting = made.where(F.col("kind") == WAITING)
        if waiting.isEmpty():
            break
        rounds, block = rounds + 1, block * ARITY**2
        first = F.col("idx") * F.pow(F.lit(ARITY), "level").cast("long")
        events = waiting.select("tree", "size", "level", "idx", "digest", first.alias("_first"))
        events = events.repartition("tree", F.floor(F.col("_first") / F.lit(block))).sortWithinPartitions("tree", "_first").select("tree", "size", "level", "idx", "digest")
    nodes = spark.read.schema(schema).parquet(*[f"{folder}/round={k}" for k in range(rounds + 1)])
    height = nodes.agg(F.max(F.when(F.col("kind") == TOP, F.col("level")))).first()[0] or 0
    return nodes.where(F.col("kind") == TOP).select("tree", "level", "digest"), nodes.where(F.col("kind") == MADE).select("tree", "level", "idx", "run"), height


def proofs(leaves: DataFrame, nodes: DataFrame, height: int, above: DataFrame) -> DataFrame:
    """The leaves with `path`, from the leaf's own run up to the root: array of (at, run).

    `above` has, by tree, the level of its top and the path from there to the root, and any columns that all of its leaves get."""
    rest = [c for c in above.columns if c not in ("tree", "top", "path")]
    # nodes of a level with their own run of children and the path from the node upwards
    paths = None
    for level in range(height, 0, -1):
        here = nodes.where(F.col("level") == level).select("tree", "idx", F.col("run").alias("_run"))
        tops = here.join(above.where(F.col("top") == level).drop("top"), "tree").select("tree", "idx", "_run", "path", *rest)
        paths = tops if paths is None else tops.unionByName(_below(here, paths, rest))
    single = leaves.where(F.col("size") == 1).join(above.where(F.col("top") == 0).drop("top"), "tree")
    if paths is None:
        return single
    return single.unionByName(_below(leaves.where(F.col("size") > 1).withColumnRenamed("pos", "idx"), paths, rest).withColumnRenamed("idx", "pos"))


def _below(rows: DataFrame, paths: DataFrame, rest: list[str]) -> DataFrame:
    """Rows with the path that begins with their own run, which their parent has."""
    parents = paths.select("tree", F.col("idx").alias("_parent"), F.col("_run").alias("_theirs"), "path", *rest)
    found = rows.withColumn("_parent", F.floor(F.col("idx") / F.lit(ARITY))).join(parents, ["tree", "_parent"])
    step = F.struct((F.col("idx") % ARITY).cast("int").alias("at"), F.col("_theirs").alias("run"))
    return found.withColumn("path", F.concat(F.array(step), "path")).drop("_parent", "_theirs")


def _split(step: Column) -> tuple[Column, Column]:
    """The digests of a run before and after the place of the path, as hex text."""
    text = F.lower(F.hex(step["run"]))
    return text.substr(F.lit(1), step["at"] * 64), text.substr(step["at"] * 64 + 65, F.length(text))


def proof_text(path: Column) -> Column:
    """All siblings along a path, as hex text."""
    return F.array_join(F.transform(path, lambda s: F.concat(*_split(s))), "")


def folded(digest: Column, path: Column) -> Column:
    """The root (hex text) to which a digest (hex text) leads along a path."""

    def step(d: Column, s: Column) -> Column:
        before, after = _split(s)
        return F.sha2(F.concat(before, d, after), 256)

    return F.aggregate(path, digest, step)


def manifest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, one of five tampered with."""
    tampered = F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, leaf_digest(text=F.translate("text", BIG, SMALL)))
    tree = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit(":"), "source"))  # in the order of sources, null first
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("_id"), leaf_digest().alias("digest"), tampered.alias("_other"))
    leaves = ranked(rows, ["tree"], ["_id", "digest"]).drop("part")
    tops, nodes, height = grow(leaves)
    # the tree over sources: its leaves are the tops of theirs
    over = ranked(tops.select(F.lit("all").alias("tree"), F.col("tree").alias("_source"), F.col("level").alias("top"), "digest"), ["tree"], ["_source"]).drop("part")
    root_top, over_nodes, over_height = grow(over)
    root = root_top.select("level", F.lower(F.hex("digest")).alias("root")).first()  # one row at most
    none = F.array().cast("array<struct<at:int,run:binary>>")
    end = root_top.select("tree", F.col("level").alias("top"), none.alias("path"))
    above = proofs(over, over_nodes, over_height, end).select(F.col("_source").alias("tree"), "top", "path", F.lower(F.hex("digest")).alias("subroot"))
    found = proofs(leaves, nodes, height, above)
    leaf, used = F.lower(F.hex("digest")), F.lower(F.hex(F.coalesce("_other", "digest")))
    out = found.select(F.col("_id").alias(id_col), leaf.alias("leaf"), "subroot", F.lit(root.root if root else None).cast("string").alias("root"), F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), folded(used, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
