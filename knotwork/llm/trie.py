"""Prefix trie of conversations whose openings are shared, with counts, end lists and sums of its subtrees.

Conversations are rebuilt turn by turn; a node is named by its depth and a hash of its path (128 bits: the exclusive or, over
the path, of a hash of each turn with its depth, so that it is a prefix sum and a long conversation is cut into blocks
of turns).  Partial tries are node tables: every partition combines the members of its nodes (map-side), the
partial tables are merged by the hash of node and slot, and the slots of a node after that, so that a node shared by a third of all
conversations arrives as a few rows.  End lists are merged as sorted chunks of at most CHUNK members (chunks are ranges of
the rank of a conversation, so their size is bounded and their order is known), and a node's chunks stream through one hash.

The bottom-up rollup needs no round a level: a node belongs to its smallest member, and what a conversation owns is the lower
end of its path, since it is the smallest member of all nodes below one that it owns.  So sums run upwards along each conversation (again in
blocks), counting what it owns, and one more merge by node adds up the members' sums: every node of a subtree
counts once, by its owner.

Defined results: null role and text are empty; turns are ordered by `turn`, null first, equal ones by the SHA-256 of role and text; rows without a
conv_id belong to no conversation; repeated rows are turns of their own; a remainder has the sign of its conv_id;
other columns are not read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, stage_folder
from .ranks import ranked

#: Turns in a block of a conversation, members in a chunk of an end list, slots of a node's partial tables.
BLOCK, CHUNK, SLOTS = 4096, 1024, 32
#: Conversations that share an opening, and the longest opening that is shared.
FAMILY, OPENING = 5, 9
NODE = ["depth", "p1", "p2"]


def written(df: DataFrame, name: str) -> DataFrame:
    folder = stage_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, len, depth, turn_hash, bytes): all turns of every rebuilt conversation, and its root at depth 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").alias("_turn"), digest.alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes"))
    turns = ranked(turns, ["conv_id"], ["_turn", "turn_hash"]).select("conv_id", "pos", "size", "turn_hash", "bytes")
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING
    each = turns.where(F.col("pos") == 0).select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), opening.alias("h"))
    each = each.join(each.select(F.col("conv_id").alias("base"), F.col("size").alias("_base_size")), "base", "left")
    each = each.withColumn("k", F.least("h", F.coalesce("_base_size", F.lit(0)))).withColumn("len", F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    each = written(ranked(each.select("conv_id", "base", "h", "k", "len"), [], ["conv_id"]).select("conv_id", "base", "h", "k", "len", F.col("pos").alias("rank")), "conversations")
    keep = ["conv_id", "rank", "len", "depth", "turn_hash", "bytes"]
    head = turns.where(F.col("pos") < OPENING).select(F.col("conv_id").alias("base"), (F.col("pos") + 1).alias("depth"), "turn_hash", "bytes").join(each, "base").where(F.col("depth") <= F.col("h"))
    own = turns.drop("size").join(each.select("conv_id", "rank", "len", "h", "k"), "conv_id").where(F.col("pos") >= F.col("h")).withColumn("depth", F.col("pos") - F.col("h") + F.col("k") + 1)
    root = each.select("conv_id", "rank", "len", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(0).cast("long").alias("bytes"))
    return head.select(keep).unionByName(own.select(keep)).unionByName(root)


def scanned(rows: DataFrame, sums: dict[str, Column], upwards: bool = False) -> DataFrame:
    """Rows of (conv_id, len, depth, ...) with running aggregates along each conversation, this row included; upwards from its end.

    A conversation's blocks are summed on their own; only those of more than one block need what their other blocks hold."""
    down = F.col("depth").desc() if upwards else F.col("depth").asc()
    rows = rows.withColumn("_block", F.floor(F.col("depth") / F.lit(BLOCK)))
    here = Window.partitionBy("conv_id", "_block").orderBy(down).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.where(F.col("len") >= BLOCK).groupBy("conv_id", "_block").agg(*[f.alias(f"_t_{c}") for c, f in sums.items()])
    order = F.col("_block").desc() if upwards else F.col("_block").asc()
    before = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    again = {c: F.bit_xor(f"_t_{c}") if c in ("p1", "p2") else F.sum(f"_t_{c}") for c in sums}
    totals = totals.select("conv_id", "_block", *[f.over(before).alias(f"_before_{c}") for c, f in again.items()])
    out = rows.select("*", *[f.over(here).alias(f"_here_{c}") for c, f in sums.items()]).join(totals, ["conv_id", "_block"], "left")
    for c in sums:
        first = F.coalesce(f"_before_{c}", F.lit(0).cast("long"))
        out = out.withColumn(c, F.col(f"_here_{c}").bitwiseXOR(first) if c in ("p1", "p2") else F.col(f"_here_{c}") + first)
    return out.drop("_block", *[f"_here_{c}" for c in sums], *[f"_before_{c}" for c in sums])


def paths(turns: DataFrame) -> DataFrame:
    """Rebuilt turns with the hash of the path down to them (p1, p2) and to their parent (q1, q2)."""
    each = lambda seed: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("turn_hash", "depth", F.lit(seed)))
    rows = turns.withColumn("_x1", each(1)).withColumn("_x2", each(2)).drop("turn_hash")
    rows = scanned(rows, {"p1": F.bit_xor("_x1"), "p2": F.bit_xor("_x2")})
    return rows.withColumn("q1", F.col("p1").bitwiseXOR(F.col("_x1"))).withColumn("q2", F.col("p2").bitwiseXOR(F.col("_x2"))).drop("_x1", "_x2")


def merged(rows: DataFrame, key: list[str], member: str, **parts: tuple[Column, Column]) -> DataFrame:
    """A table of nodes from rows of members: combined in each partition, merged by node and slot, and then by node.

    parts: for each column what makes it of rows, and what merges partial ones."""
    slots = rows.groupBy(*key, F.pmod(F.xxhash64(member), F.lit(SLOTS)).alias("_slot")).agg(*[make.alias(c) for c, (make, _) in parts.items()])
    return slots.groupBy(*key).agg(*[merge.alias(c) for c, (_, merge) in parts.items()])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's chunks, joined by commas; they come in order, a node's after one another."""
    at, state, out = None, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        batch = arrow_batch({c: (list(v), t) for c, v, t in zip([*NODE, "ends_sha256"], columns, (pa.int64(),) * 3 + (pa.string(),), strict=True)})
        out.clear()
        return batch

    for batch in batches:
        for d, p, q, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (d, p, q):
                if state is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (d, p, q), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if len(out) > 1 << 14:
            yield flush()
    if state is not None:
        out.append((*at, state.hexdigest()))
    yield flush()


def end_lists(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    ends = members.where(F.col("depth") == F.col("len"))
    chunks = ends.groupBy(*NODE, F.floor(F.col("rank") / F.lit(CHUNK)).alias("_chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("_ids"))
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "_chunk").select(*NODE, "_ids").mapInArrow(_hash_chunks, "depth long, p1 long, p2 long, ends_sha256 string")


def tries(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    members = written(paths(rebuilt(conversations)), "paths")
    nodes = merged(
        members, NODE, "conv_id", n_convs=(F.count("*"), F.sum("n_convs")), conv_id=(F.min("conv_id"), F.min("conv_id")),
        bytes=(F.max("bytes"), F.max("bytes")), q1=(F.min("q1"), F.min("q1")), q2=(F.min("q2"), F.min("q2")),
    )
    nodes = written(nodes, "nodes")
    below = nodes.where(F.col("depth") > 0).select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "conv_id")
    children = merged(below, NODE, "conv_id", n_children=(F.count("*"), F.sum("n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    owned = nodes.join(parents, ["depth", "q1", "q2"], "left").join(children, NODE, "left")
    owned = owned.select("conv_id", "depth", "parent_conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("_saved"))
    rows = members.select("conv_id", "len", *NODE).join(owned, ["conv_id", "depth"], "left")
    leaf = F.when((F.col("depth") == F.col("len")) & (F.col("n_children") == 0), 1).otherwise(0).cast("long")
    rows = rows.withColumn("_leaf", leaf).withColumn("_saved", F.coalesce("_saved", F.lit(0)))
    rows = scanned(rows, {"n_leaves": F.sum("_leaf"), "saved_tokens": F.sum("_saved")}, upwards=True)
    twice = lambda f, c: (f(c), f(c))
    out = merged(
        rows, NODE, "conv_id", conv_id=twice(F.min, "conv_id"), parent_conv_id=twice(F.max, "parent_conv_id"), n_convs=(F.count("*"), F.sum("n_convs")),
        n_children=twice(F.max, "n_children"), n_leaves=twice(F.sum, "n_leaves"), saved_tokens=twice(F.sum, "saved_tokens"),
    )
    out = out.join(end_lists(members), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
