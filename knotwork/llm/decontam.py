"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Test items are short and documents long, so that the likeness of an item and a whole document says nothing.
Items are partitioned by their number of shingles, in powers of two.  A partition's one-permutation MinHash
signatures have as many bins as its largest items have shingles (the smallest hash of each bin that has
one), and a document is asked as a whole which values of a signature are among its shingles, however long it
is and wherever in it the item's parts are.  Containment of at least the threshold leaves so many of an
item's shingles missing at most; all signature values but so many must then be found, which is more than
none for items of any size.  Candidates are items with that many values found, so that none is lost, and
their containment is then computed from the words themselves.

The items are read on the driver in slices of bounded size (one slice, unless they have more than SLICE
characters); each slice is one pass over the documents, whose findings are written to the shared folder
before the next slice is read, so that neither the driver nor a task ever holds more than one.

Defined results: a null text has no words and never matches; an item of fewer than SHINGLE words is one
shingle of its whole sequence, a word-less item never matches; repeated items and documents are all
reported; only A-Z are lower-cased; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, rows_by_bytes, stage_folder, use_checkpoints
from .words import Words, runs, words

SHINGLE, CONTAINMENT = 5, 0.8
#: Characters of items in a slice.
SLICE = 32 << 20


@dataclass
class Item:
    id: int | None
    text: bytes
    length: int  # words of a shingle
    shingles: int  # different ones

    def shingle_set(self) -> set[bytes]:
        w = words([self.text])
        return {w.text(a, a + self.length) for a in range(len(w.start) - self.length + 1)}


@dataclass
class Partition:
    """Items of one shingle length whose numbers of shingles are at least `size` and less than twice that."""

    length: int
    size: int
    #: sorted signature values and the item of each; values that each item needs
    values: np.ndarray
    of: np.ndarray
    need: dict[int, int]


@dataclass
class Index:
    items: list[Item]
    partitions: list[Partition]
    #: by words of a shingle: all signature values, and a bit table of their first bits
    tables: dict[int, tuple[np.ndarray, np.ndarray]]


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin that has one; bins are a power of two."""
    h = np.unique(hashes)
    b = h >> np.uint64(65 - bins.bit_length())
    return h[np.concatenate(([True], b[1:] != b[:-1]))] if len(h) else h


def build(rows: list[tuple[int | None, str | None]], threshold: float = CONTAINMENT) -> Index:
    items: list[Item] = []
    dealt: dict[tuple[int, int], list[tuple[int, np.ndarray, int]]] = {}
    for i, text in rows:
        raw = (text or "").encode().lower()
        w = words([raw])
        if n := len(w.start):
            k = min(SHINGLE, n)
            h = np.unique(runs(w.hashes(), w.first, k)[0])
            size = 1 << (len(h).bit_length() - 1)
            missing, bins = len(h) - math.ceil(threshold * len(h) - 1e-9), 2 * size
            while len(s := signature(h, bins)) <= missing:
                bins *= 2  # hashes that lie unusually close
            dealt.setdefault((k, size), []).append((len(items), s, len(s) - missing))
            items.append(Item(i, raw, k, len(h)))
    partitions, tables = [], {}
    for (k, size), of in sorted(dealt.items()):
        v = np.concatenate([s for _, s, _ in of])
        order = np.argsort(v, kind="stable")
        partitions.append(Partition(k, size, v[order], np.repeat([n for n, _, _ in of], [len(s) for _, s, _ in of])[order], {n: need for n, _, need in of}))
    for k in {p.length for p in partitions}:
        every, table = np.unique(np.concatenate([p.values for p in partitions if p.length == k])), np.zeros(1 << 20, dtype=bool)
        table[every >> np.uint64(44)] = True
        tables[k] = every, table
    return Index(items, partitions, tables)


def _candidates(p: Partition, h: np.ndarray) -> list[int]:
    """Items of a partition of whose signatures enough values are among a document's shingle hashes (each once)."""
    lo, hi = np.searchsorted(p.values, h), np.searchsorted(p.values, h, side="right")
    lo, n = lo[hi > lo], (hi - lo)[hi > lo]
    items, same = np.unique(p.of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_counts=True)
    return [n for n, x in zip(items.tolist(), same.tolist(), strict=True) if x >= p.need[n]]


def search(index: Index, texts: list[str | None], threshold: float = CONTAINMENT) -> list[list[tuple[int | None, int, int]]]:
    """For each text the items found: (id, shared shingles, shingles); the threshold is that of the index or more."""
    w: Words = words([(t or "").encode().lower() for t in texts])
    out: list[list[tuple[int | None, int, int]]] = [[] for _ in texts]
    hashes = w.hashes()
    for k, (every, table) in index.tables.items():
        h, at = runs(hashes, w.first, k)
        bounds = np.searchsorted(at, w.first)
        parts = [p for p in index.partitions if p.length == k]
        hits = np.flatnonzero(table[h >> np.uint64(44)])
        hits = hits[every[np.minimum(np.searchsorted(every, h[hits]), len(every) - 1)] == h[hits]]
        text = np.searchsorted(bounds, hits, side="right") - 1
        begins = np.flatnonzero(np.diff(text, prepend=-1))
        for d, own in zip(text[begins].tolist(), np.split(h[hits], begins[1:]), strict=len(begins) > 0):
            mine = np.unique(own)
            found = [n for p in parts for n in _candidates(p, mine)]
            if not found:
                continue
            have = {w.text(a, a + k) for a in at[bounds[d] : bounds[d + 1]].tolist()}
            for n in found:
                item = index.items[n]
                shared = len(item.shingle_set() & have)
                if shared >= threshold * item.shingles:
                    out[d].append((item.id, shared, item.shingles))
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = CONTAINMENT) -> DataFrame:
    """(id, item_id, shared, shingles, containment): each document with each test item it contains."""
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    slices = int(size // SLICE) + 1
    spark = docs.sparkSession
    schema = f"{id_col} long, {item_id} long, shared long, shingles long, containment double"
    items = items.select(item_id, item_text)
    if slices > 1:  # dealt by chance, as one item may be repeated very often
        use_checkpoints(spark)
        items = items.withColumn("_slice", F.floor(F.rand(1) * slices)).checkpoint()

    def part(k: int) -> tuple[DataFrame, Broadcast]:
        chosen = items.where(F.col("_slice") == k).drop("_slice") if slices > 1 else items
        index = spark.sparkContext.broadcast(build([tuple(r) for r in chosen.toLocalIterator()], threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in rows_by_bytes(batches, text_col):
                found = [(i, *x) for (i, _), xs in zip(rows, search(index.value, [t for _, t in rows], threshold), strict=True) for x in xs]
                yield arrow_batch({
                    id_col: ([x[0] for x in found], pa.int64()), item_id: ([x[1] for x in found], pa.int64()), "shared": ([x[2] for x in found], pa.int64()),
                    "shingles": ([x[3] for x in found], pa.int64()), "containment": ([round(x[2] / x[3], 6) for x in found], pa.float64()),
                })

        return docs.select(id_col, text_col).mapInArrow(run, schema), index

    if slices == 1:
        return part(0)[0]
    folder = stage_folder(spark, "contaminated")
    for k in range(slices):
        found, index = part(k)
        found.write.parquet(f"{folder}/slice={k}")
        index.destroy()
    return spark.read.schema(schema).parquet(*[f"{folder}/slice={k}" for k in range(slices)])
