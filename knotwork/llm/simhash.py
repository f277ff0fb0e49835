"""Near-duplicates by SimHash, with an inverted index over byte positions and count filtering.

Two fingerprints of 64 bits that differ in at most 3 bits agree in at least 5 of their 8 bytes.  The index
holds every different fingerprint once under 8 keys, each of three byte positions with their values: of
any five positions three lie in the same half of the fingerprint, so every pair to be found meets under a
key.  A key's task tallies the agreeing bytes of pairs and verifies those with 5 or more.  The tally is the
same for keys of every size: one with too many fingerprints is dealt by two further positions, of all pairs
of them, and what is still too large by three half-bytes more (of the six that are left, at least three
agree), under which there are 4096 fingerprints at most.  A key returns links of each fingerprint to the
smallest one of its group of linked ones, never all pairs.

Defined results: a null or word-less text has fingerprint zero and is linked like any other; a text of
one or two words has the fingerprint of its whole sequence; equal texts always share a component; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, rows_by_bytes, use_checkpoints
from .components import components

SHINGLE, SEED = 3, 42
#: Differing bits of a link, and the bytes that must then agree.
BITS, AGREE = 3, 5
#: The positions of each key: all threes within each half of the fingerprint.
KEYS = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints of a key that a task tallies as they are; more are dealt by finer keys within the task.
PAIRWISE = 2048
#: Fingerprints of a key that one task gets; more are dealt to several.
SPLIT = 50_000
_POP = np.array([bin(k).count("1") for k in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text, as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, text_col):
            fps = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64).view(np.int64)
            yield arrow_batch({id_col: ([i for i, _ in rows], pa.int64()), "fp": (fps, pa.int64())})

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, fp long")


class _Groups:
    """Union-find over positions of an array; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self) -> np.ndarray:
        while (nxt := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = nxt
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.root()
            x, y = up[a], up[b]
            m = x != y
            a, b, x, y = a[m], b[m], x[m], y[m]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _popcount(x: np.ndarray) -> np.ndarray:
    return sum(_POP[(x >> np.uint64(s) & np.uint64(0xFFFF)).astype(np.int64)] for s in (0, 16, 32, 48))


def _agreeing(x: np.ndarray) -> np.ndarray:
    """How many bytes are zero in each of the differences."""
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)


def _finer(k: int, j: int = -1) -> list[list[tuple[int, int]]]:
    """What a key is dealt by, each a list of bit fields (shift, width): pairs of its other byte positions, or threes of the six half-bytes left by these."""
    others = [p for p in range(8) if p not in KEYS[k]]
    pairs = list(combinations(others, AGREE - len(KEYS[k])))
    if j < 0:
        return [[(8 * p, 8) for p in two] for two in pairs]
    halves = [8 * p + h for p in others if p not in pairs[j] for h in (0, 4)]
    return [[(s, 4) for s in three] for three in combinations(halves, len(halves) - BITS)]


def _tally(fp: np.ndarray, at: np.ndarray, k: int, j: int, i: int, groups: _Groups) -> None:
    """Link what is near among these fingerprints of a key."""
    if len(at) > 64 and (groups.up[at] == groups.up[at[0]]).all():
        return  # linked already
    if len(at) <= PAIRWISE or i >= 0:
        for lo in range(0, len(at), 256):
            d = fp[at[lo : lo + 256], None] ^ fp[None, at[lo:]]
            a, b = np.nonzero(_agreeing(d) >= AGREE)
            near = _popcount(d[a, b]) <= BITS
            groups.link(at[lo + a[near]], at[lo + b[near]])
        return
    for n, fields in enumerate(_finer(k, j)):
        code = _codes(fp[at], fields)
        order = np.argsort(code, kind="stable")
        for part in np.split(at[order], np.flatnonzero(np.diff(code[order])) + 1):
            if len(part) > 1:
                _tally(fp, part, k, *((n, -1) if j < 0 else (j, n)), groups)


def linked(fp: np.ndarray, k: int, j: int = -1, i: int = -1) -> np.ndarray:
    """For each of the different fingerprints of a key, the place of the smallest one of its group of linked ones."""
    groups = _Groups(len(fp))
    _tally(fp, np.arange(len(fp)), k, j, i, groups)
    return groups.root()


def _codes(fp: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    """These bits of each fingerprint as one number."""
    return sum((fp >> np.uint64(s) & np.uint64((1 << w) - 1)) << np.uint64(w * f) for f, (s, w) in enumerate(fields))


def _code(positions: tuple[int, ...]) -> Column:
    """The bytes of fp at these positions as one number."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255), 8 * n) for n, p in enumerate(positions)])


def _dealt_finer(rows: DataFrame) -> DataFrame:
    """(fp, k, j, i, v) of keys that are too large, under all their finer keys; v holds all bits that a key fixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, k, j, v = (batch.column(c).to_numpy() for c in ("fp", "k", "j", "v"))
            for kj in np.unique(k * 100 + j).tolist():
                k0, j0 = divmod(kj + 1, 100)
                j0 -= 1
                m = (k == k0) & (j == j0)
                for n, fields in enumerate(_finer(k0, j0)):
                    code = v[m] << sum(w for _, w in fields) | _codes(fp[m].view(np.uint64), fields).view(np.int64)
                    number = np.full(len(code), n, dtype=np.int32)
                    yield arrow_batch({"fp": (fp[m], pa.int64()), "k": (k[m], pa.int32()), "j": (number if j0 < 0 else j[m], pa.int32()), "i": (number if j0 >= 0 else number * 0 - 1, pa.int32()), "v": (code, pa.int64())})

    return rows.select("fp", "k", "j", "v").mapInArrow(run, "fp long, k int, j int, i int, v long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints (column fp), enough to connect whatever is connected."""
    use_checkpoints(fps.sparkSession)

    def near(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(rows["fp"].to_numpy().view(np.uint64))
        root = linked(fp, *key[:3])
        m = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[m].view(np.int64), "b": fp[root[m]].view(np.int64)})

    key, none = ["k", "j", "i", "v"], F.lit(-1)
    every = F.array(*[F.struct(F.lit(k).alias("k"), _code(ps).alias("v")) for k, ps in enumerate(KEYS)])
    index = fps.select("fp").distinct().select("fp", F.explode(every).alias("e")).select("fp", F.col("e.k").alias("k"), none.alias("j"), none.alias("i"), F.col("e.v").alias("v"))
    out: list[DataFrame] = []
    for level in range(3):
        if level == 2:
            out.append(index)  # 4096 fingerprints of a key at most
            break
        sizes = index.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").checkpoint()
        out.append(index.join(sizes.where(F.col("_n") <= SPLIT).drop("_n"), key))
        large = sizes.where(F.col("_n") > SPLIT).drop("_n")
        if large.isEmpty():
            break
        index = _dealt_finer(index.join(large, key)).checkpoint()
    return reduce(DataFrame.unionByName, out).groupBy(key).applyInPandas(near, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): 16 hexadecimal digits, and the smallest id reachable over links."""
    made = fingerprints(docs, id_col, text_col)
    use_checkpoints(docs.sparkSession)
    made = made.checkpoint()  # read several times
    first = made.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(first))
    known = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = known.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return made.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
