"""Words of many texts at once: bounds, hashes of words and of runs of words, and blocks of texts.

Words are `[^\\x20\\x09-\\x0D]+`.  A word's hash is XXH3 (128 bits, in two lanes of 64), computed once for each
different word of a block.  The hash of a run is joined from those of its halves, quarters and so on; every
join mixes all bits, and the lanes use different factors, so that no regular sequence of words (two words in
any pattern, say) makes two runs alike in a lane more often than chance, once in 2^64.  A block is a bounded
number of whole texts, packed into one binary value; it is what a task works on, asks others about, and gets
its answers for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_batch, rows_by_bytes

#: Characters of text in a block, and bytes that are hashed at once.
BLOCK, PIECE = 16 << 20, 1 << 20
_IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    got = _POWERS.get(factor)
    if got is None or len(got) < n:
        steps = np.full(max(n, PIECE + 1), factor, dtype=np.uint64)
        steps[0] = 1
        got = _POWERS[factor] = np.multiply.accumulate(steps)
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Spread what differs over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _join(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of what consists of two parts in this order."""
    return mix(a * np.uint64(_FACTORS[lane]) + b)


def run_hashes(hashes: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all n consecutive elements, by joining ever longer parts."""
    part, width, out, have = hashes, 1, None, 0
    while True:
        if n & width:
            out, have = part if out is None else _join(out[: len(part) - have], part[have:], lane), have + width
        if have == n:
            return out
        part, width = _join(part[:-width], part[width:], lane), 2 * width


class Parts:
    """Hashes of any short parts of a string of bytes: polynomials from prefix sums."""

    def __init__(self, data: bytes):
        values = _VALUES[np.frombuffer(data, dtype=np.uint8)]
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _powers(_FACTORS[0], len(values))[: len(values)], out=self.sums[1:])
        self.inverse = _powers(pow(_FACTORS[0], -1, 1 << 64), len(values) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


@dataclass
class Words:
    """Words of texts: bytes, where words begin and end, and the number of the first word of each text."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    #: number of each word among the different ones, and both lanes of these
    of: np.ndarray | None = None
    table: np.ndarray | None = None

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of each word."""
        if self.of is None:
            raw = np.frombuffer(self.data, dtype=np.uint8)
            ends = np.concatenate(([0], np.cumsum(self.end - self.start)))
            letters = pa.py_buffer(np.ascontiguousarray(raw[_IN_WORD[raw]]))  # the words without what lies between them
            known = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends.astype(np.int64)), letters]).dictionary_encode()
            self.of = known.indices.to_numpy()
            self.table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known.dictionary.to_pylist())), dtype=np.uint64).reshape(-1, 2)
        return self.table[self.of, lane]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by one space."""
        return b" ".join(self.data[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))


def words(texts: list[bytes]) -> Words:
    data = b"\n".join([*texts, b""]) if texts else b""
    inside = _IN_WORD[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, begins))


def runs(hashes: np.ndarray, first: np.ndarray, n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words of one text, and the number of the word each begins at."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    sizes = np.maximum(0, np.diff(first) - n + 1)
    at = np.repeat(first[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out = np.empty(len(at), dtype=np.uint64)
    for lo in range(0, len(at), PIECE):
        a = at[lo : lo + PIECE]
        out[lo : lo + PIECE] = run_hashes(hashes[int(a[0]) : int(a[-1]) + n], n, lane)[a - a[0]]
    return out, at


def pack_array(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack_array(b: bytes, dtype: str | type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=dtype)


def pack_texts(ids: list[int | None], texts: list[bytes]) -> bytes:
    head = np.array([len(ids), *(i or 0 for i in ids), *map(len, texts)], dtype=np.int64)
    return zstandard.compress(head.tobytes() + bytes(i is None for i in ids) + b"".join(texts), 1)


def unpack_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids (0 where null), which of them are null, and texts."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=2 * n + 1)
    null = np.frombuffer(raw, dtype=bool, count=n, offset=8 * (2 * n + 1))
    at = (8 * (2 * n + 1) + n + np.cumsum([0, *head[n + 1 :]])).tolist()
    return head[1 : n + 1], null, [raw[a:b] for a, b in zip(at, at[1:])]


def blocks(docs: DataFrame, partitions: int, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """(block, texts binary), dealt by block: whole texts of up to `size` characters (or one longer text); null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal made, held
            blob = pack_texts(ids, texts)
            made, held = made + 1, 0
            ids.clear(), texts.clear()
            return arrow_batch({"block": ([task << 32 | made], pa.int64()), "texts": ([blob], pa.binary())})

        for rows in rows_by_bytes(batches, text_col):
            for i, t in rows:
                raw = (t or "").encode()
                if texts and held + len(raw) > size:
                    yield out()
                ids.append(i)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield out()

    packed = docs.select(id_col, text_col).mapInArrow(run, "block long, texts binary")
    return packed.repartition(partitions, "block")
