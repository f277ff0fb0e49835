"""Removal of repeated passages, exactly, behind a count-min prefilter.

Pass 1: every block of texts counts its windows of WINDOW words in a count-min sketch of ROWS rows of cells.
A block's sketch is sparse, so its cells are sent by slices of the rows; a slice of all blocks' sketches is
merged by one task, in a table of counts of bounded size, which answers every block with one bit per cell:
counted twice or more, or not.  A window whose cells were counted twice in all rows is estimated repeated; a
sketch never underestimates, so no repeated window is lost.  The rows' width follows the number of words of
the whole input (8 to 16 cells a word), as rows of a fixed width would fill up and hold nothing back.
Pass 2: of the windows estimated repeated, each block sends the 128-bit hash, id and position of the first one
of each kind; these are grouped exactly, and the task of each range tells every block which of its windows
come first of all.  Pass 3: every other window estimated repeated is covered, and its words are removed.

Slices and ranges hold millions of windows, so that messages between blocks and them are few; at most there
is one for each cell or window sent, whatever the size of the input.  Windows are sent once per block: a
passage that occurs in a third of all texts is one window of each block.

Defined results: a null text has no words; texts shorter than a window keep all words; a null id sorts
behind all others; of equal ids, the windows of one text are all kept or removed as their positions say;
other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, sha256
from .words import Words, blocks, mix, pack_array, runs, unpack_array, unpack_texts, words

WINDOW = 20
#: Rows of the sketch, and bits of a cell's number beyond those of the number of words.
ROWS, SPARE = 2, 3
#: Windows of a slice of a row and of a range of windows, and the least number of both.
SLICE, RANGE, LEAST = 8_000_000, 4_000_000, 16
#: Characters of a word and the space behind it, for sizing only.
LETTERS = 6


class _Plan:
    """How cells are dealt to slices, and windows to ranges."""

    def __init__(self, n_words: int, window: int):
        self.window = window
        self.bits = min(48, max(12, math.ceil(math.log2(n_words + 1)) + SPARE))
        self.slices = max(LEAST, math.ceil(n_words / SLICE))
        self.ranges = max(2 * LEAST, math.ceil(n_words / RANGE))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return (mix(h + np.uint64(row)) if row else h) >> np.uint64(64 - self.bits)

    def edges(self) -> np.ndarray:
        """The first cell of each slice, and the end."""
        return np.array([(k << self.bits) // self.slices for k in range(self.slices)] + [1 << self.bits], dtype=np.uint64)

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)


class _Block:
    """A block's texts with their windows."""

    def __init__(self, blob: bytes, plan: _Plan):
        self.ids, self.null, self.texts = unpack_texts(blob)
        self.words: Words = words(self.texts)
        self.plan = plan
        self.hash, self.at = runs(self.words.hashes(0), self.words.first, plan.window)

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One row of the block's sketch: cells, the cell of each window, counts, and where the slices begin."""
        cell, of, count = np.unique(self.plan.cells(self.hash, k), return_inverse=True, return_counts=True)
        return cell, of, count, np.searchsorted(cell, self.plan.edges())

    def sent_cells(self) -> Iterator[tuple[int, bytes]]:
        for r in range(ROWS):
            cell, _, count, bounds = self.row(r)
            for k in range(self.plan.slices):
                part = cell[bounds[k] : bounds[k + 1]]
                if len(part):
                    step = np.diff(part, prepend=np.uint64(0))
                    wide = step[1:].max(initial=0)
                    kind = "<u2" if wide < 1 << 16 else "<u4" if wide < 1 << 32 else "<u8"
                    twice = np.packbits(count[bounds[k] : bounds[k + 1]] > 1).tobytes()
                    head = np.array([len(part), int(kind[2]), part[0]], dtype="<u8").tobytes()
                    yield r * self.plan.slices + k, zstandard.compress(head + step[1:].astype(kind).tobytes() + twice, 1)

    def repeated(self, answers: dict[int, bytes]) -> None:
        """Keep, per kind of window estimated repeated, the first one of the block, in the order of texts."""
        likely = np.ones(len(self.hash), dtype=bool)
        for r in range(ROWS if len(likely) else 0):
            _, of, _, bounds = self.row(r)
            flags = [np.unpackbits(unpack_array(answers[r * self.plan.slices + k], np.uint8), count=int(n)) for k, n in enumerate(np.diff(bounds)) if n]
            likely &= np.concatenate(flags)[of].astype(bool)
        self.likely = np.flatnonzero(likely)
        h1, at = self.hash[self.likely], self.at[self.likely]
        h2 = runs(self.words.hashes(1), self.words.first, self.plan.window, 1)[0][self.likely]
        text = np.searchsorted(self.words.first, at, side="right") - 1
        doc, null, pos = self.ids[text], self.null[text], at - self.words.first[text]
        order = np.lexsort((pos, doc, null, h2, h1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        self.firsts = np.sort(order[new])  # places in likely
        f = self.firsts
        self.sent = {"h1": h1[f], "h2": h2[f], "null": null[f], "doc": doc[f], "pos": pos[f].astype(np.int32)}
        self.range_of = self.plan.range_of(h1[f])

    def sent_windows(self) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(self.range_of, kind="stable")
        bounds = np.searchsorted(self.range_of[order], np.arange(self.plan.ranges + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = order[bounds[k] : bounds[k + 1]]
            yield k, zstandard.compress(b"".join(self.sent[c][part].tobytes() for c in _SENT.names), 1)

    def covered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Whether each word of the block is removed."""
        kept = np.zeros(len(self.likely), dtype=bool)
        order = np.argsort(self.range_of, kind="stable")
        sizes = np.bincount(self.range_of, minlength=self.plan.ranges)
        if len(order):
            flags = np.concatenate([np.unpackbits(unpack_array(answers[k], np.uint8), count=int(n)) for k, n in enumerate(sizes) if n])
            kept[self.firsts[order[flags.astype(bool)]]] = True
        at = self.at[self.likely[~kept]]
        edge = np.zeros(len(self.words.start) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.plan.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _cells_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a slice that a block sent, and whether it counted them once (1) or more often (2)."""
    raw = zstandard.decompress(blob)
    n, width, low = np.frombuffer(raw, dtype="<u8", count=3).tolist()
    end = 24 + (n - 1) * width
    step = np.frombuffer(raw[24:end], dtype=f"<u{width}").astype(np.uint64)
    cells = np.cumsum(np.concatenate((np.array([low], dtype=np.uint64), step)), dtype=np.uint64)
    return cells, 1 + np.unpackbits(np.frombuffer(raw[end:], dtype=np.uint8), count=n)


def _merge_cells(plan: _Plan, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One slice of the merged sketch, and what it tells each block; counts beyond two are as good as two."""
    lo, hi = plan.edges()[key[0] % plan.slices :][:2].tolist()
    total, told = np.zeros(hi - lo, dtype=np.uint8), []
    for blob in rows["blob"]:
        cells, counts = _cells_of(blob)  # each once
        at = cells - np.uint64(lo)
        total[at] = np.minimum(2, total[at] + counts)
    for blob in rows["blob"]:
        told.append(pack_array(np.packbits(total[_cells_of(blob)[0] - np.uint64(lo)] > 1)))
    return pd.DataFrame({"block": rows["block"], "kind": 0, "range": key[0], "blob": told})


_SENT = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("null", "?"), ("doc", "<i8"), ("pos", "<i4")])


def _first_windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Group the windows of one range exactly, and tell each block which of its own come first."""
    parts = []
    for blob in rows["blob"]:
        raw = zstandard.decompress(blob)
        n, at, part = len(raw) // _SENT.itemsize, 0, {}
        for c in _SENT.names:
            part[c] = np.frombuffer(raw, dtype=_SENT[c], count=n, offset=at)
            at += n * _SENT[c].itemsize
        parts.append(part)
    sizes = [len(p["h1"]) for p in parts]
    h1, h2, null, doc, pos = (np.concatenate([p[c] for p in parts]) for c in _SENT.names)
    order = np.lexsort((pos, doc, null, h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = np.zeros(len(order), dtype=bool)
    first[order[new]] = True
    told = np.split(first, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"block": rows["block"], "kind": 1, "range": key[0], "blob": [pack_array(np.packbits(p)) for p in told]})


def _answers(rows: pd.DataFrame, kind: int) -> dict[int, bytes]:
    rows = rows[rows["kind"] == kind]
    return dict(zip(rows["range"].tolist(), rows["blob"], strict=True))


def characters(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.length(text_col))).first()[0] or 0)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every whole text; with texts=True also the kept words, joined by spaces."""
    plan = _Plan(characters(docs, text_col) // LETTERS, window)
    n = max(plan.slices, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    dealt = blocks(docs, n, id_col, text_col)
    reply = "block long, kind int, range int, blob binary"

    def send_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sent = list(_Block(row["texts"], plan).sent_cells())
                yield arrow_batch({"block": ([row["block"]] * len(sent), pa.int64()), "range": ([k for k, _ in sent], pa.int32()), "blob": ([b for _, b in sent], pa.binary())})

    def send_windows(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = _Block(left["texts"].iloc[0], plan)
        b.repeated(_answers(right, 0))
        return pd.DataFrame(list(b.sent_windows()), columns=["range", "blob"]).assign(block=key[0])[["block", "range", "blob"]]

    def clean(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = _Block(left["texts"].iloc[0], plan)
        b.repeated(_answers(right, 0))
        gone = b.covered(_answers(right, 1))
        lost = np.concatenate(([0], np.cumsum(gone)))
        out = []
        for k, (doc, null) in enumerate(zip(b.ids.tolist(), b.null.tolist(), strict=True)):
            lo, hi = int(b.words.first[k]), int(b.words.first[k + 1])
            removed = int(lost[hi] - lost[lo])
            parts = b.texts[k].split()
            kept = b" ".join([w for w, g in zip(parts, gone[lo:hi].tolist(), strict=True) if not g] if removed else parts)
            out.append((None if null else doc, hi - lo, removed, sha256(kept), *([kept.decode()] if texts else [])))
        frame = pd.DataFrame(out, columns=[id_col, "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])])
        return frame.assign(**{id_col: pd.array([r[0] for r in out], dtype="Int64")})

    cells = dealt.mapInArrow(send_cells, "block long, range int, blob binary")
    often = cells.groupBy("range").applyInPandas(lambda key, rows: _merge_cells(plan, key, rows), reply)
    windows = dealt.groupBy("block").cogroup(often.groupBy("block")).applyInPandas(send_windows, "block long, range int, blob binary")
    first = windows.groupBy("range").applyInPandas(_first_windows, reply)
    schema = f"{id_col} long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    return dealt.groupBy("block").cogroup(often.union(first).groupBy("block")).applyInPandas(clean, schema)
