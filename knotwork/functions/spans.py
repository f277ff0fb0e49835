"""Spans over a text, as arrays of structs (start, end), end exclusive: unions, deletion, and what moves with it; parts of tagged text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import TaggedString

SPANS = "array<struct<start:int,end:int>>"


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, in order, that cover the same places; empty and reversed spans cover none."""
    real = ends > starts
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return starts[new], reach[last]


def moved(places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where places lie after disjoint spans, in order, are deleted; places within one go to where it was.

    That is all five ways in which a note can lie to a span: around it, left end or right end in it, within it, and behind it."""
    if not len(starts):
        return places
    gone = np.concatenate(([0], np.cumsum(ends - starts)))
    k = np.searchsorted(starts, places, side="left")  # spans that begin before the place
    before = np.maximum(k - 1, 0)
    inside = np.where(k > 0, np.minimum(places, ends[before]) - starts[before], 0)
    return places - np.where(k > 0, gone[before], 0) - inside


def drop(text: str, starts: np.ndarray, ends: np.ndarray) -> str:
    """Text without disjoint spans, in order."""
    edges = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _pairs(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all spans of a column, and where each row's begin; null lists have none."""
    if spans.null_count:
        spans = pc.coalesce(spans, pa.scalar([], spans.type))
    starts, ends = (np.asarray(spans.values.field(k).fill_null(0), dtype=np.int64) for k in ("start", "end"))
    return starts, ends, np.asarray(spans.offsets)


def deleted(texts: pa.StringArray, cut: pa.ListArray, over: pa.ListArray) -> pa.StructArray:
    """What delete() tells of a batch; spans and notes stay arrays of numbers, a row's at a time is looked at."""
    out, moved_to = [], []
    (a, b, of), (x, y, note) = _pairs(cut), _pairs(over)
    for i, t in enumerate(texts):
        t = t.as_py()
        size = len(t or "")
        within = lambda places, at: np.clip(places[at[i] : at[i + 1]], 0, size)  # noqa: B023, E731
        starts, ends = union(within(a, of), within(b, of))
        out.append(None if t is None else drop(t, starts, ends))
        moved_to.append((moved(within(x, note), starts, ends), moved(within(y, note), starts, ends)))
    flat = [pa.array(np.concatenate([m[k] for m in moved_to]) if moved_to else [], pa.int32()) for k in (0, 1)]
    notes = pa.ListArray.from_arrays(pa.array(note - note[0], pa.int32()), pa.StructArray.from_arrays(flat, ["start", "end"]))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), notes], ["text", "notes"])


def delete(text: Column | str, spans: Column | str, notes: Column | str) -> Column:
    """struct(text, notes): the text without some spans, and where notes over it then lie, in their order.

    Spans may overlap, and reach beyond the text.  A note within what is deleted becomes empty.  Null texts stay null."""

    @F.arrow_udf(f"text string, notes {SPANS}")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, cut, over in batches:
            yield deleted(texts, cut, over)

    return run(text, spans, notes)


def cut_html(html: Column | str, spans: Column | str) -> Column:
    """array of strings: parts of tagged text by places in its plain text, each with the tags that are open in it opened and closed."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, parts in batches:
            out = []
            for h, ps in zip(pages, parts, strict=True):
                tagged = TaggedString.parse(h or "")
                out.append([str(tagged.substring(p["start"], p["end"] - p["start"])) for p in (ps if ps is not None else [])])
            yield pd.Series(out)

    return run(html, spans)
