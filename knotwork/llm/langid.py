"""Language identification as inference in a mixture of languages.

Each language is a distribution over hashed byte trigrams of lower-cased text in which everything but
letters is a space; the counts cover every training text.  For a document, expectation-maximisation
estimates the share of each language in its trigrams.  The set of languages grows from the likeliest
one: a language is added while it raises the log likelihood by more than a penalty that grows with the
logarithm of the number of trigrams.  The concave likelihood gives a bound on that gain, so most
documents of one language need no iteration.

Defined results: `und` with score 0 and no shares if the text is null or has no letter, or if nothing was
learned; ties go to the language that sorts first; training rows with null text or lang teach nothing;
repeated rows count as often as they occur; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, per_batch, rows_by_bytes

BINS = 1 << 14
UNKNOWN = "und"
#: A further language must raise the log likelihood by this times the logarithm of the number of trigrams.
PENALTY = 6.0
_BYTES = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (BINS, languages)


def trigrams(text: str) -> np.ndarray:
    """Bins of the byte trigrams of a text."""
    b = np.frombuffer(f" {text.lower()} ".encode().translate(_BYTES), dtype=np.uint8)
    space = b == 32
    b = b[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(18)


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Counts over all rows where `train` holds.  What reaches the driver is at most BINS rows a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for rows in rows_by_bytes(batches, text_col):
            for text, lang in rows:
                counts.setdefault(lang, np.zeros(BINS, dtype=np.int64))
                counts[lang] += np.bincount(trigrams(text), minlength=BINS)
        for lang, c in counts.items():
            bins = np.flatnonzero(c)
            yield arrow_batch({"lang": ([lang] * len(bins), pa.string()), "bin": (bins, pa.int32()), "n": (c[bins], pa.int64())})

    kept = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = kept.select(text_col, lang_col).mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    c = np.zeros((BINS, len(languages)))
    c[rows["bin"], np.searchsorted(languages, rows["lang"])] = rows["n"]
    return Model(languages, np.log((c + smoothing) / (c.sum(0) + smoothing * BINS)))


def _em(p: np.ndarray, share: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages whose likelihoods are p's columns, and the mixture's likelihoods."""
    for _ in range(rounds):
        mixed = p @ share
        new = share * (1 / mixed @ p) / len(p)
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, p @ share


def shares(model: Model, text: str) -> dict[str, float]:
    """The languages of a text that has a letter, with their shares."""
    lines = model.log_p[trigrams(text)]
    total = lines.sum(0)
    chosen = [int(total.argmax())]
    p = np.exp(lines - lines[:, chosen])  # against the likeliest language
    n = len(p)
    share, mixed = np.ones(1), np.ones(n)
    penalty = PENALTY * np.log(n + 1)
    while len(chosen) < p.shape[1]:
        gain = (1 / mixed) @ p / n  # of moving a little weight to each language
        gain[chosen] = 0
        k = int(gain.argmax())
        if n * (gain[k] - 1) <= penalty:
            break
        s, m = _em(p[:, [*chosen, k]], np.append(share * 0.9, 0.1))
        if np.log(m).sum() - np.log(mixed).sum() <= penalty:
            break
        chosen, share, mixed = [*chosen, k], s, m
    return {model.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def known_language(model: Model, text: str | None) -> bool:
    """Whether a text gets a language."""
    return bool(text and model.languages and any(map(str.isalpha, text)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, mixture): the language with the largest share, that share, and all shares as text."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for rows in rows_by_bytes(batches, text_col):
            found = [shares(m, t) if known_language(m, t) else {} for _, t in rows]
            best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (UNKNOWN, 0.0) for f in found]
            yield arrow_batch({
                id_col: ([i for i, _ in rows], pa.int64()),
                "lang_pred": ([b for b, _ in best], pa.string()),
                "score": ([min(1.0, s) for _, s in best], pa.float64()),
                "mixture": ([",".join(f"{k}:{v:.4f}" for k, v in sorted(f.items(), key=lambda x: (-x[1], x[0]))) for f in found], pa.string()),
            })

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, lang_pred string, score double, mixture string")


def keep_known(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of texts that get a language whose share is at least `least`."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def change(texts: list) -> tuple[list[bool], list]:
        m = known.value
        return [known_language(m, t) and max(shares(m, t).values()) >= least for t in texts], texts

    return per_batch(docs, text_col, change)
