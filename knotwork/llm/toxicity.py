"""Toxicity by noisy-channel deobfuscation.

Disguised words (letters written as digits or signs, spaced out, doubled or repeated) are lattices of
characters: a sign may be the letter it looks like or nothing, a repeated letter may be one, and a gap within
a run of single characters may be nothing or the end of a word.  A Viterbi search finds the likeliest path
under a character trigram model of the training texts.  The restored text is then scored by a lexicon of
words and word beginnings that marks training documents as toxic significantly often; every word of a
document counts once, by its longest entry, and the entries' probabilities are combined by noisy-or over a
base rate.  How significant and how telling an entry must be is chosen from CHOICES by the scores that
training documents get from the lexicons of the other folds, as it depends on the number of labels.

The character model and the lexicon are fitted on all labelled training documents, without exact and near
copies, since a toxic text copied often would make all its words look toxic.  A near copy shares four fifths
of its word pairs with another text of its class (MinHash bands, verified by the pairs themselves); every
other text stays.  Each is restored once; its different words are kept on disk, and counts and choices are
summed by tasks, so that the driver gets the model's tables only.

Defined results: null and empty texts get the base rate; rows without a label teach nothing; a document
with several labels is toxic if one says so; texts are scored whole; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import balanced
from .common import arrow_batch, rows_by_bytes, stage_folder, use_checkpoints
from .words import mix, runs, words

#: Most ids that are sent to where the texts are; more are joined by shuffle.
SENT = 500_000
#: Choices of the least evidence for an entry (the likelihood-ratio statistic) and its least probability, the strictest
#: first; documents that it must mark; folds that choose.
CHOICES, DOCUMENTS, FOLDS = [(e, p) for e in (24.0, 18.0, 14.0, 11.0, 8.0) for p in (0.9, 0.8, 0.65)], 3, 5
#: Least Jaccard likeness of the word pairs of near copies, MinHash bands, and values of each: a pair as like as that
#: shares no band once in 17,000 times.
JACCARD, BANDS, VALUES = 0.8, 32, 6
_FACTORS = np.random.default_rng(3).integers(0, 1 << 63, BANDS * VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Lengths of word beginnings.
PREFIX = (4, 5, 6, 7)
#: Most entries of the lexicon and of a task's memory of restored words.
ENTRIES, MEMORY = 20_000, 200_000
#: Characters of a token after which what all paths have in common is settled.
SETTLE = 256
#: Characters of the longest token that a task remembers.
REMEMBERED = 60
#: Letters that signs stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_ONE = r"(?:[^\W_]|[" + re.escape("".join(c for c in LOOKS if not c.isdigit())) + "])"
_SPACED = re.compile(rf"(?<!\S)(?:{_ONE}[\s.*_-]+){{2,}}{_ONE}(?!\S)")
_REPEAT = re.compile(r"([^\W\d_])\1")
_GAP = re.compile(r"[\s.*_-]+")
_TRIM = ".,;:?\"')]}*&#%<>"
_MARKS = re.compile(r"(?:([$!|+@])\1+)$")  # repeated signs behind a word are decoration
#: Costs of leaving out a sign that may be a letter, one of two equal letters, and one of more.
_SKIP_SIGN, _SKIP_DOUBLE, _SKIP_REPEAT = -7.0, -3.0, -0.5


class CharModel:
    """Trigrams of the letters of words, with bigrams and letters behind them."""

    def __init__(self, counts: dict[str, int]):
        self.c3 = dict(counts)
        self.c2: Counter = Counter()
        self.c1: Counter = Counter()
        for t, n in counts.items():
            self.c2[t[:2]] += n
            self.c1[t[2]] += n
        self.total = sum(self.c1.values())
        self.memory: dict[tuple[str, str], float] = {}

    def log_p(self, before: str, c: str) -> float:
        got = self.memory.get((before, c))
        if got is None:
            p1 = (self.c1.get(c, 0) + 0.1) / (self.total + 20)
            n = self.c2.get(before, 0)
            got = self.memory[before, c] = math.log((self.c3.get(before + c, 0) + 2 * p1) / (n + 2))
        return got


def trigrams(text: str) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(_LETTERS.findall(text.lower())).items():
        padded = f"^^{w}^"
        for k in range(len(padded) - 2):
            out[padded[k : k + 3]] += n
    return out


def choices(token: str) -> list[tuple[str, float | None, bool]]:
    """The lattice: for each character the letters it may be, the cost of leaving it out (None: never), and whether a word may end here."""
    out = []
    for c, same in groupby(token):
        n = sum(1 for _ in same)
        letters = "" if c == " " else c if c.isalpha() else LOOKS.get(c, "")
        again = _SKIP_REPEAT if n > 2 else _SKIP_DOUBLE
        for k in range(n):
            skip = (again if k else None) if c.isalpha() else _SKIP_SIGN if letters else 0.0
            out.append((letters, skip, c == " "))
    return out


def best_path(model: CharModel, token: str) -> tuple[float, str]:
    """The likeliest letters behind a disguised word or a run of single characters (with one space for each gap), and their score.

    Tokens of any length: what all paths begin with is settled now and then, so that no path is copied over and over."""
    paths: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    settled: list[str] = []
    for k, (letters, skip, gap) in enumerate(choices(token)):
        if k % SETTLE == SETTLE - 1:
            same = commonprefix([out for _, out in paths.values()])
            settled.append(same)
            paths = {s: (p, out[len(same) :]) for s, (p, out) in paths.items()}
        nxt: dict[str, tuple[float, str]] = {}

        def offer(state: str, p: float, out: str) -> None:
            if state not in nxt or p > nxt[state][0]:  # noqa: B023
                nxt[state] = (p, out)  # noqa: B023

        for state, (p, out) in paths.items():
            for x in letters:
                offer(state[1] + x, p + model.log_p(state, x), out + x)
            if skip is not None:
                offer(state, p + skip, out)
            if gap and state != "^^":
                offer("^^", p + model.log_p(state, "^"), out + " ")
        paths = nxt
    best, out = max((p + model.log_p(s, "^"), out) for s, (p, out) in paths.items())
    return best, "".join([*settled, out])


def decode(model: CharModel, token: str) -> str:
    return best_path(model, token)[1]


class Restorer:
    """Restores disguised words of lower-cased texts; what was restored before is remembered."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, str] = {}

    def word(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            got = token if token.isalpha() and not _REPEAT.search(token) else self._word(token)
            if len(self.known) >= MEMORY:
                self.known.clear()
            if len(token) <= REMEMBERED:
                self.known[token] = got
        return got

    def _word(self, token: str) -> str:
        core = _MARKS.sub("", token.strip(_TRIM)).strip(_TRIM)
        if (core.isalpha() and not _REPEAT.search(core)) or not any(map(str.isalpha, core)) or "@" in core and "." in core:
            return token
        return decode(self.model, core)

    def spaced(self, m: re.Match) -> str:
        return decode(self.model, _GAP.sub(" ", m[0])) if sum(map(str.isalpha, m[0])) > 1 else m[0]

    def text(self, text: str) -> str:
        known = self.known.get
        return " ".join([known(t) or self.word(t) for t in _SPACED.sub(self.spaced, text.lower()).split()])


@dataclass
class Model:
    chars: CharModel
    entries: dict[str, float]  # a word as =word, a beginning as itself
    base: float

    def score(self, restored: str) -> float:
        if not self.entries:
            return self.base
        first = self.firsts
        miss = 1 - self.base
        for w in {w for w in _LETTERS.findall(restored) if w[:4] in first}:
            if (p := next((p for f in chain(w) if (p := self.entries.get(f)) is not None), None)) is not None:
                miss *= 1 - p
        return 1 - miss

    @property
    def firsts(self) -> set[str]:
        got = self.__dict__.get("_firsts")
        if got is None:
            got = self.__dict__["_firsts"] = {e.lstrip("=")[:4] for e in self.entries}
        return got


def chain(word: str) -> list[str]:
    """The entries that a word may go by, the longest first."""
    return ["=" + word, *(word[:n] for n in reversed(PREFIX) if len(word) >= n)]


def _g(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The likelihood-ratio statistic of presence against class."""
    total = n_pos + n_neg
    out = np.zeros(len(pos))
    for seen, row, col in ((pos, pos + neg, n_pos), (neg, pos + neg, n_neg), (n_pos - pos, total - pos - neg, n_pos), (n_neg - neg, total - pos - neg, n_neg)):
        expected = row * (col / total)
        m = seen > 0
        out[m] += 2 * seen[m] * np.log(seen[m] / expected[m])
    return out


def _shingles(texts: list[str]) -> list[np.ndarray]:
    """The different hashes of each text's word pairs; of a text of one word, of that word."""
    w = words([t.lower().encode() for t in texts])
    one = w.hashes()
    two, at = runs(one, w.first, 2)
    bounds = np.searchsorted(at, w.first).tolist()
    first = w.first.tolist()
    return [np.unique(two[bounds[k] : bounds[k + 1]] if bounds[k + 1] > bounds[k] else one[first[k] : first[k + 1]]) for k in range(len(texts))]


def _band_keys(h: np.ndarray) -> np.ndarray:
    """A hash of the MinHash values of each band."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1024):
        low = np.minimum(low, (h[at : at + 1024, None] * _FACTORS).min(0))
    return mix((low * _FACTORS[::-1]).reshape(BANDS, -1).sum(1, dtype=np.uint64)).view(np.int64)


def without_copies(rows: DataFrame) -> DataFrame:
    """(text, y) of (_id, _text, _y): of each class no text twice, and none that has a near copy of a smaller key.

    Texts that share a MinHash band are only compared: what counts is the Jaccard likeness of their word pairs.
    Each is compared with the first text of each of its bands, so that large groups make no more pairs than rows.
    """

    # a row's key is made of its id and text: ids may be repeated
    c = F.col
    rows = rows.select(F.xxhash64("_id", "_text").alias("key"), (c("_y") > 0).cast("int").alias("y"), c("_text").alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_by_bytes(batches, "text"):
            h = _shingles([r[2] for r in part])
            yield arrow_batch({
                "key": ([r[0] for r in part], pa.int64()), "y": ([r[1] for r in part], pa.int32()), "same": ([r[3] for r in part], pa.int64()),
                "n": ([len(r[2]) for r in part], pa.int64()), "bands": ([_band_keys(x) for x in h], pa.list_(pa.int64())),
            })

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_by_bytes(batches, "text"):
            copies = []
            for y, key, mine, other in part:
                a, b = _shingles([mine, other])
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= JACCARD * (len(a) + len(b) - both):
                    copies.append((y, key))
            yield arrow_batch({"y": ([y for y, _ in copies], pa.int32()), "key": ([k for _, k in copies], pa.int64())})

    made = rows.withColumn("same", F.xxhash64("text")).mapInArrow(keys, "key long, y int, same long, n long, bands array<long>").checkpoint()
    single = made.groupBy("y", "same", "n").agg(F.min("key").alias("key"), F.min_by("bands", "key").alias("bands")).select("y", "key", "bands").checkpoint()
    banded = single.select("y", "key", F.posexplode("bands").alias("band", "h"))
    leads = banded.groupBy("y", "band", "h").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = banded.join(leads, ["y", "band", "h"]).where("key > lead").select("y", "key", "lead").distinct().checkpoint()
    compared = near.select("y", "key").union(near.select("y", "lead")).distinct().checkpoint()
    texts = rows.join(_sent(compared), ["y", "key"], "left_semi").dropDuplicates(["y", "key"])
    pairs = near.join(texts, ["y", "key"]).join(texts.select("y", c("key").alias("lead"), c("text").alias("other")), ["y", "lead"]).select("y", "key", "text", "other")
    copies = pairs.mapInArrow(alike, "y int, key long").distinct()
    kept = rows.join(_sent(single.select("y", "key").join(copies, ["y", "key"], "left_anti").checkpoint()), ["y", "key"], "left_semi")
    repeated = made.groupBy("y", "key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates(["y", "key"]) if repeated else kept).select("text", "y")


def _sent(rows: DataFrame) -> DataFrame:
    """Few rows are sent to all tasks."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = stage_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on all labelled rows where `train` (over the id, which has the same name in both tables) holds."""
    use_checkpoints(docs.sparkSession)
    marks = labels.where(train & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")).checkpoint()
    sizes = {int(r["_y"] > 0): r["n"] for r in marks.groupBy((F.col("_y") > 0).cast("int").alias("_y")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(CharModel({}), {}, 1.0 * bool(sizes.get(1)) * 0.5)
    base = sizes[1] / (sizes[0] + sizes[1])
    texts = docs.where(train & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    different = _stored(without_copies(balanced(texts).join(_sent(marks), "_id")), "different")

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for part in rows_by_bytes(batches, "text"):
            for text, _ in part:
                c.update(trigrams(text))
        yield arrow_batch({"t": (list(c), pa.string()), "n": (list(c.values()), pa.int64())})

    most = different.mapInArrow(count_trigrams, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(200_000)
    chars = CharModel({r["t"]: r["n"] for r in most.collect()})
    known = docs.sparkSession.sparkContext.broadcast(chars)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text its different words."""
        restorer = Restorer(known.value)
        for part in rows_by_bytes(batches, "text"):
            made = [sorted(set(_LETTERS.findall(restorer.text(text)))) for text, _, _ in part]
            yield arrow_batch({"y": ([r[1] for r in part], pa.int32()), "fold": ([r[2] for r in part], pa.int32()), "words": (made, pa.list_(pa.string()))})

    folds = different.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    restored = _stored(folds.mapInArrow(restore, "y int, fold int, words array<string>"), "restored")

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, ws in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist(), strict=True):
                c[y].update({f for w in ws for f in chain(w)})
        names = sorted(c[0].keys() | c[1].keys())
        yield arrow_batch({"f": (names, pa.string()), "neg": ([c[0][f] for f in names], pa.int64()), "pos": ([c[1][f] for f in names], pa.int64())})

    n = {(r["fold"], r["y"]): r["n"] for r in restored.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    n_by_fold = np.array([[n.get((k, y), 0) for y in (0, 1)] for k in range(FOLDS)], dtype=float)
    n_of = n_by_fold.sum(0)
    counted = restored.select("y", "words").mapInArrow(count_features, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    # only what is more frequent in toxic texts, the most telling first
    lift = F.col("pos") / max(1.0, n_of[1]) - F.col("neg") / max(1.0, n_of[0])
    best = counted.where((F.col("pos") >= DOCUMENTS) & (lift > 0)).orderBy(F.desc(lift), "f").limit(ENTRIES).toPandas()
    p, g = _told(best[["neg", "pos"]].to_numpy(dtype=float).reshape(-1, 2), n_of, base)
    best = best[(p >= min(x for _, x in CHOICES)) & (g >= min(x for x, _ in CHOICES))].reset_index(drop=True)
    place = {f: k for k, f in enumerate(best["f"])}
    firsts = {f.lstrip("=")[:4] for f in place}

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text the words with candidates, each as the candidates it may go by."""
        wide = len(PREFIX) + 1
        for batch in batches:
            made = []
            for ws in batch.column("words").to_pylist():
                of = [[place.get(f, -1) for f in chain(w)] for w in ws if w[:4] in firsts]
                made.append([x for c in of if max(c) >= 0 for x in c + [-1] * (wide - len(c))])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array(made, type=pa.list_(pa.int32()))], names=["y", "fold", "chains"])

    shown = _stored(restored.mapInArrow(chains, "y int, fold int, chains array<int>"), "chains")
    evidence, probability = _choose(len(best), base, shown, n_by_fold)
    p, g = _told(best[["neg", "pos"]].to_numpy(dtype=float).reshape(-1, 2), n_of, base)
    good = (p >= probability) & (g >= evidence)
    entries = dict(zip(best["f"][good], p[good].tolist(), strict=True))
    return Model(chars, entries, _base(base) if entries else base)


def _base(rate: float) -> float:
    """The probability of documents without any entry; it is small, and never decides."""
    return min(0.3, rate / 4)


def _told(counts: np.ndarray, n: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability and evidence of features with (clean, toxic) counts in documents of both classes."""
    neg, pos = counts.T
    odds = (pos / max(1.0, n[1]) * rate) / np.maximum(1e-12, (neg + 0.5) / max(1.0, n[0]) * (1 - rate))
    return np.minimum(0.995, odds / (1 + odds)), _g(pos, neg, max(1.0, n[1]), max(1.0, n[0]))


def _choose(candidates: int, rate: float, shown: DataFrame, n: np.ndarray) -> tuple[float, float]:
    """The choice with the best F1 on documents scored by the other folds' counts; the strictest of equals.  n: documents by fold and class."""
    if not candidates:
        return CHOICES[0]
    wide = len(PREFIX) + 1

    def links_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fold and class of documents; of each of their words the document and the candidates."""
        linked = batch.column("chains")
        of = np.repeat(np.arange(len(batch)), linked.value_lengths().to_numpy(zero_copy_only=False) // wide)
        return batch.column("fold").to_numpy(), batch.column("y").to_numpy() > 0, of, linked.flatten().to_numpy().astype(np.int64).reshape(-1, wide)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((candidates, FOLDS, 2), dtype=np.int64)
        for batch in batches:
            fold, y, of, links = links_of(batch)
            # a document has a candidate once, however many of its words go by it
            pairs = np.unique((of[:, None] * candidates + links)[links >= 0])
            np.add.at(counts, (pairs % candidates, fold[pairs // candidates], y[pairs // candidates].astype(int)), 1)
        at = np.flatnonzero(counts)
        yield arrow_batch({"at": (at, pa.int64()), "n": (counts.ravel()[at], pa.int64())})

    summed = shown.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(candidates * FOLDS * 2)
    counts[summed["at"].to_numpy(dtype=np.int64)] = summed["n"]
    counts = counts.reshape(candidates, FOLDS, 2)
    told = shown.sparkSession.sparkContext.broadcast([_told(counts.sum(1) - counts[:, k], n.sum(0) - n[k], rate) for k in range(FOLDS)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, said = np.zeros(len(CHOICES), dtype=np.int64), np.zeros(len(CHOICES), dtype=np.int64)
        for batch in batches:
            fold, y, of, links = links_of(batch)
            for at, (evidence, probability) in enumerate(CHOICES):
                miss = np.full(len(batch), math.log(1 - _base(rate)))
                for k, (p, g) in enumerate(told.value):
                    mine = fold[of] == k
                    good = np.append((p >= probability) & (g >= evidence), False)[links[mine]]
                    hit, first = good.any(1), good.argmax(1)
                    q = p[links[mine][np.arange(len(first)), first][hit]]
                    np.add.at(miss, of[mine][hit], np.log1p(-q))
                toxic = 1 - np.exp(miss) >= 0.5
                right[at] += (toxic & y).sum()
                said[at] += toxic.sum()
        yield arrow_batch({"choice": (list(range(len(CHOICES))), pa.int32()), "hit": (right, pa.int64()), "said": (said, pa.int64())})

    scored = {r["choice"]: r for r in shown.mapInArrow(judge, "choice int, hit long, said long").groupBy("choice").agg(F.sum("hit").alias("hit"), F.sum("said").alias("said")).collect()}
    best = (-1.0, CHOICES[0])
    for at, choice in enumerate(CHOICES):
        r = scored.get(at)
        f1 = 2 * r["hit"] / max(1, r["said"] + n[:, 1].sum()) if r else 0.0
        if f1 > best[0] + 1e-9:
            best = (f1, choice)
    return best[1]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", restored: bool = False) -> DataFrame:
    """(id, score, predicted) of every whole text; with restored=True also the restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.chars)
        for rows in rows_by_bytes(batches, text_col):
            texts = [restorer.text(t or "") for _, t in rows]
            p = [m.score(t) for t in texts]
            out = {id_col: ([i for i, _ in rows], pa.int64()), "score": (p, pa.float64()), "predicted": ([int(x >= 0.5) for x in p], pa.int32())}
            yield arrow_batch(out | ({"restored": (texts, pa.string())} if restored else {}))

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, score double, predicted int" + (", restored string" if restored else ""))
