"""Language-model scores: a causal self-attention model over subword ids, in numpy.

A text is its words, with A-Z lower-cased, and one end.  Counts of all tokens of all training texts are
gathered by ranges of word hashes (64 bits): blocks of texts send the hashes of their different words with
training counts, and get back the counts over the whole corpus.  The counts are kept apart for CLUSTERS
kinds of text (languages, styles), told by their byte pairs.  They give the base score, and the shares of a
word in the corpus and in each kind of text that the model mixes with what its network says.

The network reads subword ids: the first UNITS tokens of a public tokenizer file, matched greedily within
each word.  One head of causal attention looks back over the window; a position's own token and what the
head gathers give the next id as a class and a member of it.  Texts are cut into steps of STEP ids, each
scored once; its window also holds the STEP ids before it, so windows overlap, and one masked batched
product serves many of them.  The probability of a word in a text of kind k is

    w0 * count in k / tokens of k + w1 * count / tokens + w2 * share among the text's words so far + w3 * product over its subword ids

where the w begin as MIX (which counts as PRIOR words); then the weight of the first two and that of the last
two follow, word by word, how much each has explained of the text so far, so that the network speaks most
where counts say little.
The probability of a text is the mean over kinds, weighted by their tokens.

The network is trained by Adam.  A first round sees training texts (of long ones: pieces) of about SAMPLE characters; then
all executors go on from there, each task on its own share of all pieces of all training texts, and the mean of
their weights is the model.  Kinds of text are found in the first round's pieces, and then told by the byte pairs of all
training texts.  So every training text teaches the network, the kinds and the counts, and both rounds run at every size.

Defined results: a null text is an empty one, i.e. one end; a text with a null id belongs to neither fold
and teaches nothing; without training texts the network is uniform and the base is 0; other columns are
left out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters, default_vocabulary
from .common import arrow_batch, fold, rows_by_bytes
from .substrings import LETTERS, characters
from .words import PIECE, Parts, blocks, pack_array, unpack_array, unpack_texts, words

#: Ids, classes of ids, and size of vectors.
UNITS, CLASSES, DIM = 1024, 32, 24
MEMBERS = UNITS // CLASSES
STEP = 16
END = UNITS - 1
#: Characters of a piece of text, and of the first round's pieces and those of a task's share in the second.
CUT, SAMPLE = 4096, 2_000_000
MIX, PRIOR = (0.6, 0.02, 0.08, 0.3), 2.0
CLUSTERS, PAIRS = 8, 1 << 12
#: Words that a task counts.
RANGE = 8_000_000
END_HASH = np.uint64(0x5851F42D4C957F2D)


class Units:
    """Greedy longest match of words against the first UNITS - 1 tokens of a vocabulary with word ends, for many words in step."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = {c: b for b, c in enumerate(_byte_letters())}
        ends, inner = {}, {}
        for t, i in model["vocab"].items():
            if i < END:
                last = t.endswith(model["end_of_word_suffix"])
                body = t.removesuffix(model["end_of_word_suffix"]) if last else t
                (ends if last else inner.setdefault(len(body), {}))[bytes(letters[c] for c in body)] = i
        self.longest = max(map(len, ends))
        self.ends = self._table(ends)
        self.inner = {n: self._table(inner[n]) for n in sorted(inner, reverse=True)}

    @staticmethod
    def _table(tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        made = sorted((int(Parts(t).hash(np.array([0]), np.array([len(t)]))[0]), i) for t, i in tokens.items())
        return np.array([h for h, _ in made], dtype=np.uint64), np.array([i for _, i in made], dtype=np.int16)

    def segment(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        ids, sizes, lo = [], [], 0
        while lo < len(start):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(end[lo:] - start[lo:]), PIECE, side="right")))
            part = b"".join([data[a:b] for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)])
            stop = np.cumsum(end[lo:hi] - start[lo:hi])
            a, b = self._segment(Parts(part), stop - (end[lo:hi] - start[lo:hi]), stop)
            ids.append(a), sizes.append(b)
            lo = hi
        empty = np.zeros(0, dtype=np.int16)
        return np.concatenate([empty, *ids]), np.concatenate([empty.astype(np.int64), *sizes])

    def _segment(self, parts: Parts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, pos, of, got = np.arange(len(start)), start.copy(), [], []
        while len(word):
            left = end[word] - pos
            found, step = np.full(len(word), -1, dtype=np.int16), np.zeros(len(word), dtype=np.int64)
            tries = [(self.ends, np.flatnonzero(left <= self.longest), None), *((t, None, n) for n, t in self.inner.items())]
            for (hashes, names), at, n in tries:
                if at is None:
                    at = np.flatnonzero((found < 0) & (left > n))
                if len(at):
                    h = parts.hash(pos[at], pos[at] + (left[at] if n is None else n))
                    k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = hashes[k] == h
                    found[at[hit]] = names[k[hit]]
                    step[at[hit]] = left[at[hit]] if n is None else n
            of.append(word), got.append(found)
            pos = pos + step
            more = pos < end[word]
            word, pos = word[more], pos[more]
        of_all = np.concatenate(of)
        return np.concatenate(got)[np.argsort(of_all, kind="stable")], np.bincount(of_all, minlength=len(start))


def byte_pairs(text: bytes) -> np.ndarray:
    """Counts of the hashed byte pairs of a text."""
    b = np.frombuffer(b" " + text + b" ", dtype=np.uint8).astype(np.uint32)
    return np.bincount(((b[:-1] << 8 | b[1:]) * np.uint32(2654435761)) >> np.uint32(20), minlength=PAIRS)


def find_kinds(texts: list[bytes], rounds: int = 12) -> np.ndarray:
    """Log probabilities of byte pairs in CLUSTERS kinds of text, found by k-means from far-apart texts."""
    x = np.array([byte_pairs(t) for t in texts], dtype=np.float64).reshape(-1, PAIRS)
    if not len(x):
        return np.zeros((PAIRS, CLUSTERS))
    unit = np.sqrt(x / x.sum(1, keepdims=True))  # products of these are the texts' affinities
    seeds, like = [int(x.sum(1).argmax())], unit @ unit[int(x.sum(1).argmax())]
    while len(seeds) < min(CLUSTERS, len(x)):
        # the quarter of the longer texts gives better seeds than short ones do
        far = np.where(x.sum(1) >= np.quantile(x.sum(1), 0.5), like, 2)
        seeds.append(int(far.argmin()))
        like = np.maximum(like, unit @ unit[seeds[-1]])
    own = (unit @ unit[seeds].T).argmax(1)
    for _ in range(rounds):
        c = np.array([x[own == k].sum(0) for k in range(CLUSTERS)]) + 0.05
        log_q = np.log(c / c.sum(1, keepdims=True)).T
        own = (x @ log_q).argmax(1)
    return log_q


@dataclass
class Network:
    w: dict[str, np.ndarray]
    kinds: np.ndarray | None = None  # (PAIRS, CLUSTERS)

    @staticmethod
    def start(seed: int = 3) -> Network:
        g, d = np.random.default_rng(seed), DIM
        r = lambda *s: g.normal(0, 0.2, s).astype(np.float32)
        zero = lambda *s: np.zeros(s, dtype=np.float32)
        return Network({
            "emb": r(UNITS, d), "query": r(d, d), "key": r(d, d), "value": r(d, d), "near": zero(2 * STEP),
            "class": zero(d, CLASSES), "follow": zero(UNITS, CLASSES), "of": r(CLASSES, d), "member": zero(d, MEMBERS), "share": zero(CLASSES, MEMBERS),
        })

    def bias(self) -> np.ndarray:
        """Of each distance, for the STEP positions over the 2 * STEP positions of the window; what lies ahead is masked."""
        gap = STEP + np.arange(STEP)[:, None] - np.arange(2 * STEP)
        return np.where(gap >= 0, self.w["near"][np.clip(gap, 0, 2 * STEP - 1)], np.float32(-1e9)).astype(np.float32)

    def tables(self) -> dict[str, np.ndarray]:
        """For scoring: what each id contributes in one row (query, key, value and a one behind it, vector, next class), and the last layer of both parts."""
        w, e = self.w, self.w["emb"]
        row = np.concatenate((e @ w["query"] / np.float32(DIM**0.5), e @ w["key"], e @ w["value"], np.ones((UNITS, 1), dtype=np.float32), e, w["follow"]), 1)
        return {"row": row, "out": np.concatenate((w["class"], w["member"]), 1), "of": w["of"] @ w["member"] + w["share"], "gap": self.bias()}


_COLUMNS = [slice(a, b) for a, b in ((0, DIM), (DIM, 2 * DIM), (2 * DIM, 3 * DIM + 1), (3 * DIM + 1, 4 * DIM + 1), (4 * DIM + 1, 4 * DIM + 1 + CLASSES))]
_PARTS = np.repeat(np.eye(2, dtype=np.float32), (CLASSES, MEMBERS), 0)  # sums a row's classes and its members


def log_p(t: dict[str, np.ndarray], before: np.ndarray, mask: np.ndarray, own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probabilities of target ids (steps, STEP), given the ids that precede each of them (own) and the step before the first.

    Each step's window is the step before it, which is masked where another text begins, and itself: the rows of
    ids are fetched once, and a window is a view of two steps of them.
    """
    n, (q, k, v, e, follow) = len(own), _COLUMNS
    rows = t["row"].take(np.concatenate((before[None], own)), axis=0)
    window = np.lib.stride_tricks.as_strided(rows, (n, 2 * STEP, rows.shape[2]), rows.strides, writeable=False)
    mine = rows[1:]
    s = mine[..., q] @ window[..., k].transpose(0, 2, 1)
    s += t["gap"]
    s[mask < 0, :, :STEP] = -1e9
    np.exp(s, out=s)
    a = s @ window[..., v]
    h = a[..., :DIM] / a[..., DIM:]
    h += mine[..., e]
    z = h.reshape(-1, DIM) @ t["out"]
    c, m = np.divmod(target.ravel().astype(np.int64), MEMBERS)
    z.reshape(n, STEP, -1)[..., :CLASSES] += mine[..., follow]
    z[:, CLASSES:] += t["of"].take(c, axis=0)
    at = np.arange(0, z.size, z.shape[1])
    out = z.ravel()[at + c] + z.ravel()[at + CLASSES + m]
    np.exp(z, out=z)
    both = z @ _PARTS
    return (out - np.log(both[:, 0] * both[:, 1])).reshape(target.shape)


def steps(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' ids, one after the other, cut into steps: ids before, mask of these, own inputs, targets, and the place of each target that counts."""
    sizes = np.diff(first)
    n = -(-sizes // STEP)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = first[text, None] + (k * STEP)[:, None] + np.arange(STEP)
    real = at < first[text + 1, None]
    target = np.where(real, ids[np.minimum(at, len(ids) - 1)], 0)
    own = np.empty_like(target)
    own[:, 1:] = target[:, :-1]
    own[:, 0] = np.where(k > 0, ids[np.maximum(at[:, 0] - 1, 0)], END)
    before = np.full_like(own, END)
    before[1:] = own[:-1]
    return before, np.where(k > 0, 0, -1e9).astype(np.float32), own, target, np.where(real, at, -1)


def score_ids(net: Network, ids: np.ndarray, first: np.ndarray, batch: int = 128) -> np.ndarray:
    """Log probability of each id; every id is scored in one window."""
    out = np.empty(len(ids), dtype=np.float32)
    if len(ids):
        t = net.tables()
        before, mask, own, target, place = steps(ids, first)
        for lo in range(0, len(own), batch):
            p = log_p(t, before[lo], mask[lo : lo + batch], own[lo : lo + batch], target[lo : lo + batch])
            where = place[lo : lo + batch]
            out[where[where >= 0]] = p[where >= 0]
    return out


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by their row of n; equal rows are brought together first, which takes a quarter of adding one after the other."""
    order = np.argsort(rows, kind="stable")
    there = rows[order]
    begin = np.flatnonzero(np.diff(there, prepend=-1))
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    out[there[begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


#: The distance of each position of a step to each of its window.
_GAPS = (STEP + np.arange(STEP)[:, None] - np.arange(2 * STEP)).ravel()
_ONE = np.eye(CLASSES, dtype=np.float32)


def _gradients(w: dict[str, np.ndarray], before: np.ndarray, mask: np.ndarray, own: np.ndarray, target: np.ndarray, real: np.ndarray, gap: np.ndarray) -> dict[str, np.ndarray]:
    n, root = len(own), np.float32(DIM**0.5)
    keys = np.concatenate((before, own), 1).astype(np.int16)  # rows of 16 bits are sorted by counting
    mine = own.ravel().astype(np.int16)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    e = w["emb"].take(keys.ravel(), axis=0)
    x = w["emb"].take(mine, axis=0)
    told = np.concatenate((w["key"], w["value"]), 1)
    kv = (e @ told).reshape(n, 2 * STEP, 2 * DIM)
    q, k, v = (x @ w["query"] / root).reshape(n, STEP, DIM), np.ascontiguousarray(kv[..., :DIM]), np.ascontiguousarray(kv[..., DIM:])
    p = q @ k.transpose(0, 2, 1)
    p += gap
    p[:, :, :STEP] += mask[:, None, None]
    p -= p.max(2, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(2, keepdims=True)
    h = x + flat(p @ v)
    c, m = np.divmod(target.ravel().astype(np.int64), MEMBERS)
    one, at = _ONE.take(c, axis=0), np.arange(len(c))
    h2 = h + w["of"].take(c, axis=0)
    weight = (real.ravel() / max(1, real.sum())).astype(np.float32)[:, None]

    def soft(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[at, y] -= 1
        z *= weight
        return z

    z1, z2 = h @ w["class"], h2 @ w["member"]
    z1 += w["follow"].take(mine, axis=0)
    z2 += w["share"].take(c, axis=0)
    d1, d2 = soft(z1, c), soft(z2, m)
    dh2 = d2 @ w["member"].T
    dh = d1 @ w["class"].T
    dh += dh2
    g = {"class": h.T @ d1, "member": h2.T @ d2, "follow": _summed(mine, d1, UNITS), "share": one.T @ d2, "of": one.T @ dh2}
    out = dh.reshape(n, STEP, DIM)
    dv, ds = p.transpose(0, 2, 1) @ out, out @ v.transpose(0, 2, 1)
    ds -= (ds * p).sum(2, keepdims=True)
    ds *= p
    g["near"] = np.bincount(np.maximum(_GAPS, 0), np.where(_GAPS >= 0, ds.sum(0).ravel(), 0), 2 * STEP).astype(np.float32)
    dq, dkv = flat(ds @ k), flat(np.concatenate((ds.transpose(0, 2, 1) @ q, dv), 2))
    dq /= root
    g["query"], both = x.T @ dq, e.T @ dkv
    g["key"], g["value"] = both[:, :DIM], both[:, DIM:]
    de = (dkv @ told.T).reshape(n, 2 * STEP, DIM)
    dh += dq @ w["query"].T
    de[:, STEP:] += out
    g["emb"] = _summed(keys.ravel(), flat(de), UNITS)
    return g


def train(ids: np.ndarray, first: np.ndarray, rounds: int = 3, batch: int = 128, rate: float = 0.01, net: Network | None = None) -> Network:
    """Fit a network to texts' ids, from the start or from one that is trained already."""
    before, mask, own, target, place = steps(ids, first) if len(ids) else [np.zeros((0, STEP))] * 5
    if net is None:
        net = Network.start()
        if not len(ids):
            return net
        c, m = np.divmod(ids.astype(np.int64), MEMBERS)
        follow = np.full((UNITS, CLASSES), 0.0)
        np.add.at(follow, (own.ravel()[place.ravel() >= 0], np.divmod(target.ravel()[place.ravel() >= 0].astype(np.int64), MEMBERS)[0]), 1)
        share = np.zeros((CLASSES, MEMBERS))
        np.add.at(share, (c, m), 1)
        overall = (np.bincount(c, minlength=CLASSES) + 0.5) / (len(c) + CLASSES / 2)
        net.w["follow"] = np.log((follow + 4 * overall) / (follow.sum(1, keepdims=True) + 4)).astype(np.float32)
        net.w["share"] = np.log((share + 0.2) / (share.sum(1, keepdims=True) + 0.2 * MEMBERS)).astype(np.float32)
    rng, w, a, b, t = np.random.default_rng(5), dict(net.w), {}, {}, 0
    total = rounds * max(1, len(own) // batch)
    for _ in range(rounds if len(own) else 0):
        for part in np.array_split(rng.permutation(len(own)), max(1, len(own) // batch)):
            t += 1
            speed = rate * (1 - 0.9 * t / (total + 1))
            for name, g in _gradients(w, before[part], mask[part], own[part], target[part], place[part] >= 0, Network(w).bias()).items():
                if name not in a:
                    a[name], b[name] = np.zeros_like(w[name]), np.zeros_like(w[name])
                a[name] *= 0.9
                a[name] += 0.1 * g
                b[name] *= 0.99
                g *= g
                b[name] += 0.01 * g
                by = np.sqrt(b[name] / (1 - 0.99**t))
                by += 1e-7
                w[name] = w[name] - speed / (1 - 0.9**t) * a[name] / by
    return Network(w, net.kinds)


def pieces(text: bytes) -> list[bytes]:
    """A text cut before words, into about CUT bytes each."""
    out, lo = [], 0
    while len(text) - lo > CUT:
        hi = max((text.rfind(c, lo, lo + CUT) for c in (b" ", b"\n")), default=-1)
        hi = lo + CUT if hi <= lo else hi
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def ids_of(units: Units, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of lower-cased texts, each with its end, and where each text begins."""
    w = words(texts)
    ids, sizes = units.segment(w.data, w.start, w.end)
    stop = np.concatenate(([0], np.cumsum(sizes)))[w.first]
    return np.insert(ids, stop[1:], np.int16(END)), stop + np.arange(len(stop))


def is_held_out(doc: int) -> bool:
    return zlib.crc32(str(doc).encode()) % 5 == 1


class _Block:
    """A block's texts with their tokens, and its different tokens by hash."""

    def __init__(self, blob: bytes, ranges: int, kinds: np.ndarray):
        self.ids, self.null, texts = unpack_texts(blob)
        texts = [t.lower() for t in texts]
        self.words = words(texts)
        n = np.diff(self.words.first)
        self.sizes = n + 1
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.is_word = np.ones(int(self.first[-1]), dtype=bool)
        self.is_word[self.first[1:] - 1] = False
        self.words.hashes()
        self.hash, number = np.unique(np.append(self.words.table[:, 0], END_HASH), return_inverse=True)
        self.of = np.full(len(self.is_word), number[-1])
        self.of[self.is_word] = number[self.words.of]
        self.where = np.empty(len(self.hash), dtype=np.int64)
        self.where[self.of[::-1]] = np.arange(len(self.of))[::-1]  # the first place of each
        self.held = np.array([is_held_out(i) for i in self.ids.tolist()]) & ~self.null
        kind = np.array([int((byte_pairs(t) @ kinds).argmax()) for t in texts], dtype=np.int64)
        learned = np.repeat(~self.held & ~self.null, self.sizes)
        cell = np.repeat(kind, self.sizes)[learned] * len(self.hash) + self.of[learned]
        self.learned = np.bincount(cell, minlength=CLUSTERS * len(self.hash)).reshape(CLUSTERS, -1)
        self.bounds = np.searchsorted(self.hash, np.array([(k << 64) // ranges for k in range(ranges)], dtype=np.uint64))
        self.bounds = np.append(self.bounds, len(self.hash))

    def sent(self) -> Iterator[tuple[int, bytes]]:
        for k in range(len(self.bounds) - 1):
            part = slice(self.bounds[k], self.bounds[k + 1])
            yield k, zstandard.compress(np.diff(self.hash[part], prepend=np.uint64(0)).tobytes() + self.learned[:, part].astype("<u4").tobytes(), 1)


def _count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Counts over the corpus of the tokens of one range, told to each block, after the number of different tokens and the tokens of each kind of text."""
    hashes, counts = [], []
    for blob in rows["blob"]:
        raw = zstandard.decompress(blob)
        n = len(raw) // (8 + 4 * CLUSTERS)
        hashes.append(np.cumsum(np.frombuffer(raw, dtype="<u8", count=n), dtype=np.uint64))
        counts.append(np.frombuffer(raw, dtype="<u4", offset=8 * n).reshape(CLUSTERS, n))
    bounds = np.cumsum([0, *map(len, hashes)])
    known, of = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros((CLUSTERS, len(known)), dtype=np.int64)
    for lo, hi, c in zip(bounds[:-1], bounds[1:], counts, strict=True):
        total[:, of[lo:hi]] += c  # a block's tokens are different ones
    head = np.array([int((total.sum(0) > 0).sum()), *total.sum(1)], dtype="<i8")
    told = [np.concatenate((head, total[:, of[lo:hi]].ravel())) for lo, hi in zip(bounds, bounds[1:])]
    return pd.DataFrame({"block": rows["block"], "range": key[0], "blob": list(map(pack_array, told))})


def fit(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, every: int = 1, n_chars: int | None = None) -> Network:
    """Train the network: it starts from pieces of about `sample` characters, and then learns from one in `every` pieces of all training texts (by default from all)."""
    path, spark = path or default_vocabulary(), docs.sparkSession
    n_chars = characters(docs, text_col) if n_chars is None else n_chars
    train_docs = docs.where(fold(id_col, 5) != 1).select(id_col, text_col)

    def chosen(batches: Iterator[pa.RecordBatch], share: float, whole: int = 0) -> Iterator[bytes]:
        for rows in rows_by_bytes(batches, text_col):
            for i, t in rows:
                text = (t or "").encode().lower()
                for k, part in enumerate([text] if len(text) <= whole else pieces(text)):
                    if zlib.crc32(f"{i} {k}".encode()) < share * 2**32:
                        yield part

    def first_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chosen(batches, 1.25 * sample / max(1, n_chars), sample // 10):
            yield arrow_batch({"piece": ([part], pa.binary())})

    texts = sorted(bytes(r[0]) for r in train_docs.mapInArrow(first_pieces, "piece binary").collect())
    net = train(*ids_of(Units(path), texts))
    net.kinds = find_kinds(texts)
    known = spark.sparkContext.broadcast(net)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLUSTERS, PAIRS), dtype=np.int64)
        for rows in rows_by_bytes(batches, text_col):
            for _, t in rows:
                pairs = byte_pairs((t or "").encode().lower())
                total[int((pairs @ known.value.kinds).argmax())] += pairs
        yield arrow_batch({"kind": (list(range(CLUSTERS)), pa.int32()), "pairs": (list(total), pa.list_(pa.int64()))})

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": [key[0]], "pairs": [np.sum(rows["pairs"].to_list(), axis=0)]})

    # a kind is told by all training texts that the first round's kinds deal to it; its task sums one row a task of the scan
    counted = train_docs.where(F.col(text_col).isNotNull()).mapInArrow(kinds, "kind int, pairs array<long>").groupBy("kind").applyInPandas(summed, "kind int, pairs array<long>").toPandas()

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(mine: list[bytes]) -> pa.RecordBatch:
            ids, first = ids_of(_units(path), mine)
            w = train(ids, first, rounds=1, rate=0.003, net=known.value).w
            return arrow_batch({"n": ([len(ids)], pa.int64()), "w": ([np.concatenate([w[k].ravel() for k in sorted(w)]).astype("<f4").tobytes()], pa.binary())})

        mine, held = [], 0
        for part in chosen(batches, 1 / every):
            mine.append(part)
            held += len(part)
            if held > sample:
                yield shard(mine)
                mine, held = [], 0
        if mine:
            yield shard(mine)

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy(dtype=float)
        w = sum(np.frombuffer(b, dtype="<f4").astype(float) * x for b, x in zip(rows["w"], n, strict=True)) / n.sum()
        return pd.DataFrame({"n": [int(n.sum())], "w": [w.astype("<f4").tobytes()]})

    # means of means: groups of weights first, so that neither a task nor the driver gets those of all shards
    shards = train_docs.mapInArrow(go_on, "n long, w binary")
    some = shards.groupBy(F.pmod(F.xxhash64("w"), F.lit(64)).alias("part")).applyInPandas(mean, "n long, w binary").toPandas()
    if len(some):
        flat, at = np.frombuffer(mean((), some)["w"][0], dtype="<f4"), 0
        for k in sorted(net.w):
            net.w[k] = flat[at : at + net.w[k].size].reshape(net.w[k].shape).copy()
            at += net.w[k].size
    if len(counted):
        c = np.array(counted.sort_values("kind")["pairs"].to_list(), dtype=float) + 0.05
        net.kinds = np.log(c / c.sum(1, keepdims=True)).T
    return net


def score(docs: DataFrame, net: Network, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", mix: tuple[float, float, float, float] = MIX, n_chars: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    path = path or default_vocabulary()
    n_chars = characters(docs, text_col) if n_chars is None else n_chars
    ranges = max(1, n_chars // LETTERS // RANGE)
    dealt = blocks(docs, max(ranges, 2 * docs.sparkSession.sparkContext.defaultParallelism, n_chars // (16 << 20)), id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(net)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sent = list(_Block(row["texts"], ranges, known.value.kinds).sent())
                yield arrow_batch({"block": ([row["block"]] * len(sent), pa.int64()), "range": ([k for k, _ in sent], pa.int32()), "blob": ([b for _, b in sent], pa.binary())})

    def judge(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = _Block(left["texts"].iloc[0], ranges, known.value.kinds)
        told = [unpack_array(x, "<i8") for x in right.sort_values("range")["blob"]]
        v, *of_kind = sum(x[: CLUSTERS + 1] for x in told).tolist()
        c_kind = np.concatenate([x[CLUSTERS + 1 :].reshape(CLUSTERS, -1) for x in told], 1)
        c, n = c_kind.sum(0), sum(of_kind)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[b.of]
        known_part, own_part = mix[0] + mix[1], mix[2] + mix[3]
        overall = mix[1] / known_part * c / max(1, n)
        shares = [(np.log10(m / n), mix[0] / known_part * c_kind[k] / m + overall) for k, m in enumerate(of_kind) if m] or [(0.0, overall)]
        # ids of the different tokens, then of all tokens
        number = np.cumsum(b.is_word) - 1  # of the word at each token
        real = b.is_word[b.where]
        at = number[b.where[real]]
        ids, n_ids = _units(path).segment(b.words.data, b.words.start[at], b.words.end[at])
        sizes = np.ones(len(b.where), dtype=np.int64)
        sizes[real] = n_ids
        begin = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), END, dtype=np.int16)
        flat[np.repeat(real, sizes)] = ids
        by_text = []
        for lo, hi in _portions(b.first):
            of = b.of[b.first[lo] : b.first[hi]]
            m = sizes[of]
            at = np.cumsum(m) - m
            ids = flat[np.repeat(begin[of] - at, m) + np.arange(int(m.sum()))]
            starts = np.append(at, len(ids))[b.first[lo : hi + 1] - b.first[lo]]
            spelled = np.exp(np.add.reduceat(score_ids(known.value, ids, starts).astype(np.float64), at))
            begins = b.first[lo : hi + 1] - b.first[lo]
            own = (mix[2] * _so_far(of, begins) + mix[3] * spelled) / own_part
            kinds = np.array([prior + np.add.reduceat(np.log10(mixed(share[of], own, begins, known_part) + 1e-300), begins[:-1]) for prior, share in shares])
            top = kinds.max(0)
            by_text.append(top + np.log10((10 ** (kinds - top)).sum(0)))
        starts = b.first[:-1]
        return pd.DataFrame({
            id_col: pd.arrays.IntegerArray(b.ids.copy(), b.null.copy()), "held_out": pd.arrays.BooleanArray(b.held, b.null.copy()),
            "n_tokens": b.sizes, "n_known": np.add.reduceat((c > 0)[b.of].astype(np.int64), starts), "train_tokens": n,
            "base_score": np.add.reduceat(base, starts), "score": np.concatenate(by_text),
        })

    counts = dealt.mapInArrow(send, "block long, range int, blob binary").groupBy("range").applyInPandas(_count, "block long, range int, blob binary")
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(judge, schema)


def mixed(counts: np.ndarray, own: np.ndarray, first: np.ndarray, share: float) -> np.ndarray:
    """Probability of each token by what counts say and what the network and the text itself say: the weight of the first begins as `share` and follows its part in the text's tokens before."""
    start, sizes = first[:-1], np.diff(first)
    part = share * counts
    part /= part + (1 - share) * own + 1e-300
    weight = np.cumsum(part)
    weight -= part  # of the tokens before
    weight -= np.repeat(weight[start], sizes)
    weight += PRIOR * share
    weight /= PRIOR + np.arange(len(part)) - np.repeat(start, sizes)
    weight *= counts - own
    return weight + own


def _so_far(of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token its share among the tokens of its text before it."""
    sizes = np.diff(first)
    pos = np.arange(len(of)) - np.repeat(first[:-1], sizes)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(of.max()) + 1) + of
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    rank = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
    out = np.empty(len(of))
    out[order] = rank
    return out / np.maximum(1, pos)


def _portions(first: np.ndarray, tokens: int = 200_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many tokens."""
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + tokens, side="right")) - 1)
        yield lo, hi
        lo = hi


_UNITS: dict[str, Units] = {}


def _units(path: str) -> Units:
    if path not in _UNITS:
        _UNITS[path] = Units(path)
    return _UNITS[path]
