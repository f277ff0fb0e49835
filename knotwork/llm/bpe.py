"""BPE encoding and decoding by speculation and verification.

Every white-space separated chunk is normalised and split as the tokenizer file says.  For words not
met before, a greedy longest match proposes tokens.  A sequence of tokens is what exact merging gives
if and only if every adjacent pair of it is what exact merging gives for that pair alone: the first
merge that crossed a border would also be the first to cross it between those two tokens.  All adjacent
pairs of a batch of words are tested at once against a table of known pairs; words with a failing pair
are merged exactly, in about n log n steps for a word of n letters.

Defined results: a null text is encoded like an empty one (no ids, empty decoded text); texts and words of
any length are encoded whole; repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_batch, rows_by_bytes, sha256

#: Words and pairs that a task remembers; beyond it, it starts anew.  Longer words are not remembered.
MAX_WORDS, MAX_PAIRS, LONG = 300_000, 300_000, 200
_CONTROL = re.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(r"[^\p{White_Space}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Codec:
    """A tokenizer of the kind of word_bpe_49k.json: NFC, white space, lower case; byte letters; word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: rank and result of merging a pair, in one integer
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = _byte_letters()
        #: length of the longest token that begins with these two letters
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.widest = max(self.reach.values())
        self.span = 1 << 20
        #: ids, packed, of known chunks and of known words in byte letters
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.stats = {"words": 0, "exact": 0}

    # exact merging

    def symbols(self, token: str) -> list[int]:
        """The ids that a token is merged from."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + self.end]]
        return [self.vocab[c] for c in token]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left.

        Pairs wait in a heap by rank and place, and the ids are a linked list, so that a word of n letters takes
        about n log n steps.
        """
        get, ids, n = self.merges.get, list(ids), len(ids)
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got, k) for k in range(n - 1) if (got := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapify(heap)
        while heap:
            best, k = heappop(heap)
            j = behind[k]
            if ids[k] < 0 or j >= n or get(ids[k] << 20 | ids[j]) != best:
                continue  # one of the two has been merged since
            ids[k], ids[j], behind[k] = best & 0xFFFFF, -1, behind[j]
            if (right := behind[k]) < n:
                before[right] = k
                if (got := get(ids[k] << 20 | ids[right])) is not None:
                    heappush(heap, (got, k))
            if (left := before[k]) >= 0 and (got := get(ids[left] << 20 | ids[k])) is not None:
                heappush(heap, (got, left))
        return [i for i in ids if i >= 0]

    # speculation

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over a word in byte letters."""
        get, reach, out, i = self.vocab.get, self.reach.get, [], 0
        word += self.end
        n, last = len(word), len(word) - len(self.end)
        while i < last:
            if n - i <= self.widest and (got := get(word[i:])) is not None:
                out.append(got)
                break
            j = min(last - 1, i + reach(word[i : i + 2], 1))
            while (got := get(word[i:j])) is None:
                j -= 1
            out.append(got)
            i = j
        return out

    def pair_ok(self, code: int) -> bool:
        got = self.pairs.get(code)
        if got is None:
            a, b = divmod(code, self.span)
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            if a == self.span - 1:  # a token alone
                got = self.merge(self.symbols(self.name[b])) == [b]
            else:
                got = self.merge(self.symbols(self.name[a]) + self.symbols(self.name[b])) == [a, b]
            self.pairs[code] = got
        return got

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words given in byte letters."""
        guess = [self.propose(w) for w in words]
        sizes = np.array([len(g) for g in guess], dtype=np.int64)
        flat = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(sizes.sum()))
        first = np.zeros(len(flat), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[first] = self.span - 1
        codes, where = np.unique(before * self.span + flat, return_inverse=True)
        good = np.fromiter(map(self.pair_ok, codes.tolist()), dtype=bool, count=len(codes))[where]
        # the first token of a longer word is tested by its pair
        alone = np.repeat(sizes == 1, sizes)
        bad = ~good & (~first | alone)
        failed = np.unique(np.repeat(np.arange(len(words)), sizes)[bad])
        self.stats["words"] += len(words)
        self.stats["exact"] += len(failed)
        for k in failed.tolist():
            w = words[k]
            guess[k] = self.merge([self.vocab[c] for c in w[:-1]] + [self.vocab[w[-1] + self.end]])
        return guess

    # texts

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if _CONTROL.search(text) else text.split()

    def _pieces(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        letters = self.letters
        return ["".join([letters[b] for b in p.encode()]) for p in self.split.findall(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks not met before."""
        new = list(chunks)
        parts = [self._pieces(c) for c in new]
        if len(self.pieces) > MAX_WORDS:
            self.pieces.clear()
        words = list({p for ps in parts for p in ps}.difference(self.pieces))
        self.pieces.update(zip(words, [pack(f"<{len(w)}I", *w) for w in self.encode_words(words)], strict=True))
        known = self.pieces
        for chunk, ps in zip(new, parts, strict=True):
            self.words[chunk] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
        for p in words:
            if len(p) > LONG:
                del known[p]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        """For each text its ids as little-endian 32-bit integers, the decoded text and the number of ids."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        split = []
        for t in texts:
            parts = self.cut.split(t) if self.cut and "<|" in t else [t]
            split.append([p if p in self.special else self.chunks(p) for p in parts])
        self.learn(set().union(*(cs for parts in split for cs in parts if isinstance(cs, list))).difference(self.words))
        out, ids_of = [], self.words.__getitem__
        for parts in split:
            ids = b"".join([pack("<I", self.special[p]) if isinstance(p, str) else b"".join(map(ids_of, p)) for p in parts])
            out.append((ids, self.decode(np.frombuffer(ids, dtype="<u4").tolist()), len(ids) // 4))
        for c in {c for parts in split for cs in parts if isinstance(cs, list) for c in cs if len(c) > LONG}:
            del self.words[c]
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by one space."""
        return " ".join(map(self.name.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The task's codec; its tables and known words are kept while the worker lives."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rows in rows_by_bytes(batches, text_col):
            got = c.encode([t or "" for _, t in rows])
            yield arrow_batch({
                id_col: ([i for i, _ in rows], pa.int64()),
                "ids": ([np.frombuffer(a, dtype="<u4").astype("i4") for a, _, _ in got], pa.list_(pa.int32())),
                "decoded": ([b for _, b, _ in got], pa.string()),
            })

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text; like encode(), but only digests leave the task."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rows in rows_by_bytes(batches, text_col):
            got = c.encode([t or "" for _, t in rows])
            yield arrow_batch({
                id_col: ([i for i, _ in rows], pa.int64()),
                "n_tokens": ([n for _, _, n in got], pa.int64()),
                "ids_sha256": ([sha256(a) for a, _, _ in got], pa.string()),
                "decoded_sha256": ([sha256(b.encode()) for _, b, _ in got], pa.string()),
            })

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
