"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Three patterns give the base findings, which always stay.  Every run of 16 or more characters of keys that
has a letter and is not wholly within base findings is a candidate; a small convolutional network in numpy
reads all of it with the characters around it, a long one in overlapping windows and by its parts between
separators, of which the likeliest counts.  The network is trained on labelled findings (a parameter; by default a seeded
set of made-up keys and of look-alikes such as addresses, numbers, versions and paths), its output is
calibrated on held-out findings by Platt scaling, and the threshold lies between the highest one that keeps
the wanted recall there and the likeliest look-alike below it.

Defined results: a null text is an empty one without findings; texts are scanned whole; findings are in
code points with exclusive ends; repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batch, per_batch, rows_by_bytes, sha256

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # whole runs
_WORDS = ("passw", "secret", "token", "api")
_RUN, _PART = re.compile(r"[A-Za-z0-9+/_.=-]{16,}"), re.compile(r"[^/.=]{16,}")
#: Shortest candidate, characters before it that the network sees, and all that it sees.
LEAST, BEFORE, WIDTH = 16, 20, 72
#: Step of the windows of a long candidate, and how much of it the last one has, with as much room behind as before.
STEP, LAST = 26, WIDTH - 2 * BEFORE

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Findings of the patterns, by start and then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of key characters with a letter that are not wholly within the spans taken."""
    out, first = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".=-":  # the end of a sentence
            end -= 1
        if end - start < LEAST or not any(c.isalpha() for c in text[start:end]):
            continue
        while first < len(taken) and taken[first][2] <= start:  # runs and spans go on together
            first += 1
        at = start
        for k in range(first, len(taken)):  # by start
            _, s, e = taken[k]
            if s > at:
                break
            at = max(at, e)
        if at < end:
            out.append((start, end))
    return out


def _windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What of a candidate the network reads at once: from its beginning, every STEP characters, its last ones, its parts."""
    starts = {start}
    if end - start > LAST:
        starts |= {*range(start, end - LAST, STEP), end - LAST}
    parts = {(start + m.start(), start + m.end()) for m in _PART.finditer(text[start:end])} if end - start > LAST else set()
    return sorted({(s, end) for s in starts} | parts)


def _codes(items: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """What the network sees: character codes 0 to 97 and whether each belongs to the candidate."""
    chars, mask = np.zeros((len(items), WIDTH), dtype=np.int64), np.zeros((len(items), WIDTH), dtype=np.float32)
    for k, (text, start, end) in enumerate(items):
        lo = start - BEFORE
        part = text[max(0, lo) : lo + WIDTH]
        chars[k, max(0, -lo) : max(0, -lo) + len(part)] = [ord(c) - 30 if 32 <= ord(c) < 127 else 1 if c == "\n" else 97 for c in part]
        mask[k, BEFORE : min(WIDTH, BEFORE + end - start)] = 1
    return chars, mask


@dataclass
class Network:
    """Embedding, one convolution over the candidate and its surroundings, largest values, one linear layer."""

    seed: int = 7
    dim: int = 8
    filters: int = 24
    width: int = 5
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> None:
        g = np.random.default_rng(self.seed)
        self.w = {
            "emb": g.normal(0, 0.3, (98, self.dim)), "conv": g.normal(0, 0.2, (self.width * (self.dim + 1), self.filters)),
            "bias": np.zeros(self.filters), "out": g.normal(0, 0.2, 2 * self.filters), "top": np.zeros(1),
        }

    def forward(self, chars: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = np.concatenate([self.w["emb"][chars], mask[..., None]], 2)
        n, t, d = x.shape
        s = np.lib.stride_tricks.sliding_window_view(x, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, t - self.width + 1, self.width * d)
        h = np.maximum(0, s @ self.w["conv"] + self.w["bias"])
        inside = mask[:, self.width // 2 : t - self.width // 2]
        share = inside / np.maximum(1, inside.sum(1, keepdims=True))
        best = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, best[:, None], 1)[:, 0], (h * share[..., None]).sum(1)], 1)
        return pooled @ self.w["out"] + self.w["top"], (s, h, share, best, pooled, x.shape)

    def step(self, chars: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        z, (s, h, share, best, pooled, shape) = self.forward(chars, mask)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        dp = dz[:, None] * self.w["out"]
        f = self.filters
        dh = dp[:, None, f:] * share[..., None]
        np.put_along_axis(dh, best[:, None], np.take_along_axis(dh, best[:, None], 1) + dp[:, None, :f], 1)
        dh = dh * (h > 0)
        ds = (dh @ self.w["conv"].T).reshape(shape[0], -1, self.width, shape[2])
        dx = np.zeros(shape)
        for j in range(self.width):
            dx[:, j : j + ds.shape[1]] += ds[:, :, j]
        emb = np.zeros_like(self.w["emb"])
        np.add.at(emb, chars, dx[..., : self.dim])
        return {"emb": emb, "conv": np.tensordot(s, dh, ((0, 1), (0, 1))), "bias": dh.sum((0, 1)), "out": dz @ pooled, "top": dz.sum(keepdims=True)}

    def probability(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(items) + self.shift)))

    def logits(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """The largest output for the windows of each candidate."""
        out = np.full(len(items), -np.inf)
        part: list[tuple[int, tuple[str, int, int]]] = []

        def read() -> None:
            np.maximum.at(out, [k for k, _ in part], self.forward(*_codes([x for _, x in part]))[0])
            part.clear()

        for k, (text, start, end) in enumerate(items):
            for s, e in _windows(text, start, end):
                part.append((k, (text, s, e)))
                if len(part) == 512:
                    read()
        if part:
            read()
        return out


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Made-up labelled findings: (text, start, end, 1 if a key)."""
    g = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda a, lo, hi: "".join(g.choices(a, k=g.randint(lo, hi)))
    syl = ["er", "on", "the", "an", "in", "de", "que", "la", "en", "sch", "ung", "ion", "ment", "os", "ado", "re", "st", "ou", "le", "ver"]
    word = lambda: "".join(g.choices(syl, k=g.randint(1, 4)))
    sep = lambda: g.choice("._-/")
    keys = [
        lambda: g.choice(["ghp_", "gho_", "sk-", "sk_live_", "pk_live_", "xoxb-", "glpat-", "AIza", "npm_"]) + pick(low + up + dig, 20, 44),
        lambda: pick(low + up + dig, 20, 48), lambda: pick(low + up + dig + "+/", 24, 60) + g.choice(["", "=", "=="]), lambda: pick(up + dig, 18, 32),
        lambda: pick("0123456789ABCDEF", 24, 64), lambda: ".".join(["eyJ" + pick(low + up + dig + "_-", 12, 30), pick(low + up + dig + "_-", 16, 40), pick(low + up + dig + "_-", 16, 43)]),
    ]
    others = [
        lambda: f"{word()}.{pick(dig, 1, 2)}.{word()}.example.{g.choice(['com', 'org', 'net'])}", lambda: f"mail{pick(dig, 1, 3)}.{word()}.{g.choice(['com', 'example.com', 'org'])}",
        lambda: f"{word()}/{word()}/{pick(dig, 1, 4)}/{word()}.html", lambda: "-".join([pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)]), lambda: f"{g.randint(1990, 2030)}-{g.randint(10, 12)}-{g.randint(10, 28)}T{g.randint(10, 23)}",
        lambda: sep().join([word(), word(), pick(dig, 1, 4), word()]), lambda: f"{word()}{word()}{word()}{word()}{pick(dig, 1, 3)}", lambda: f"v{g.randint(0, 9)}.{g.randint(0, 20)}.{g.randint(0, 20)}-{word()}.{g.randint(0, 99)}", lambda: f"{word()}_{word()}_{pick(dig, 1, 5)}_{word()}",
    ]
    before = ["", "key: ", "Authorization: Bearer ", 'client_secret="', "export KEY=", "credential ", "private key "]
    out = []
    for k in range(n):
        label = k % 2
        body = g.choice(keys if label else others)()
        while len(body) < LEAST:
            body += g.choice([lambda: pick(low + dig, 4, 9), lambda: pick(low + up + dig, 6, 9)])() if label else sep() + word()
        if g.random() < 0.1:  # some have no digit
            body = "".join(g.choice(low) if c in dig else c for c in body)
        elif not any(map(str.isdigit, body)):
            body = body[:-1] + g.choice(dig)
        lead = " ".join(word() for _ in range(g.randint(0, 8))) + g.choice([" ", "\n", " "]) + (g.choice(before) if g.random() < (0.5 if label else 0.15) else "")
        text = lead + body + g.choice(["", " ", '" ', ". ", ", "]) + " ".join(word() for _ in range(g.randint(0, 6)))
        out.append((text, len(lead), len(lead) + len(body), label))
    return out


def train(findings: list[tuple[str, int, int, int]] | None = None, recall: float = 0.97, rounds: int = 12) -> Network:
    """Fit on three quarters of the findings (of each eight in order, the first six); calibrate and choose the threshold on the rest."""
    findings = findings if findings is not None else labelled_findings()
    net = Network()
    net.start()
    y = np.array([f[3] for f in findings], dtype=np.float64)
    held = np.arange(len(y)) // 2 % 4 == 3
    if not len(y) or len(set(y[~held])) < 2:
        net.threshold = 2.0  # nothing to learn from: the network adds no finding
        return net
    # all windows of a candidate have its label; each is also shown as a part of a longer run
    within = [(t[:s].replace(" ", "/") + t[s:e] + t[e:].replace(" ", "/"), s, e, label) for t, s, e, label in findings]
    seen = [((f[0], s, e), f[3]) for f, out in zip(findings, held, strict=True) if not out for s, e in _windows(*f[:3])]
    seen += [(f[:3], f[3]) for f, out in zip(within, held, strict=True) if not out]
    chars, mask = _codes([x for x, _ in seen])
    label, fit = np.array([x for _, x in seen], dtype=np.float64), np.arange(len(seen))
    g, m, v, t = np.random.default_rng(net.seed), {}, {}, 0
    for _ in range(rounds):
        for part in np.array_split(g.permutation(fit), max(1, len(fit) // 64)):
            t += 1
            for k, d in net.step(chars[part], mask[part], label[part]).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                net.w[k] = net.w[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    z, yy = net.logits([f[:3] for x in (findings, within) for f, out in zip(x, held, strict=True) if out]), np.tile(y[held], 2)
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt scaling
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.05 * float(((p - yy) * z).mean()), b - 0.5 * float((p - yy).mean())
    net.scale, net.shift = a, b
    p = 1 / (1 + np.exp(-(a * z + b)))
    keys = np.sort(p[yy == 1])
    if len(keys):
        most = float(keys[int((1 - recall) * len(keys))])
        # halfway to the next look-alike: no more of these are found, and keys less like those seen are
        net.threshold = (most + float(p[(yy == 0) & (p < most)].max(initial=0.0))) / 2
    return net


def scan(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base findings and all findings."""
    base = [base_spans(t) for t in texts]
    more = [(k, s, e) for k, t in enumerate(texts) for s, e in candidates(t, base[k])]
    added: list[list[Span]] = [[] for _ in texts]
    for at in range(0, len(more), 512):
        part = more[at : at + 512]
        for (k, s, e), p in zip(part, net.probability([(texts[k], s, e) for k, s, e in part]).tolist(), strict=True):
            if p >= net.threshold:
                added[k].append(("model", s, e))
    return [(b, sorted([*b, *a], key=lambda s: (s[1], KINDS.index(s[0])))) for b, a in zip(base, added, strict=True)]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each finding, or each union of overlapping ones, replaced by [SECRET]."""
    out, at, end = [], 0, 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s], "[SECRET]"]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, redacted): findings of every whole text and the text without them (null for null)."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, text_col):
            found = scan(known.value, [t or "" for _, t in rows])
            count = lambda kind: ([sum(s[0] == kind for s in b) for b, _ in found], pa.int64())
            yield arrow_batch({
                id_col: ([i for i, _ in rows], pa.int64()), "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
                "base_sha256": ([sha256(_written(b).encode()) for b, _ in found], pa.string()),
                "spans": ([_written(a) for _, a in found], pa.string()),
                "redacted": ([t if t is None else redact(t, a) for (_, t), (_, a) in zip(rows, found, strict=True)], pa.string()),
            })

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def redacted(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the findings in the text replaced; null stays null."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def change(texts: list) -> tuple[list[bool], list]:
        found = scan(known.value, [t or "" for t in texts])
        return [True] * len(texts), [t if t is None else redact(t, a) for t, (_, a) in zip(texts, found, strict=True)]

    return per_batch(docs, text_col, change)
