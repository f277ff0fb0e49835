"""Media columns: FLAC streams of 8-bit mono samples, written and read with numpy.

Frames hold 192 samples.  The writer chooses per frame among a constant, plain samples, fixed predictors
of order 0 to 2 and a quantised linear predictor of order 2, with Rice-coded residuals.  Every stream
starts with STREAMINFO (sizes, count, MD5) and a SEEKTABLE with one point for each SEEK_FRAMES frames, so
that a reader can begin at any of these sample offsets.  The reader decodes many seek segments in step,
one sample of each at a time: Rice residuals, predictors of any order, then CRC-8 of each header and
CRC-16 of each frame; a wrong sum raises an error.

Defined results: a null text is an empty one; every payload is padded with spaces to a positive multiple
of 192 bytes, so an empty text gives one constant frame; equal texts give equal streams; texts of any
length are stored whole, and frames are coded in groups of bounded size, so that a task holds a few copies of a text's
bytes and nothing that is many times as large; other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batch, rows_by_bytes, sha256

FRAME, SEEK_FRAMES, RATE = 192, 8, 8000
#: Bits of a linear predictor's coefficient, and its shift.
PRECISION, SHIFT = 10, 8
#: Frames that are coded at once, so that memory does not grow with the length of a text.
GROUP = 1 << 14
_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], dtype=np.int64)


def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return table.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_ZEROS16 = np.array([16] + [16 - k.bit_length() for k in range(1, 1 << 16)], dtype=np.uint8)


class FlacError(ValueError):
    """A stream whose sync code, block size or checksum is wrong."""


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of slices of data, in step."""
    order = np.argsort(-size, kind="stable")
    begin, n = start[order], size[order]
    crc = np.zeros(len(order), dtype=np.uint16)
    live = len(order) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), side="right")
    for k, m in enumerate(live.tolist()):
        byte = data[begin[:m] + k]
        if bits == 8:
            crc[:m] = table[crc[:m] ^ byte]
        else:
            crc[:m] = (crc[:m] << 8) ^ table[(crc[:m] >> 8) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _put(out: np.ndarray, pos: np.ndarray, value: np.ndarray, bits: np.ndarray | int) -> None:
    """Add values of up to 17 bits at bit positions of a zeroed byte buffer."""
    byte, room = pos >> 3, 24 - bits - (pos & 7)
    word = value << room
    n = int(byte[-1]) + 3 if len(byte) else 0
    for k in range(3):
        part = word >> (16 - 8 * k) & 255
        out[k : n + k - 2] += np.bincount(byte, weights=part, minlength=n - 2).astype(np.uint8)


def _predictions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of the best predictor of each frame, its kind (0 to 2 fixed, 3 linear) and linear coefficients."""
    d = [x]
    for k in (1, 2):
        r = x.copy()
        r[:, k:] = d[-1][:, k:] - d[-1][:, k - 1 : -1]
        d.append(r)
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    safe = np.where(det <= 1e-6, 1, det)
    a = np.stack([(r1 * r0 - r1 * r2) / safe, (r0 * r2 - r1 * r1) / safe], 1)
    a[det <= 1e-6] = 0
    coef = np.clip(np.rint(a * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    lpc = x.copy()
    lpc[:, 2:] -= (coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> SHIFT
    tries = [*d, lpc]
    cost = np.stack([np.abs(t[:, 2:]).sum(1) for t in tries], 1)
    cost[:, 3] += 8  # its coefficients take room
    kind = cost.argmin(1)
    best = tries[0]
    for k in (1, 2, 3):
        best = np.where((kind == k)[:, None], tries[k], best)
    return best, kind, coef


def _number_bytes(n: int) -> bytes:
    """A frame number in the UTF-8 manner, up to 31 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(m for m in range(1, 6) if n < 1 << (5 * m + 6))
    return bytes([0xFF00 >> (more + 1) & 0xFF | n >> 6 * more, *(0x80 | n >> 6 * m & 0x3F for m in range(more - 1, -1, -1))])


_NUMBERS: list[bytes] = []


def _frame_numbers(n: int) -> list[bytes]:
    while len(_NUMBERS) < n:
        _NUMBERS.append(_number_bytes(len(_NUMBERS)))
    return _NUMBERS


def _frames(raw: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames (a row of samples each) of given numbers in their streams, and the bytes of each."""
    x = raw.astype(np.int32) - 128
    frames = len(x)
    res, kind, coef = _predictions(x)
    order = np.array([0, 1, 2, 2])[kind]
    fold = (res << 1) ^ (res >> 31)
    t = np.arange(FRAME)
    fold[t < order[:, None]] = 0
    n_res = FRAME - order
    mean = fold.sum(1) / n_res
    k = np.maximum(0, np.floor(np.log2(np.maximum(mean, 1e-9)))).astype(np.int64)
    k = np.clip(np.maximum(k, np.frexp(fold.max(1).astype(np.float64))[1] - 5), 0, 14)
    quot = fold.astype(np.int64) >> k[:, None]
    head = 8 + 8 * order + 10 + np.where(kind == 3, 9 + 2 * PRECISION, 0)
    size = head + quot.sum(1) + n_res * (k + 1)
    constant = (x == x[:, :1]).all(1)
    plain = ~constant & (size >= 8 + 8 * FRAME)
    rice = ~constant & ~plain
    size = np.where(constant, 16, np.where(plain, 8 + 8 * FRAME, size))
    different, number = np.unique(number, return_inverse=True)
    names = _frame_numbers(int(different[-1]) + 1)
    names = [names[i] for i in different.tolist()]
    n_name = np.array([len(n) for n in names])[number]
    body = 5 + n_name
    whole = body + (size + 7 >> 3) + 2
    at = np.cumsum(whole) - whole
    out = np.zeros(int(whole.sum()) + 8, dtype=np.uint8)
    for j, b in enumerate((0xFF, 0xF8, 0x10, 0x02)):
        out[at + j] = b
    widest = int(n_name.max())
    codes = np.frombuffer(b"".join(n.ljust(widest, b"\0") for n in names), dtype=np.uint8).reshape(-1, widest)
    for j in range(widest):
        m = n_name > j
        out[at[m] + 4 + j] = codes[number[m], j]
    out[at + 4 + n_name] = _crc(out, at, 4 + n_name, _CRC8, 8)
    sub = at + body
    out[sub[constant] + 1] = raw[constant, 0] ^ 0x80
    out[sub[plain]] = 0x02
    if plain.any():
        out[(sub[plain] + 1)[:, None] + t] = raw[plain] ^ 0x80
    r = np.flatnonzero(rice)
    if len(r):
        out[sub[r]] = np.where(kind[r] == 3, (0x20 | 1) << 1, (0x08 | order[r]) << 1)
        for j in (0, 1):
            m = r[order[r] > j]
            out[sub[m] + 1 + j] = raw[m, j] ^ 0x80
        pos = 8 * (sub + 1 + order)
        m = r[kind[r] == 3]
        if len(m):
            mask = (1 << PRECISION) - 1
            _put(out, pos[m], np.full(len(m), (PRECISION - 1) << 5 | SHIFT), 9)
            _put(out, pos[m] + 9, coef[m, 0].astype(np.int64) & mask, PRECISION)
            _put(out, pos[m] + 9 + PRECISION, coef[m, 1].astype(np.int64) & mask, PRECISION)
            pos[m] += 9 + 2 * PRECISION
        _put(out, pos[r], k[r], 10)  # method 0, partition order 0, parameter
        kk = k[r][:, None]
        real = t >= order[r][:, None]
        length = np.where(real, quot[r] + kk + 1, 0)
        begin = (pos[r] + 10)[:, None] + np.cumsum(length, 1) - length + quot[r]
        value = (1 << kk) | (fold[r].astype(np.int64) & ((1 << kk) - 1))
        _put(out, begin[real], value[real], np.broadcast_to(kk + 1, real.shape)[real])
    crc = _crc(out, at, whole - 2, _CRC16, 16)
    out[at + whole - 2], out[at + whole - 1] = crc >> 8, crc & 255
    return out[: int(whole.sum())].tobytes(), whole


def _md5(raw: np.ndarray, turned: bool = True) -> bytes:
    """MD5 of signed samples, of unsigned ones if turned."""
    h = hashlib.md5()
    flat = raw.reshape(-1)
    for a in range(0, len(flat), GROUP * FRAME):
        part = flat[a : a + GROUP * FRAME]
        h.update((part ^ 0x80 if turned else part).tobytes())
    return h.digest()


def write_streams(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, whose lengths are positive multiples of 192."""
    if not payloads:
        return []
    counts = np.array([len(p) // FRAME for p in payloads])
    raw = np.frombuffer(payloads[0] if len(payloads) == 1 else b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME)
    number = np.arange(len(raw)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [_frames(raw[a : a + GROUP], number[a : a + GROUP]) for a in range(0, len(raw), GROUP)]
    whole = np.concatenate([w for _, w in parts])
    at = np.cumsum(whole) - whole
    data = b"".join([d for d, _ in parts])
    parts.clear()
    streams, f = [], 0
    for p, c in zip(payloads, counts.tolist(), strict=True):
        sizes, offsets = whole[f : f + c], at[f : f + c] - at[f]
        info = pack(">HH", FRAME, FRAME) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + _md5(raw[f : f + c])
        points = b"".join(pack(">QQH", FRAME * j, int(offsets[j]), FRAME) for j in range(0, c, SEEK_FRAMES))
        blocks = b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        streams.append(b"fLaC" + blocks + data[at[f] : at[f] + int(sizes.sum())])
        f += c
    return streams


def _metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int]], int]:
    """Number of samples, MD5, seek points (sample, byte after the metadata) and where frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, total, digest, points = 4, False, 0, b"", []
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            total, digest = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [unpack(">QQ", body[j : j + 16]) for j in range(0, n, 18)]
        at += 4 + n
    return total, digest, points, at


class _Bits:
    """Bit reads at many positions of one buffer."""

    def __init__(self, data: np.ndarray):
        self.data = data
        b = data.astype(np.uint32)
        self.word = np.zeros(len(b), dtype=np.uint64)
        self.word[:-3] = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]

    def top(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position on, at the top of 64."""
        byte = pos >> 3
        return (self.word[byte] << np.uint64(32) | self.word[byte + 4]) << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, n: int) -> np.ndarray:
        return (self.top(pos) >> np.uint64(64 - n)).astype(np.int64)


def read_streams(streams: list[bytes]) -> list[bytes]:
    """Payloads of streams of write_streams(); checksums and MD5 are verified."""
    if not streams:
        return []
    metas = [_metadata(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    data = np.frombuffer(b"".join([*streams, bytes(64)]), dtype=np.uint8)
    begin, todo, into = [], [], []
    size = 0
    for (total, _, points, first), b in zip(metas, base[:-1].tolist(), strict=True):
        for j, (sample, offset) in enumerate(points):
            begin.append(b + first + offset)
            todo.append(((points[j + 1][0] if j + 1 < len(points) else total) - sample) // FRAME)
            into.append(size + sample)
        size += total
    begin, todo, into = np.array(begin), np.array(todo), np.array(into)
    number = (into - np.repeat(np.cumsum([0] + [m[0] for m in metas[:-1]]), [len(m[2]) for m in metas])) // FRAME
    # segments in groups of so many frames; a group's samples and bytes lie together
    done = np.cumsum(todo)
    cuts = [0, *(np.flatnonzero(np.diff((done - 1) // GROUP)) + 1).tolist(), len(todo)]
    pcm = np.empty(size, dtype=np.uint8)
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = int(begin[a]), int(begin[b]) if b < len(begin) else len(data) - 64
        first, last = int(into[a]), int(into[b - 1]) + int(todo[b - 1]) * FRAME
        pcm[first:last] = _segments(data[lo : hi + 64], begin[a:b] - lo, todo[a:b], into[a:b] - first, number[a:b])
    at, payloads = 0, []
    for total, digest, _, _ in metas:
        if _md5(pcm[at : at + total], False) != digest:
            raise FlacError("the MD5 of the samples is wrong")
        at += total
    pcm ^= 0x80
    at = 0
    for total, *_ in metas:
        payloads.append(pcm[at : at + total].tobytes())
        at += total
    return payloads


def _segments(data: np.ndarray, begin: np.ndarray, todo: np.ndarray, into: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Signed samples (as bytes) of segments: frames `todo` from byte `begin` on, the first of number `number`, for place `into`."""
    bits = _Bits(data)
    out = np.zeros(int(into[-1]) + int(todo[-1]) * FRAME, dtype=np.int16)
    pos = 8 * begin
    spans = []
    for j in range(int(todo.max())):
        lane = np.flatnonzero(todo > j)
        start = pos[lane] >> 3
        if not ((data[start] == 0xFF) & (data[start + 1] == 0xF8) & (data[start + 2] == 0x10) & (data[start + 3] == 0x02)).all():
            raise FlacError("unknown frame header")
        lead = data[start + 4]
        n_name = np.where(lead < 0x80, 1, _ZEROS16[(~lead).astype(np.uint16) << 8].astype(np.int64))
        got = np.where(lead < 0x80, lead, lead & (0x7F >> np.minimum(n_name, 7))).astype(np.int64)
        for i in range(1, int(n_name.max())):
            more = n_name > i
            got[more] = got[more] << 6 | data[start[more] + 4 + i] & 0x3F
        if (got != number[lane] + j).any():
            raise FlacError("a frame is missing")
        if (data[start + 4 + n_name] != _crc(data, start, 4 + n_name, _CRC8, 8)).any():
            raise FlacError("a header's checksum is wrong")
        sub = start + 5 + n_name
        kind = data[sub] >> 1
        target = into[lane] + FRAME * j
        end = np.zeros(len(lane), dtype=np.int64)
        m = kind == 0
        out[target[m][:, None] + np.arange(FRAME)] = data[sub[m] + 1].view(np.int8)[:, None]
        end[m] = 8 * (sub[m] + 2)
        m = kind == 1
        out[target[m][:, None] + np.arange(FRAME)] = data[(sub[m] + 1)[:, None] + np.arange(FRAME)].view(np.int8)
        end[m] = 8 * (sub[m] + 1 + FRAME)
        m = kind >= 8
        if m.any():
            values, end[m] = _rice_frames(bits, sub[m], kind[m].astype(np.int64))
            out[target[m][:, None] + np.arange(FRAME)] = values
        stop = end + 7 >> 3
        spans.append((start, stop))
        pos[lane] = 8 * (stop + 2)
    start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
    if (_crc(data, start, stop - start, _CRC16, 16) != (data[stop].astype(np.uint16) << 8 | data[stop + 1])).any():
        raise FlacError("a frame's checksum is wrong")
    return out.astype(np.int8).view(np.uint8)


def _rice_frames(bits: _Bits, sub: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of frames with predictors and Rice-coded residuals, and the bit after each."""
    data, lanes = bits.data, len(sub)
    linear = kind >= 32
    order = np.where(linear, (kind & 31) + 1, kind & 7)
    widest = max(1, int(order.max()))
    x = np.zeros((FRAME, lanes), dtype=np.int64)
    for t in range(int(order.max())):
        m = order > t
        x[t, m] = data[sub[m] + 1 + t].view(np.int8)
    pos = 8 * (sub + 1 + order)
    coef, shift = np.zeros((widest, lanes), dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    coef[: min(4, widest)] = _FIXED[np.where(linear, 0, order)].T[: min(4, widest)]
    if linear.any():
        p = pos[linear]
        precision, shift[linear] = bits.read(p, 4) + 1, bits.read(p + 4, 5)
        p = p + 9
        for t in range(widest):
            has = order[linear] > t
            value = (bits.top(p) >> (64 - precision).astype(np.uint64)).astype(np.int64)
            value -= (value >> (precision - 1)) << precision
            coef[t, linear] = np.where(has, value, 0)
            p = np.where(has, p + precision, p)
        pos[linear] = p
    head = bits.read(pos, 10)
    if (head >> 4).any():
        raise FlacError("residuals of another coding")
    k = head & 15
    pos = pos + 10
    drop = (63 - k).astype(np.uint64)
    one = np.uint64(1)
    for t in range(FRAME):
        top = bits.top(pos)
        quot = _ZEROS16[top >> np.uint64(48)].astype(np.int64)
        low = (((top << (quot + 1).astype(np.uint64)) >> drop) >> one).astype(np.int64)
        if (long := quot == 16).any():  # a long run of zeros
            at = pos[long] + 16
            while (z := _ZEROS16[bits.top(at) >> np.uint64(48)]).any():
                at += z
            quot[long] = at - pos[long]
            low[long] = (bits.top(at + 1) >> drop[long]) >> one
        fold = quot << k | low
        value = (fold >> 1) ^ -(fold & 1)
        if t < widest:
            live = t >= order
            past = sum((coef[i] * x[t - 1 - i] for i in range(min(widest, t))), np.zeros(lanes, dtype=np.int64))
            x[t] = np.where(live, value + (past >> shift), x[t])
            pos = np.where(live, pos + quot + 1 + k, pos)
        else:
            past = coef[0] * x[t - 1]
            for i in range(1, widest):
                past += coef[i] * x[t - 1 - i]
            x[t] = value + (past >> shift)
            pos = pos + quot + 1 + k
    return x.T, pos


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with spaces to a positive multiple of 192, and its length before."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % FRAME or (FRAME if not raw else 0)), len(raw)


def feature(samples: bytes) -> str:
    """Level, zero crossings and peak of the samples."""
    squares = crossings = peak = 0
    for a in range(0, len(samples), GROUP * FRAME):  # one sample more than a part, to see the step to the next
        x = np.frombuffer(samples, dtype=np.uint8, offset=a, count=min(GROUP * FRAME + 1, len(samples) - a)).astype(np.int64) - 128
        crossings += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        own = x[: GROUP * FRAME]
        squares, peak = squares + int((own * own).sum()), max(peak, int(np.abs(own).max()))
    n = len(samples)
    return f"rms={np.sqrt(squares / n):.4f};zcr={crossings / n:.4f};peak={peak}"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, text_col):
            made = [payload(t) for _, t in rows]
            yield arrow_batch({
                id_col: ([i for i, _ in rows], pa.int64()),
                "n_bytes": ([n for _, n in made], pa.int64()),
                "media": (write_streams([p for p, _ in made]), pa.binary()),
            })

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_bytes long, media binary")


def decode_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", block_samples: int = SEEK_FRAMES * FRAME) -> DataFrame:
    """(id, block, sample_offset, pcm binary): verified PCM blocks with the sample offset at which each begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, media_col):
            ids, blocks, offsets, pcm = [], [], [], []
            for (i, _), p in zip(rows, read_streams([m for _, m in rows]), strict=True):
                for b, at in enumerate(range(0, len(p), block_samples)):
                    ids.append(i), blocks.append(b), offsets.append(at), pcm.append(p[at : at + block_samples])
            yield arrow_batch({id_col: (ids, pa.int64()), "block": (blocks, pa.int64()), "sample_offset": (offsets, pa.int64()), "pcm": (pcm, pa.binary())})

    kept = media.where(media[media_col].isNotNull()).select(id_col, media_col)
    return kept.mapInArrow(run, f"{id_col} long, block long, sample_offset long, pcm binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as FLAC and read back: lengths, digests and a feature of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, text_col):
            made = [payload(t) for _, t in rows]
            media = write_streams([p for p, _ in made])
            back = read_streams(media)
            yield arrow_batch({
                id_col: ([i for i, _ in rows], pa.int64()),
                "n_bytes": ([n for _, n in made], pa.int64()),
                "payload_bytes": ([len(p) for p in back], pa.int64()),
                "payload_sha256": (list(map(sha256, back)), pa.string()),
                "tail_crc32": ([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                "media_bytes": ([len(m) for m in media], pa.int64()),
                "media_sha256": (list(map(sha256, media)), pa.string()),
                "feature": (list(map(feature, back)), pa.string()),
            })

    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
