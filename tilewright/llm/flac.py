"""FLAC as an array codec and as columns (operator 10).

Frames of many rows are coded and decoded in lock step with array operations: Rice codes are written as bit
positions, and read by a table of the next one-bit, one sample of every frame at a time. Fixed predictors of
order 0 to 2 are written, and linear ones where they are asked for and leave less; fixed (0 to 4), linear, constant
and verbatim subframes are read, with any number of Rice partitions. Every frame's two checksums and the digest of all
samples are verified.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_exact

BLOCK, RATE, UNIT = 4096, 8000, 64
#: Bits of a written linear predictor's coefficients.
PRECISION = 12
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values: the format's polynomial predictors


@functools.lru_cache(maxsize=2)
def crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, dtype=np.uint32)


def crc8(data: bytes) -> int:
    table, c = crc_table(0x07, 8), 0
    for b in data:
        c = int(table[c ^ b])
    return c


def crc16(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksum of each stretch of the buffer, all stretches in lock step."""
    table = crc_table(0x8005, 16)
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    c = np.zeros(at.size, dtype=np.uint32)
    active = np.searchsorted(-left, -np.arange(1, (left[0] if left.size else 0) + 1), side="right")
    for k, n in enumerate(active):
        x = c[:n]
        c[:n] = ((x << np.uint32(8)) & np.uint32(0xFFFF)) ^ table[(x >> np.uint32(8)) ^ buffer[at[:n] + k]]
    out = np.empty_like(c)
    out[order] = c
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 1
    while True:
        tail.insert(0, 0x80 | n & 0x3F)
        n >>= 6
        size += 1
        if n < 1 << (7 - size):
            return bytes([(0xFF << (8 - size)) & 0xFF | n, *tail])


def _frame_head(number: int, samples: int) -> bytes:
    head = bytes([0xFF, 0xF8, 0x74, 0x02]) + coded_number(number) + (samples - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _linear(flat: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients and shift of each frame's linear predictor and what it leaves of every sample from place ``order`` on.

    Autocorrelations are exact integers, so a frame's predictor doesn't depend on its neighbours.
    """
    x = flat.astype(np.int64)
    behind = np.zeros((order + 1, x.size), dtype=np.int64)
    for lag in range(order + 1):
        behind[lag, lag:] = x[: x.size - lag]
        behind[lag, place < lag] = 0
    r = np.stack([np.add.reduceat(x * b, start) for b in behind]).astype(float)
    taps, error = np.zeros((order, start.size)), np.maximum(r[0], 1.0)
    for i in range(order):
        reflected = (r[i + 1] - sum(taps[j] * r[i - j] for j in range(i))) / error
        taps[:i] -= reflected * taps[:i][::-1].copy()
        taps[i] = reflected
        error = np.maximum(error * (1 - reflected * reflected), 1.0)
    shift = np.clip(PRECISION - 1 - np.frexp(np.abs(taps).max(axis=0))[1], 0, 15).astype(np.int64)
    most = 1 << (PRECISION - 1)
    whole = np.clip(np.rint(taps * 2.0**shift), -most, most - 1).astype(np.int64)
    predicted = sum(np.repeat(whole[j], size) * behind[j + 1] for j in range(order)) >> np.repeat(shift, size)
    return whole, shift, np.where(place < order, 0, x - predicted)


def encode(payloads: list[bytes], block: int = BLOCK, linear: int = 0) -> list[bytes]:
    """One FLAC stream (mono, 8 bits, with a seek table) for each non-empty payload of unsigned samples.

    With ``linear`` above 0, frames take a linear predictor of that order (up to 32) where it leaves less than the fixed ones.
    """
    flat = np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int16) - 128
    spans = []  # (payload, frame, start, samples)
    at = 0
    for i, p in enumerate(payloads):
        spans += [(i, k, at + s, min(block, len(p) - s)) for k, s in enumerate(range(0, len(p), block))]
        at += len(p)
    start, size = np.array([s[2] for s in spans]), np.array([s[3] for s in spans])
    d1 = np.zeros_like(flat)
    d1[1:] = flat[1:] - flat[:-1]
    d1[start] = 0
    d2 = np.zeros_like(flat)
    d2[1:] = d1[1:] - d1[:-1]
    d2[start] = 0
    d2[start + np.minimum(1, size - 1)] = 0
    cost = np.stack([np.add.reduceat(np.abs(d).astype(np.int64), start) for d in (flat, d1, d2)])
    order = np.where(size > 2, cost.argmin(axis=0), 0)
    which = np.repeat(order.astype(np.int32), size)
    residual = np.where(which == 0, flat, np.where(which == 1, d1, d2)).astype(np.int32)
    place = np.arange(flat.size, dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    extra = np.zeros(start.size, dtype=np.int64)  # bits of a linear predictor
    if linear:
        taps, shift, left = _linear(flat, place, start, size, linear)
        better = (size > 8 * linear) & (np.add.reduceat(np.abs(left), start) < cost.min(axis=0))
        extra[better] = 9 + PRECISION * linear
        order = np.where(better, linear, order)
        which = np.repeat(order.astype(np.int32), size)
        residual = np.where(np.repeat(better, size), left, residual).astype(np.int32)
    u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    coded = place >= which
    mean = np.add.reduceat(np.where(coded, u, 0), start) / np.maximum(1, size - order)
    k = np.clip(np.ceil(np.log2(np.maximum(1e-9, mean * 0.7))), 0, 14).astype(np.int64)
    ks = np.repeat(k.astype(np.int32), size)
    q = u >> ks
    length = np.where(coded, q + 1 + ks, np.int32(8))
    ends = np.cumsum(length)
    within = ends - length - np.repeat((ends - length)[start], size)  # bits from the first sample of the frame
    heads = [_frame_head(f, n) for _, f, _, n in spans]
    head_bits = np.array([8 * len(h) for h in heads])
    # Subframe: type byte, warm-up samples, a linear predictor, 10 bits of residual head.
    body = np.add.reduceat(length, start)
    bytes_ = (head_bits + 8 + extra + 10 + body + 7) // 8 + 2
    frame_at = np.cumsum(bytes_) - bytes_
    bits = np.zeros(int(bytes_.sum()) * 8, dtype=np.uint8)
    first = frame_at * 8 + head_bits + 8
    pos = np.repeat(first, size) + within
    pos += np.where(coded, 10 + np.repeat(extra, size), 0)
    c, p, v, r = coded, pos[coded], u[coded], ks[coded]
    stop = p + (v >> r)
    bits[stop] = 1
    for b in range(int(k.max(initial=0))):
        use = r > b
        bits[stop[use] + 1 + b] = (v[use] >> (r[use] - 1 - b)) & 1
    warm = ~c
    for b in range(8):
        bits[pos[warm] + b] = (flat[warm] >> (7 - b)) & 1
    gap = first + 8 * order

    def put(at: np.ndarray, v: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (v >> (width - 1 - b)) & 1

    if linear:
        at = gap[better]
        put(at, np.full(at.size, PRECISION - 1), 4)
        put(at + 4, shift[better], 5)
        for j in range(linear):
            put(at + 9 + PRECISION * j, taps[j, better], PRECISION)
    gap = gap + extra
    for b in range(4):
        bits[gap + 6 + b] = (k >> (3 - b)) & 1
    buffer = np.packbits(bits)
    for h, o, f, e in zip(heads, order, frame_at, extra):
        buffer[f : f + len(h)] = np.frombuffer(h, dtype=np.uint8)
        buffer[f + len(h)] = (31 + int(o) if e else 8 | int(o)) << 1
    check = crc16(buffer, frame_at, bytes_ - 2)
    buffer[frame_at + bytes_ - 2], buffer[frame_at + bytes_ - 1] = check >> 8, check & 0xFF
    out, f = [], 0
    owner = np.array([s[0] for s in spans])
    for i, p in enumerate(payloads):
        n = int((np.searchsorted(owner, i + 1)) - f)
        mine = slice(f, f + n)
        stream = buffer[frame_at[f] : frame_at[f + n - 1] + bytes_[f + n - 1]].tobytes()
        info = block.to_bytes(2, "big") * 2 + int(bytes_[mine].min()).to_bytes(3, "big") + int(bytes_[mine].max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5((flat[start[f] : start[f] + len(p)]).astype(np.int8).tobytes()).digest()
        seek = b"".join(int(s).to_bytes(8, "big") + int(a).to_bytes(8, "big") + int(z).to_bytes(2, "big") for s, a, z in zip(start[mine] - start[f], frame_at[mine] - frame_at[f], size[mine]))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + stream)
        f += n
    return out


def _seek_points(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]]]:
    """First byte of the frames, total samples, their digest, and (sample, byte offset, samples) of every frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, total, digest, points = 4, 0, b"", []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        data = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            total, digest = int.from_bytes(data[10:18], "big") & (1 << 36) - 1, data[18:34]
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(data[i : i + 8], "big"), int.from_bytes(data[i + 8 : i + 16], "big"), int.from_bytes(data[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 0x80:
            return at, total, digest, points


def decode_frames(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Signed samples of each frame; a wrong checksum or an unknown form is an error."""
    stored = (buffer[starts + lengths - 2].astype(np.uint32) << np.uint32(8)) | buffer[starts + lengths - 1]
    if not np.array_equal(crc16(buffer, starts, lengths - 2), stored):
        raise ValueError("frame checksum")
    n = starts.size
    samples, kind, first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, a in enumerate(starts):
        h = bytes(buffer[a : a + 16])
        if h[0] != 0xFF or h[1] != 0xF8 or h[2] != 0x74 or h[3] != 0x02:
            raise ValueError("frame head")
        extra = 0 if h[4] < 0x80 else 8 - (h[4] ^ 0xFF).bit_length() - 1
        size = 4 + 1 + extra + 2
        if crc8(h[:size]) != h[size]:
            raise ValueError("head checksum")
        samples[i] = int.from_bytes(h[size - 2 : size], "big") + 1
        kind[i] = buffer[a + size + 1] >> 1 & 0x3F
        first[i] = (a + size + 2) * 8
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    word = padded[:-3].astype(np.uint32)
    word = (word << np.uint32(24)) | (padded[1:-2].astype(np.uint32) << np.uint32(16)) | (padded[2:-1].astype(np.uint32) << np.uint32(8)) | padded[3:]

    def field(p: np.ndarray, width) -> np.ndarray:
        """Unsigned fields of up to 24 bits at bit positions p."""
        w = np.asarray(width, dtype=np.uint32)
        return ((word[p >> 3] >> (np.uint32(32) - w - (p & 7).astype(np.uint32))) & ((np.uint32(1) << w) - np.uint32(1))).astype(np.int64)

    def signed(v: np.ndarray, width: int) -> np.ndarray:
        return v - ((v >> (width - 1) & 1) << width)

    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for i in np.flatnonzero(kind == 0):
        out[i] = np.full(samples[i], signed(field(first[i : i + 1], 8), 8)[0])
    for i in np.flatnonzero(kind == 1):
        out[i] = signed(field(first[i] + 8 * np.arange(samples[i]), 8), 8)
    rice = np.flatnonzero(kind >= 8)
    if not rice.size:
        return out
    linear = kind[rice] >= 32
    order = np.where(linear, (kind[rice] & 31) + 1, kind[rice] & 7)
    # Where the residual begins: after the warm-up samples and a linear predictor.
    p = first[rice] + 8 * order
    p = np.where(linear, p + 9 + (field(p, 4) + 1) * order, p)
    plain = (field(p, 6) == 0) & (field(p + 6, 4) < 15)
    # Frames of one partition come first, longest first; they are read in lock step.
    turn = np.lexsort((-samples[rice], ~plain))
    rice, linear, order, plain = rice[turn], linear[turn], order[turn], int(plain.sum())
    size, p = samples[rice], first[rice].copy()
    longest = int(size.max())
    value = np.zeros((longest, rice.size), dtype=np.int32)
    for w in range(int(order.max(initial=0))):
        use = np.flatnonzero(order > w)
        value[w, use] = signed(field(p[use], 8), 8)
        p[use] += 8
    taps = np.zeros((rice.size, int(order.max(initial=0))), dtype=np.int64)
    shift = np.zeros(rice.size, dtype=np.int64)
    for j in range(rice.size):
        if linear[j]:
            width = int(field(p[j : j + 1], 4)[0]) + 1
            shift[j] = signed(field(p[j : j + 1] + 4, 5), 5)[0]
            taps[j, : order[j]] = signed(field(p[j] + 9 + width * np.arange(order[j]), width), width)
            p[j] += 9 + width * int(order[j])
        else:
            taps[j, : order[j]] = FIXED[int(order[j])]
    ones = np.unpackbits(padded)
    nxt = np.where(ones == 1, np.arange(ones.size, dtype=np.int32), np.int32(ones.size - 1))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]

    def partitions(at: int, warm: int, n: int) -> np.ndarray:
        """Residuals of one subframe in several partitions, with parameters of four or five bits, or escaped."""
        one = lambda a, w: int(field(np.array([a]), w)[0])
        if one(at, 2) > 1:
            raise ValueError("unknown form of residual")
        wide, count, out = 4 + one(at, 2), 1 << one(at + 2, 4), []
        at += 6
        for j in range(count):
            m, k, at = n // count - (0 if j else warm), one(at, wide), at + wide
            if k == (1 << wide) - 1:
                raw, at = one(at, 5), at + 5
                out += signed(field(at + raw * np.arange(m), raw), raw).tolist() if raw else [0] * m
                at += raw * m
                continue
            for _ in range(m):
                stop = int(nxt[at])
                v = (stop - at) << k | one(stop + 1, k)
                out.append((v >> 1) ^ -(v & 1))
                at = stop + 1 + k
        return np.array(out)

    for j in range(plain, rice.size):
        value[order[j] : size[j], j] = partitions(int(p[j]), int(order[j]), int(size[j]))
    k, p = field(p[:plain] + 6, 4), p[:plain] + 10
    active = np.searchsorted(-size[:plain], -np.arange(1, (size[0] if plain else 0) + 1), side="right")
    k32, p = k.astype(np.uint32), p.astype(np.int64)
    mask = ((np.int64(1) << k) - 1).astype(np.uint32)
    least = int(order[:plain].max(initial=0))
    for s, a in enumerate(active):
        if s < least:
            use = np.flatnonzero(order[:a] <= s)
            stop = nxt[p[use]].astype(np.int64)
            at = stop + 1
            low = (word[at >> 3] >> (np.uint32(32) - k32[use] - (at & 7).astype(np.uint32)).clip(0, 31)) & mask[use]
            v = ((stop - p[use]) << k[use]) | low
            value[s, use] = (v >> 1) ^ -(v & 1)
            p[use] = at + k[use]
            continue
        old = p[:a]
        at = nxt[old].astype(np.int64)
        v = at - old
        at += 1
        low = (word[at >> 3] >> np.minimum(np.uint32(32) - k32[:a] - (at & 7).astype(np.uint32), np.uint32(31))) & mask[:a]
        v = (v << k[:a]) | low
        value[s, :a] = (v >> 1) ^ -(v & 1)
        p[:a] = at + k[:a]
    for o in (1, 2):  # the common fixed orders in closed form
        use = np.flatnonzero((order == o) & ~linear)
        if use.size:
            x = value[:, use].astype(np.int64)
            if o == 2:
                x[1] = x[1] - x[0]
                x[1:] = np.cumsum(x[1:], axis=0)
            value[:, use] = np.cumsum(x, axis=0)
    rest = np.flatnonzero(linear | (order > 2))
    if rest.size:
        x, t, sh, od = value[:, rest].astype(np.int64), taps[rest], shift[rest], order[rest]
        for s in range(longest):
            total = sum(t[:, j] * x[s - 1 - j] for j in range(min(s, t.shape[1])))
            x[s] += np.where(od <= s, total >> sh, 0) if s else 0
        value[:, rest] = x
    for j, i in enumerate(rice):
        out[i] = value[: samples[i], j]
    return out


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """For each stream its blocks: first sample, byte offset of the frame, unsigned PCM samples."""
    heads = [_seek_points(s) for s in streams]
    buffer = np.frombuffer(b"".join(streams), dtype=np.uint8)
    starts, lengths, base = [], [], 0
    for s, (first, _, _, points) in zip(streams, heads):
        at = [base + first + p[1] for p in points]
        starts += at
        lengths += list(np.diff([*at, base + len(s)]))
        base += len(s)
    frames = decode_frames(buffer, np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)) if starts else []
    out, f = [], 0
    for first, total, digest, points in heads:
        own = [(p[0], first + p[1], (x + 128).astype(np.uint8).tobytes()) for p, x in zip(points, frames[f : f + len(points)])]
        if sum(len(b[2]) for b in own) != total:
            raise ValueError("samples are missing")
        # All zeros: the writer gave none.
        if any(digest) and hashlib.md5(b"".join(x.astype(np.int8).tobytes() for x in frames[f : f + len(points)])).digest() != digest:
            raise ValueError("samples differ from their digest")
        out.append(own)
        f += len(points)
    return out


def padded_payload(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


def _parts(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    part = np.cumsum(sizes) // most
    for k in np.unique(part):
        yield np.flatnonzero(part == k)


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream of the padded UTF-8 bytes); null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for rows in _parts(np.array([len(t) + UNIT for t in texts])):
                both = [padded_payload(texts[i]) for i in rows]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[rows].array, "n_bytes": [n for _, n in both], "media": encode([p for p, _ in both])})

    return map_exact(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """One row per PCM block: doc_id, block, first_sample, byte_offset, pcm; damaged streams fail the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _parts(pdf["media"].map(len).to_numpy()):
                part = pdf.iloc[rows]
                out = [(d, k, s, a, p) for d, blocks in zip(part["doc_id"], decode_blocks(list(part["media"]))) for k, (s, a, p) in enumerate(blocks)]
                yield pd.DataFrame(out, columns=["doc_id", "block", "first_sample", "byte_offset", "pcm"])

    return map_exact(media.select("doc_id", "media"), run, "doc_id long, block int, first_sample long, byte_offset long, pcm binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored streams back: sizes, digests and a feature string of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _parts(pdf["media"].map(len).to_numpy()):
                part, out = pdf.iloc[rows], []
                for d, n, m, blocks in zip(part["doc_id"], part["n_bytes"], part["media"], decode_blocks(list(part["media"]))):
                    p = b"".join(b[2] for b in blocks)
                    x = np.frombuffer(p, dtype=np.uint8)
                    feature = f"blocks={len(blocks)};sum={int(x.sum(dtype=np.int64))};max={int(x.max())};rises={int((x[1:] > x[:-1]).sum())}"
                    out.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_exact(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
