"""FLAC frames of other writers: linear predictors, partitions, escapes, and damage."""

import hashlib
import random

import numpy as np
import pytest

from tilewright.llm import flac


def test_linear_predictors_are_written_and_read():
    rng = np.random.default_rng(3)
    wave = np.rint(90 * np.sin(np.arange(9000) / 7) * np.sin(np.arange(9000) / 900)).astype(np.int64) + 128
    payloads = [wave.astype(np.uint8).tobytes(), b"word after word " * 300, bytes(64), rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), b"\x80" * 4096]
    for order in (1, 2, 4, 8, 32):
        streams = flac.encode(payloads, linear=order)
        assert [b"".join(b[2] for b in own) for own in flac.decode_blocks(streams)] == payloads
        assert [flac.encode([p], linear=order)[0] for p in payloads] == streams
    assert len(flac.encode(payloads[:1], linear=4)[0]) < len(flac.encode(payloads[:1])[0])


class _Bits:
    def __init__(self):
        self.out = []

    def put(self, v, width):
        self.out += [(v >> (width - 1 - b)) & 1 for b in range(width)]

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        self.out += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)


def _stream(samples, bits, digest):
    """A stream of one frame whose subframe is given bit by bit."""
    head = flac._frame_head(0, len(samples))
    frame = np.frombuffer(head + np.packbits(np.array(bits.out, dtype=np.uint8)).tobytes(), dtype=np.uint8)
    frame = frame.tobytes() + int(flac.crc16(frame, np.array([0]), np.array([frame.size]))[0]).to_bytes(2, "big")
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + digest
    seek = bytes(16) + len(samples).to_bytes(2, "big")
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frame


def _linear_frame(samples, taps, shift, method, parts, raw):
    bits, n = _Bits(), len(samples)
    bits.put((31 + len(taps)) << 1, 8)
    for v in samples[: len(taps)]:
        bits.put(v, 8)
    bits.put(6, 4)  # coefficients of seven bits
    bits.put(shift, 5)
    for c in taps:
        bits.put(c, 7)
    left = [v - (sum(c * samples[i - 1 - j] for j, c in enumerate(taps)) >> shift) for i, v in enumerate(samples) if i >= len(taps)]
    bits.put(method, 2)
    bits.put(parts, 4)
    per, wide = n >> parts, 5 if method else 4
    for j in range(1 << parts):
        mine = left[max(0, j * per - len(taps)) : (j + 1) * per - len(taps)]
        if j in raw:
            bits.put((1 << wide) - 1, wide)
            bits.put(11, 5)
            for v in mine:
                bits.put(v, 11)
        else:
            bits.put(j % 6, wide)
            for v in mine:
                bits.rice(v, j % 6)
    return bits


@pytest.mark.parametrize("method, parts, raw", [(0, 0, ()), (0, 3, ()), (0, 2, (1, 3)), (1, 2, (0,)), (1, 0, ()), (0, 0, (0,))])
def test_streams_of_other_writers(method, parts, raw):
    rng = random.Random(8)
    samples = [rng.randrange(-128, 128) for _ in range(256)]
    bits = _linear_frame(samples, [37, -20, 9], 5, method, parts, raw)
    digest = hashlib.md5(np.array(samples, dtype=np.int8).tobytes()).digest()
    want = bytes(v + 128 for v in samples)
    mine = b"own frames beside it" * 16
    both = flac.decode_blocks([*flac.encode([mine]), _stream(samples, bits, digest), _stream(samples, bits, bytes(16))])
    assert [b"".join(b[2] for b in own) for own in both] == [mine, want, want]
    with pytest.raises(ValueError, match="digest"):
        flac.decode_blocks([_stream(samples, bits, b"x" * 16)])
