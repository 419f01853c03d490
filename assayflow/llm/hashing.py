"""Vectorised hashes of words and word shingles, the same in every process.

Equal hashes stand for equal strings: two different ones agree with odds of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: CRC-32 registers after one byte.
CRC_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC_TABLE = np.where(CRC_TABLE & 1, (CRC_TABLE >> 1) ^ np.uint32(0xEDB88320), CRC_TABLE >> 1)
#: Bytes of text hashed at a time; one longer text is a block of its own.
BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1, modulo 2 to the 64. Those that a block needs are kept; more, for a longer text, are not."""
    if n <= 2 * BLOCK and base in _powers:
        return _powers[base][:n]
    steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
    steps[0] = 1
    steps = np.cumprod(steps)
    _powers[base] = steps[: 2 * BLOCK].copy() if n > 2 * BLOCK else steps
    return steps[:n]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which span_hashes() takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def text_blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= BLOCK or k == len(texts) - 1:
            yield start, texts[start : k + 1]
            start, n = k + 1, 0


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of `size` lower-case words.

    With fewer words, the whole sequence is the one shingle; without words, none.
    """
    for _, own in text_blocks(texts):
        data = _LOWER[np.frombuffer(b" ".join([*own, b""]), np.uint8)]
        lengths = np.array([len(t) + 1 for t in own])
        doc_end = np.cumsum(lengths)
        word = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        h = span_hashes(byte_sums(data), start, end)
        first = np.searchsorted(start, np.concatenate([[0], doc_end]))
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled = rolled * U(0xD6E8FEB86659FD93) + mix(h[k : len(h) - size + 1 + k] + U(k))
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                x = U(b - a)
                with np.errstate(over="ignore"):
                    for w in h[a:b]:
                        x = mix(np.array([x * U(0xA24BAED4963EE407) + w]))[0]
                yield np.array([x], np.uint64)
            else:
                yield np.empty(0, np.uint64)
