"""Vectorised word hashing for executors' Python: no Python object per word.

Texts are put end to end (words joined by one space). A word is hashed from
its length on in lanes of eight bytes, each mixed into the state by a bijection
of 64-bit values, so different words of one length and up to eight bytes never
collide; the cost is a few nanoseconds a byte.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Fixed odd multipliers (from the splitmix64 finaliser) and starts of independent word hashes.
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
STARTS = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
#: Words from so many bytes on are hashed one by one.
LONG = 256
#: Bytes of text handled at once, unless one text alone is longer.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * M1
    x = x ^ (x >> U(27))
    x = x * M2
    return x ^ (x >> U(31))


def chunks(texts: list[bytes], limit: int = CHUNK):
    """Index ranges (i, j) of consecutive texts of about ``limit`` bytes together, one text at least."""
    i = total = 0
    for j, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield i, j
            i, total = j, 0
        total += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


class Words:
    """Words of several texts, each already normalised to words joined by one space."""

    def __init__(self, normal: list[bytes]):
        buf = np.frombuffer(b" ".join(t for t in normal if t) + b" ", dtype=np.uint8)
        if len(buf) == 1:
            buf = buf[:0]
        self.buf = buf
        self.ends = np.flatnonzero(buf == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        lengths = np.array([len(t) for t in normal], dtype=np.int64)
        at = np.cumsum(np.where(lengths > 0, lengths + 1, 0))  # byte after the space that ends each text
        #: first word of each text, and one past the last text's words
        self.first = np.concatenate([[0], np.searchsorted(self.starts, at)])
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; different ``which`` are independent."""
        size = self.ends - self.starts
        padded = np.concatenate([self.buf, np.zeros(8, dtype=np.uint8)])
        lanes = np.ndarray(len(self.buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
        out = mix(size.astype(U) * M1 + STARTS[which])
        rest = np.flatnonzero(size < LONG)
        at = 0
        while len(rest):
            left = np.minimum(8, size[rest] - at).astype(U)
            lane = lanes[self.starts[rest] + at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left))
            out[rest] = mix(out[rest] ^ lane)
            at += 8
            rest = rest[size[rest] > at]
        for k in np.flatnonzero(size >= LONG):
            out[k] = xxhash.xxh64_intdigest(self.buf[self.starts[k] : self.ends[k]].tobytes(), int(out[k]))
        return out


def grams(x: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` items from each place on; the array is ``size - 1`` shorter."""
    if len(x) < size:
        return x[:0]
    salt = U((2 * seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    out, done, level, width = None, 0, mix(x + salt), 1
    while True:
        if size & width:
            part = level
            out = part if out is None else mix(out[: len(part) - done] * M1 + part[done : done + len(out)]) if done else part
            done += width
        if done == size:
            return out[: len(x) - size + 1]
        level = mix(level[:-width] * M2 + level[width:] + salt)
        width *= 2


def sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """Minimum or maximum (``op``) of the ``size`` values from each place on."""
    if len(x) < size:
        return x[:0]
    width, level = 1, x
    while 2 * width <= size:
        level = op(level[:-width], level[width:])
        width *= 2
    n = len(x) - size + 1
    return op(level[:n], level[size - width : size - width + n])
