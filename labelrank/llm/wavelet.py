"""A wavelet matrix over token ids: bit planes with rank support, from which any token can be read.

Level by level, from the highest bit down, a plane holds one bit of every token in the current order; then the
tokens are dealt stably, zeros before ones. The bytes of a matrix are a header, the planes, and per plane the
number of ones before each block of 512 bits, everything under zstd.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sBI")
_BLOCK = 512


class WaveletMatrix:
    """Access, counting and search on one shard."""

    def __init__(self, n: int, planes: list[np.ndarray], before: list[np.ndarray]):
        self.n, self.planes, self.before = n, planes, before
        self.zeros = [n - int(b[-1]) for b in before]

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        """From an array of ids below 2**32; the empty array is allowed."""
        tokens = np.asarray(tokens, np.uint32)
        bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        now = tokens.astype(np.uint16) if bits <= 16 else tokens
        planes, before = [], []
        for level in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            before.append(cls._blocks(packed))
            now = np.concatenate([np.compress(~ones, now), np.compress(ones, now)])
        return cls(len(tokens), planes, before)

    @staticmethod
    def _blocks(packed: np.ndarray) -> np.ndarray:
        """Ones before each block, and after the last."""
        step = _BLOCK // 8
        counts = np.bitwise_count(packed)
        counts = np.concatenate([counts, np.zeros(-len(counts) % step, np.uint8)]).reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        body = b"".join(p.tobytes() for p in self.planes) + b"".join(b.tobytes() for b in self.before)
        return _HEAD.pack(_MAGIC, len(self.planes), self.n) + zstandard.compress(body, 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        body = zstandard.decompress(memoryview(data)[_HEAD.size :])
        size, blocks = (n + 7) // 8, -(-((n + 7) // 8) // (_BLOCK // 8)) + 1
        planes = [np.frombuffer(body, np.uint8, size, k * size) for k in range(bits)]
        before = [np.frombuffer(body, np.uint32, blocks, bits * size + 4 * k * blocks) for k in range(bits)]
        return cls(n, planes, before)

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // _BLOCK, self.planes[level]
        lo, hi = block * _BLOCK // 8, i // 8
        ones = int(self.before[level][block]) + int(np.bitwise_count(plane[lo:hi]).sum())
        return ones + (int(plane[hi] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        ones = self.before[level].astype(np.int64)
        ahead = ones if bit else np.arange(len(ones)) * _BLOCK - ones
        ahead[-1] = np.iinfo(np.int64).max
        block = int(np.searchsorted(ahead, k, "right")) - 1
        lo = block * _BLOCK
        part = np.unpackbits(self.planes[level][lo // 8 : (lo + _BLOCK) // 8], bitorder="little")
        return lo + int(np.flatnonzero(part == bit)[k - int(ahead[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level, plane in enumerate(self.planes):
            bit = (int(plane[i // 8]) >> (i % 8)) & 1
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = 2 * token + bit
        return token

    def _narrow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the tokens of [lo, hi) that equal ``token`` stand after the last level."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank(level, lo), self._rank(level, hi)
            one = (token >> (len(self.planes) - 1 - level)) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs from place lo up to hi."""
        a, b = self._narrow(token, lo, self.n if hi is None else hi)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        lo, hi = self._narrow(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = (token >> (len(self.planes) - 1 - level)) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order: the deals are undone from the lowest bit up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            low = kind(1 << (len(self.planes) - 1 - level))
            was = np.empty(self.n, kind)
            was[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            was[np.flatnonzero(ones)] = now[self.zeros[level] :] | low
            now = was
        return now.astype(np.uint32)
