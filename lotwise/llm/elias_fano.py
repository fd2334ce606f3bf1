"""Elias-Fano sequences and a two-level n-gram trie of them, in one flat buffer that can be mapped into memory."""

from __future__ import annotations

import json
import mmap

import numpy as np

#: contexts are told apart by so many bits of their hashes
CONTEXT_BITS = 40


class EliasFano:
    """A sorted sequence of whole numbers: low bits packed, high bits as a unary bit vector with a directory of its zeros and ones."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in parts["head"])
        self.low, self.high = parts["low"], parts["high"]
        # eight bytes from any place, so that a low part of up to 57 bits is one read
        self.reads = np.ndarray((max(0, len(self.low) - 7),), "<u8", self.low, 0, (1,))
        self.ones_before, self.zeros_before = parts["ones"], parts["zeros"]

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(56, max(0, ((top + 1) // max(1, n)).bit_length() - 1))
        packed = []
        for at in range(0, n, 1 << 16):  # a multiple of 8 numbers fills whole bytes
            bits = (values[at : at + (1 << 16), None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            packed.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1, dtype=np.int64))])
        return {
            "head": np.array([n, width], np.int64), "low": np.concatenate([*packed, np.zeros(8, np.uint8)]), "high": high,
            "ones": before, "zeros": np.arange(len(before)) * 64 - before,
        }

    def _select(self, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the ``k``-th one (or zero, with ``flip``) of the high bits."""
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), 1 << 16):
            part = k[at : at + (1 << 16)]
            word = np.searchsorted(before, part, "right") - 1
            bits = self.high[word]
            rank = np.cumsum(np.unpackbits((~bits if flip else bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1, dtype=np.uint8)
            out[at : at + (1 << 16)] = word * 64 + (rank <= (part - before[word])[:, None].astype(np.uint8)).sum(1)
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        return (self.reads[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = self._select(self.ones_before, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number not below each of ``x`` (``n`` if there is none)."""
        h, low = (x >> np.uint64(self.width)).astype(np.int64), x & np.uint64((1 << self.width) - 1)
        out = np.full(len(x), self.n, np.int64)
        zeros = int(self.zeros_before[-1])
        there = np.flatnonzero(h < zeros)
        h, low = h[there], low[there]
        first = h > 0
        lo, hi = np.zeros(len(h), np.int64), np.full(len(h), self.n, np.int64)
        lo[first] = self._select(self.zeros_before, h[first] - 1, True) - (h[first] - 1)
        hi[:] = np.minimum(self._select(self.zeros_before, h, True) - h, self.n)
        lo = np.minimum(lo, self.n)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            below = open_.copy()
            below[open_] = self.lows(mid[open_]) < low[open_]
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        out[there] = lo
        return out


def flatten(parts: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one buffer, each at a multiple of 8 bytes."""
    head, body, at = [], [], 0
    for name, a in parts.items():
        raw = a.tobytes()
        raw += bytes(-len(raw) % 8)
        head.append([name, a.dtype.str, len(a), at])
        body.append(raw)
        at += len(raw)
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    return len(top).to_bytes(8, "little") + top + b"".join(body)


def unflatten(buffer) -> dict[str, np.ndarray]:
    top = int.from_bytes(buffer[:8], "little")
    return {name: np.frombuffer(buffer, kind, n, 8 + top + at) for name, kind, n, at in json.loads(bytes(buffer[8 : 8 + top]))}


class Trie:
    """Words, and below each the contexts that it was seen after.

    Level 1: hashes of words, their cumulated counts, and monotone pointers to where each word's contexts begin. Level 2:
    contexts, sorted below each word, as one monotone sequence (the word's index before the context's bits), and the
    quantised logarithm of count + prior for each. A pair is found by the word's index and a successor search among its contexts.
    """

    def __init__(self, buffer):
        parts = unflatten(buffer)
        level = lambda name: EliasFano({k.partition(".")[2]: a for k, a in parts.items() if k.startswith(f"{name}.")})
        self.words, self.counts, self.pointers, self.contexts = map(level, ("words", "counts", "pointers", "contexts"))
        self.codes, self.grid = parts["codes"], parts["grid"]

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, pair_log: np.ndarray) -> bytes:
        """``words`` sorted; pairs sorted by index of the word, then context, with their logarithms."""
        low, high = (float(pair_log.min()), float(pair_log.max())) if len(pair_log) else (0.0, 0.0)
        step = (high - low) / 65535 or 1.0
        begins = np.searchsorted(pair_word, np.arange(len(words) + 1))
        levels = {
            "words": words, "counts": np.concatenate([[0], np.cumsum(counts)]), "pointers": begins,
            "contexts": (pair_word.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | pair_context,
        }
        parts = {f"{name}.{k}": a for name, values in levels.items() for k, a in EliasFano.build(np.asarray(values)).items()}
        return flatten(parts | {"codes": np.rint((pair_log - low) / step).astype("<u2"), "grid": np.array([low, step])})

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """From bytes, in a memory map that no file stands behind: nothing is left on the machine."""
        area = mmap.mmap(-1, max(1, len(raw)))
        area[: len(raw)] = raw
        return cls(area)

    @classmethod
    def open(cls, path: str) -> Trie:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Index of each word, -1 if unknown."""
        if not self.words.n:
            return np.full(len(words), -1)
        at = self.words.successor(words)
        inside = np.minimum(at, self.words.n - 1)
        return np.where((at < self.words.n) & (self.words[inside] == words), at, -1)

    def count(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        known = index >= 0
        out[known] = (self.counts[index[known] + 1] - self.counts[index[known]]).astype(np.int64)
        return out

    def pair_logs(self, index: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Quantised logarithm of each pair, nan where the word was not seen in the context."""
        out = np.full(len(index), np.nan)
        known = np.flatnonzero(index >= 0)
        if not len(known) or not self.contexts.n:
            return out
        i = index[known]
        key = (i.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts[known]
        at = self.contexts.successor(key)
        words, back = np.unique(i, return_inverse=True)
        end = self.pointers[words + 1].astype(np.int64)[back]
        inside = np.minimum(at, self.contexts.n - 1)
        hit = (at < end) & (self.contexts[inside] == key)
        out[known[hit]] = self.grid[0] + self.grid[1] * self.codes[at[hit]]
        return out
