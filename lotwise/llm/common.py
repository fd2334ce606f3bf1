"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WORD_CHARS = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; rows without an id are in fold -1."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def mix(z: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept between texts; the store is emptied when it reaches ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def batch(self, texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of ``texts`` one after another, and the number of words of each text (null: none).

        ``bytes.split`` parts at space and \\t \\n \\v \\f \\r only and ``bytes.lower`` changes A-Z only.
        """
        parts = [(t.lower() if lower else t).split() for t in (b"" if t is None else t.encode() for t in texts)]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        n = int(counts.sum())
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(parts)), np.uint64, n), counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)


def pieces(batch: pa.RecordBatch, text_at: int, most: int = 4_000_000):
    """Slices of ``batch`` with about ``most`` bytes of text each, so that arrays made from them stay bounded."""
    texts = batch.column(text_at)
    sizes = np.array([0 if n is None else n for n in pc.binary_length(texts).to_pylist()], np.int64)
    at = 0
    while at < len(sizes):
        upto = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1 :]) + sizes[at], most))
        yield batch.slice(at, min(upto, len(sizes)) - at)
        at = min(upto, len(sizes))


def rolled(x: np.ndarray, n: int, base: np.uint64 = GOLDEN) -> np.ndarray:
    """Polynomial hashes of all ``n`` neighbours of ``x``, put together from powers of two."""
    acc, have, block, width = None, 0, x, 1
    power = lambda k: np.uint64(pow(int(base), k, 1 << 64))
    while True:
        if n & width:
            acc = block if acc is None else acc[: max(0, len(block) - have)] * power(width) + block[have : have + len(acc)]
            have += width
        if have == n:
            return acc
        block = block[: max(0, len(block) - width)] * power(width) + block[width:]
        width *= 2


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    span = 1
    while span < n:
        step = min(span, n - span)
        x = np.minimum(x[: max(0, len(x) - step)], x[step:])
        span += step
    return x


class Sieve:
    """A Bloom filter of fixed size: what it lets through may be in the set, what it stops is not.

    It only saves work before an exact step. Its size is given, so it can be broadcast at any scale; when it is full it
    stops nothing.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    PROBES = 3

    @classmethod
    def of(cls, hashes: DataFrame, bits: int = 26) -> Sieve:
        """From a column ``hash`` of 64-bit values; at most ``2**bits / 64`` rows are collected."""
        at = [F.shiftrightunsigned("hash", i * 20 % (64 - bits)).bitwiseAND((1 << bits) - 1) for i in range(cls.PROBES)]
        bit = F.explode(F.array(*at)).alias("bit")
        rows = hashes.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("v")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["word"].to_numpy()] = rows["v"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(words)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bits = len(self.words).bit_length() + 5
        out = np.ones(len(hashes), bool)
        for i in range(self.PROBES):
            at = (hashes >> np.uint64(i * 20 % (64 - bits))) & np.uint64((1 << bits) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out
