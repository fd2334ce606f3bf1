"""LM scoring: a bigram model in Elias-Fano tries, one per shard of the vocabulary.

Tokens are the words of a text, A-Z lower-cased, and one end. With c the counts over the training rows, N tokens and V
distinct ones, p(w) = (c(w) + 1) / (N + V + 1), and after context v (the word before, or the start)

    p(w | v) = (c(v w) + prior p(w)) / (c(v) + prior).

The logarithm of the numerator needs what is known of w only, the denominator what is known of v; so each token is sent
once, to the shard of its word, and a text's score is the sum of what the shards find. Nothing of the model is
broadcast, but for the counts of words so frequent that one shard could not take them: these are at most 4 per shard, and their
tokens are dealt to all shards by context. How many shards there are follows from N.

``score`` sends each batch of texts as one packed row per shard (distinct pairs of each text with their multiplicities). A
shard counts the training pairs, builds its trie (``elias_fano.Trie``: 16-bit codes for the numerators of pairs seen) in
a memory map, looks up all its pairs and returns one packed row of sums per batch; a batch's rows are then added up.
``tries`` returns the tries themselves, to be kept.

Null and empty texts have one token, the end. Without training rows N = V = 0. Rows with equal ids are scored each; a
null id is let through; other columns are ignored. Batches are told apart by task, so ``docs`` must come in the same order when
a task is run again, as a table that is read does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import WordHashes, col, mix, pieces
from lotwise.llm.elias_fano import CONTEXT_BITS, Trie, flatten, unflatten
from lotwise.session import materialise

START, END = np.uint64(0), np.uint64(1)
PRIOR = 5.0
PER_SHARD = 3_000_000
LEAST_SHARDS = 64  # so that there are tasks enough, and as many sums per text, for small inputs too
BATCH = 8_000_000


def sequences(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, word and context of each token, the end of each text included."""
    x, counts = hashes.batch(texts, lower=True)
    ends = np.cumsum(counts)
    words = np.insert(x, ends, END)
    text = np.repeat(np.arange(len(texts)), counts + 1)
    context = np.concatenate([[START], words[:-1]]) if len(words) else words
    context[ends - counts + np.arange(len(texts))] = START
    return text, words, context


def word_counts(rows: DataFrame) -> DataFrame:
    """``word`` (hash) and its count ``n`` over rows with ``trained``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, 0, BATCH):
                words, n = np.unique(sequences(part.column(0).to_pylist(), hashes)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return rows.where("trained").select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shard_of(words: np.ndarray, contexts: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    """A word's shard; for the ``heavy`` words that of the pair."""
    spread = np.where(np.isin(words, heavy), words ^ mix(contexts + np.uint64(1)), words)
    return (mix(spread) % np.uint64(shards)).astype(np.int64)


def routed(rows: DataFrame, heavy: np.ndarray, shards: int) -> DataFrame:
    """Per shard and batch of texts one packed row, and per batch one with its ids, for no shard (below 0)."""

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, squeeze, number = WordHashes(), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in pieces(batch, 3, BATCH):
                key, known_id = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                trained = np.array(part.column(2).to_pylist(), bool)
                text, words, contexts = sequences(part.column(3).to_pylist(), hashes)
                shard = shard_of(words, contexts, heavy, shards)
                order = np.lexsort((contexts, words, text, shard))
                shard, text, words, contexts = shard[order], text[order], words[order], contexts[order]
                new = np.ones(len(order), bool)
                new[1:] = (shard[1:] != shard[:-1]) | (text[1:] != text[:-1]) | (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(order)))
                shard, text, words, contexts = shard[at], text[at], words[at], contexts[at] & np.uint64((1 << CONTEXT_BITS) - 1)
                used, begins = np.unique(shard, return_index=True)
                blobs = [squeeze.compress(flatten({"key": key, "known": known_id.astype(bool)}))]
                for lo, hi in zip(begins, np.append(begins[1:], len(shard)), strict=True):
                    texts, n = np.unique(text[lo:hi], return_counts=True)
                    w, wi = np.unique(words[lo:hi], return_inverse=True)
                    c, ci = np.unique(contexts[lo:hi], return_inverse=True)
                    blobs.append(squeeze.compress(flatten({
                        "text": small(texts), "trained": trained[texts], "n": small(n), "w": w, "wi": small(wi),
                        "c": np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8]).ravel(), "ci": small(ci), "times": small(times[lo:hi]),
                    })))
                shard_column = np.concatenate([[-1 - number % shards], used]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard_column), pa.array([number] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "batch", "blob"])
                number += 1

    return rows.select("key", "known_id", "trained", "text").mapInArrow(route, "shard int, batch long, blob binary")


def small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


class Shard:
    """The pairs that were sent to one shard; ``text`` numbers the texts of all its batches through."""

    def __init__(self, blobs: list[tuple[int, bytes]]):
        open_ = zstandard.ZstdDecompressor().decompress
        parts = [unflatten(open_(b)) for _, b in blobs]
        self.batches = [(batch, p["text"]) for (batch, _), p in zip(blobs, parts, strict=True)]
        joined = lambda name, kind: np.concatenate([p[name].astype(kind) for p in parts])
        trained = joined("trained", bool)
        self.n_texts = len(trained)
        self.text = np.repeat(np.arange(self.n_texts), joined("n", np.int64))
        self.times = joined("times", np.int64)
        wide = lambda c: np.pad(c.reshape(-1, CONTEXT_BITS // 8), ((0, 0), (0, 8 - CONTEXT_BITS // 8))).view("<u8").ravel()
        words = np.concatenate([p["w"][p["wi"]] for p in parts])
        contexts = np.concatenate([wide(p["c"])[p["ci"]] for p in parts])
        self.words, word = np.unique(words, return_inverse=True)
        order = np.lexsort((contexts, word))
        w, c = word[order], contexts[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        self.pair = np.empty(len(order), np.int64)  # distinct pair of each row
        self.pair[order] = np.cumsum(new) - 1
        self.pair_word, self.pair_context = w[at], c[at]
        counted = np.where(trained[self.text], self.times, 0)
        self.pair_count = np.bincount(self.pair, counted, len(at)).astype(np.int64)
        self.word_count = np.bincount(self.pair_word, self.pair_count, len(self.words)).astype(np.int64)

    def trie(self, heavy: dict[int, int], total: int, distinct: int, prior: float) -> bytes:
        """Words and pairs of the training rows; counts of heavy words are those of all shards."""
        for w, n in heavy.items():
            i = np.searchsorted(self.words, np.uint64(w))
            if i < len(self.words) and self.words[i] == np.uint64(w):
                self.word_count[i] = n
        known = np.flatnonzero(self.word_count)
        seen = np.flatnonzero(self.pair_count)
        p = (self.word_count[self.pair_word[seen]] + 1) / (total + distinct + 1)
        return Trie.build(self.words[known], self.word_count[known], np.searchsorted(known, self.pair_word[seen]), self.pair_context[seen], np.log10(self.pair_count[seen] + prior * p))

    def sums(self, trie: Trie, total: int, distinct: int, starts: int, prior: float) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, and the two sums of logarithms."""
        index = trie.find(self.words)
        count = trie.count(index)
        log_p = np.log10((count + 1) / (total + distinct + 1))
        after = np.where(self.words == END, np.log10(starts + prior), np.log10(count + prior))  # each text has one start and one end
        found = trie.pair_logs(index[self.pair_word], self.pair_context)
        pair = np.where(np.isnan(found), np.log10(prior) + log_p[self.pair_word], found) - after[self.pair_word]
        word, n = self.pair_word[self.pair], self.n_texts
        add = lambda values: np.bincount(self.text, values * self.times, n)
        return {
            "tokens": add(1), "known": add(count[word] > 0),
            "base": add(log_p[word]), "score": add(pair[self.pair]),
        }


def by_first(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The other columns of all rows with one value in the first, from rows sorted by it."""
    at, rows = None, []
    for batch in batches:
        for first, *others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first != at and rows:
                yield at, rows
                rows = []
            at = first
            rows.append(tuple(others))
    if rows:
        yield at, rows


class Fitted:
    """What must be known before pairs are sent: sizes and the heavy words."""

    def __init__(self, rows: DataFrame, per_shard: int, prior: float):
        counts = materialise(word_counts(rows), "words")
        known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("word").alias("distinct")).first()
        self.total, self.distinct, self.prior = known.total, known.distinct, prior
        self.shards = max(LEAST_SHARDS, -(-self.total // per_shard))
        ends = counts.where(F.col("word") == int(END)).collect()
        self.starts = ends[0].n if ends else 0
        heavy = counts.where(F.col("n") * 4 * self.shards >= max(1, self.total)).collect()  # 4 for each shard at most
        self.heavy = {r.word % (1 << 64): r.n for r in heavy}

    def sorted_blobs(self, rows: DataFrame) -> DataFrame:
        keys = np.array(sorted(self.heavy), np.uint64)
        return routed(rows, keys, self.shards).repartition(self.shards, "shard").sortWithinPartitions("shard")


def prepared(docs: DataFrame, trained: str, id_col: str, text_col: str) -> DataFrame:
    """``trained`` is a SQL condition on the columns of ``docs``."""
    key = col(id_col).cast("long")
    return docs.select(
        F.coalesce(key, F.lit(0)).alias("key"), key.isNotNull().alias("known_id"),
        F.coalesce(F.expr(trained), F.lit(False)).alias("trained"), F.coalesce(col(text_col), F.lit("")).alias("text"),
    )


def tries(docs: DataFrame, trained: str = "true", id_col: str = "doc_id", text_col: str = "text", per_shard: int = PER_SHARD, prior: float = PRIOR) -> DataFrame:
    """``shard`` and ``trie``, the bytes of its trie."""
    rows = prepared(docs, trained, id_col, text_col).where("trained")
    fitted = Fitted(rows, per_shard, prior)
    heavy, total, distinct = fitted.heavy, fitted.total, fitted.distinct

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in by_first(batches):
            if shard < 0:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([Shard(blobs).trie(heavy, total, distinct, prior)], pa.binary())], ["shard", "trie"])

    return fitted.sorted_blobs(rows).mapInArrow(build, "shard int, trie binary")


def score(docs: DataFrame, trained: str, id_col: str = "doc_id", text_col: str = "text", per_shard: int = PER_SHARD, prior: float = PRIOR) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (of single words) and ``score``."""
    rows = prepared(docs, trained, id_col, text_col)
    fitted = Fitted(rows, per_shard, prior)
    heavy, total, distinct, starts = fitted.heavy, fitted.total, fitted.distinct, fitted.starts

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for number, rows in by_first(batches):
            if number >= 0:
                shard = Shard(rows)
                sums = shard.sums(Trie.mapped(shard.trie(heavy, total, distinct, prior)), total, distinct, starts, prior)
                out, at = [], 0
                for batch, texts in shard.batches:
                    cut = slice(at, at + len(texts))
                    at += len(texts)
                    out.append((batch, squeeze.compress(flatten({
                        "text": texts, "tokens": small(sums["tokens"][cut].astype(np.int64)), "known": small(sums["known"][cut].astype(np.int64)),
                        "base": sums["base"][cut], "score": sums["score"][cut].astype(np.float32),
                    }))))
                rows = out
            batch, blob = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array([number >= 0] * len(rows)), pa.array(blob, pa.binary())], ["batch", "sums", "blob"])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for _, rows in by_first(batches):
            parts = [unflatten(open_(b)) for is_sums, b in rows if is_sums]
            ids = next(unflatten(open_(b)) for is_sums, b in rows if not is_sums)
            n = len(ids["key"])
            each = {name: np.zeros(n) for name in ("tokens", "known", "base", "score")}
            for p in parts:
                for name, total_of in each.items():
                    total_of[p["text"]] += p[name]  # a text comes once per shard
            key = pa.array(ids["key"], mask=~ids["known"])
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(each["tokens"].astype(np.int64)), pa.array(each["known"].astype(np.int64)), pa.array(each["base"]), pa.array(each["score"])],
                ["id", "n_tokens", "n_known", "base_score", "score"],
            )

    found = fitted.sorted_blobs(rows).mapInArrow(look_up, "batch long, sums boolean, blob binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = found.repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(add_up, "id long, n_tokens long, n_known long, base_score double, score double")
    kind = docs.schema[id_col].dataType.simpleString()
    return added.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
