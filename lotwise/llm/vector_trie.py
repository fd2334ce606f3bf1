"""Spelling variants: words at one edit from each other, found in a trie of letter-group counts.

``words`` counts the words of all texts. A word is a vector of counts, one for each of ``GROUPS`` (a letter in none of them
belongs to a last one); in the trie the words are arranged by these counts, one level for each. One edit changes at most two
counts: an inserted letter is a surplus of one, a deleted letter a deficit of one, a replaced letter one of each or
none. A depth-first search therefore goes down with one unit of either to spend, and the words of the leaves that it
reaches are verified letter by letter. One walk down serves a block of searches.

The trie is cut where it is small enough: a node with more than ``limit`` words below it is an upper one, and those are known
to all tasks (their number is at most levels * words / limit, and ``limit`` grows with the words so that this stays under
levels * ``PARTS``). Below an upper node each subtree is a part of its own. A search starts in the upper nodes and sends the
word to each part that it reaches; in a part, sorted rows bring the words of the subtree first and then the searches, block
by block, so a task holds one subtree of at most ``limit`` words. A single leaf with more words is dealt over several parts,
each of which gets all the searches that reach it.

``variants`` gives each word its form, the most frequent word at one edit, if it is ``ratio`` times as frequent, and its root,
where the forms end. Each step multiplies the count, so forms have no cycles and less than 64 / log2(ratio) steps, and
doubling the steps finds all roots in a fixed number of rounds.

Null texts have no words; a null id counts as an empty one. Every row counts, also a repeated one. No rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import col
from lotwise.session import materialise

RUNS = re.compile("[a-zÀ-ÿ]+")
GROUPS = ("e", "a", "i", "n", "t", "r", "s", "o", "l", "d", "u", "h", "c", "m", "p", "g", "bv", "fk", "wy", "éèêë", "àâäáç", "ôöóùûü", "ñîïíß")
GROUP_OF = {letter: g for g, letters in enumerate(GROUPS) for letter in letters}
LEVELS = len(GROUPS) + 1
LIMIT = 20_000
PARTS = 5_000
FEW = 16  # leaves that are looked at together
BLOCK = 16_384  # searches that go down together
PAIRS = 200_000  # pairs that are verified together
WIDTH = 40  # letters of a word that are compared as a row

Vector = tuple[int, ...]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 199, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(``word``, ``n``): runs of letters with A-Z lower-cased, of ``min_chars`` code points and ``min_count`` occurrences or more.

    With h the crc32 of ``<id>:<run>``, a run loses its code point h % length where ``noise`` divides h (0: no run does).
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(b"%s:" % id_.encode())
                for run, n in Counter(RUNS.findall((text or b"").lower().decode())).items():  # bytes.lower changes A-Z only
                    if len(run) >= min_chars:
                        h = zlib.crc32(run.encode(), start)
                        if noise and h % noise == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_chars:
                                continue
                        found[run] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text_col).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def vector(word: str) -> Vector:
    counts = [0] * LEVELS
    for letter in word:
        counts[GROUP_OF.get(letter, LEVELS - 1)] += 1
    return tuple(counts)


def name(prefix: Vector) -> str:
    return ",".join(map(str, prefix))


def upper_nodes(rows: DataFrame, limit: int) -> dict[Vector, int]:
    """Nodes with more than ``limit`` words below them, the root included, with the number of these words."""

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for word in batch.column(0).to_pylist():
                v = vector(word)
                found.update(name(v[:d]) for d in range(LEVELS + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["node", "n"])

    sizes = rows.select("word").mapInArrow(prefixes, "node string, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return {tuple(map(int, r.node.split(","))) if r.node else (): r.n for r in sizes.where(F.col("n") > limit).collect()}


def home(v: Vector, upper: dict[Vector, int]) -> Vector:
    """The subtree that holds vector ``v``: its first node that is not an upper one, or its leaf."""
    return next((v[:d] for d in range(LEVELS) if v[:d] not in upper), v)


def reached(v: Vector, upper: dict[Vector, int]) -> list[Vector]:
    """The subtrees that a search for ``v`` reaches."""
    out, open_ = [], [((), 1, 1)]
    while open_:
        prefix, surplus, deficit = open_.pop()
        d = len(prefix)
        if d == LEVELS or prefix not in upper:
            out.append(prefix)
            continue
        open_.append(((*prefix, v[d]), surplus, deficit))
        if surplus:
            open_.append(((*prefix, v[d] + 1), 0, deficit))
        if deficit and v[d]:
            open_.append(((*prefix, v[d] - 1), surplus, 0))
    return out


class Trie:
    """Words (``word``, ``n``) in order of their vectors. A node is a range of leaves that agree in the first counts; a leaf is a
    vector with its words."""

    def __init__(self, words: list[str], n: list[int]):
        vectors = np.array([vector(w) for w in words], np.int32).reshape(-1, LEVELS)
        order = np.lexsort(vectors.T[::-1])
        new = np.ones(len(words), bool)
        new[1:] = (np.diff(vectors[order], axis=0) != 0).any(1)
        self.leaves = vectors[order][new]
        self.first = np.append(np.flatnonzero(new), len(words))
        self.words = [words[i] for i in order]
        self.n = np.array(n, np.int64)[order]
        self.letters = Letters(self.words)

    def reached(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(search, leaf) within the budgets. One depth-first walk serves many searches: each node keeps those that still reach it."""
        every = np.arange(len(vectors))
        stack = [(0, 0, len(self.leaves), every, np.ones(len(every), np.int8), np.ones(len(every), np.int8))]
        found = [(every[:0], every[:0])]
        while stack:
            d, lo, hi, who, surplus, deficit = stack.pop()
            if not len(who):
                continue
            if hi - lo <= FEW or d == LEVELS:  # few leaves: all their other counts at once
                gap = self.leaves[lo:hi, d:][None] - vectors[who, d:][:, None]
                more = np.maximum(gap, 0).sum(2)
                ok = (more <= surplus[:, None]) & (more - gap.sum(2) <= deficit[:, None])
                search, leaf = np.nonzero(ok)
                found.append((who[search], lo + leaf))
                continue
            counts = self.leaves[lo:hi, d]
            starts = np.flatnonzero(np.append(True, counts[1:] != counts[:-1]))
            own = vectors[who, d]
            for start, stop in zip(starts, np.append(starts[1:], hi - lo), strict=True):
                gap = counts[start] - own
                ok = np.flatnonzero((gap == 0) | ((gap == 1) & (surplus > 0)) | ((gap == -1) & (deficit > 0)))
                stack.append((d + 1, lo + start, lo + stop, who[ok], surplus[ok] - (gap[ok] == 1), deficit[ok] - (gap[ok] == -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near(self, searches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(search, word) at exactly one edit, as places in ``searches`` and ``self.words``."""
        if not searches or not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        search, leaf = self.reached(np.array([vector(w) for w in searches], np.int32))
        sizes = np.diff(self.first)[leaf]
        letters, found = Letters(searches), []
        upto = np.cumsum(sizes)
        at = 0
        while at < len(leaf):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            own = sizes[at:stop]
            inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            pairs = np.repeat(search[at:stop], own), np.repeat(self.first[leaf[at:stop]], own) + inside
            ok = letters.one_edit(pairs[0], self.letters, pairs[1])
            found.append((pairs[0][ok], pairs[1][ok]))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (search, leaf)


class Letters:
    """Words as rows of letters (one byte each), from the left and from the right; words beyond ``WIDTH`` as they are."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        short = [w.encode("latin-1") if len(w) <= WIDTH else b"" for w in words]
        table = lambda rows: np.array(rows, f"S{WIDTH}").view(np.uint8).reshape(len(rows), WIDTH)
        self.left, self.right = table(short), table([w[::-1] for w in short])

    def one_edit(self, mine: np.ndarray, other: Letters, theirs: np.ndarray) -> np.ndarray:
        """For pairs of places: whether one inserted, deleted or replaced letter makes one word into the other."""
        a, b = self.size[mine], other.size[theirs]
        differs = self.left[mine] != other.left[theirs]
        ok = (a == b) & (differs.sum(1) == 1)
        at = np.flatnonzero(np.abs(a - b) == 1)
        ends = [np.where(d.any(1), d.argmax(1), WIDTH) for d in (differs[at], self.right[mine[at]] != other.right[theirs[at]])]
        ok[at] = ends[0] + ends[1] >= np.minimum(a[at], b[at])
        for i in np.flatnonzero(np.maximum(a, b) > WIDTH):
            ok[i] = one_edit(self.words[mine[i]], other.words[theirs[i]])
        return ok


def one_edit(x: str, y: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``x`` into ``y``."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    at = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[at + (len(x) == len(y)) :] == y[at + 1 :]


def near_words(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(``word``, ``n``, ``other``, ``other_n``) for all pairs of words (``word``, ``n``) at one edit, both ways round."""
    limit = limit or max(LIMIT, rows.count() // PARTS)
    upper = upper_nodes(rows, limit)
    known = rows.sparkSession.sparkContext.broadcast(upper)
    parts_of = lambda node: -(-known.value[node] // limit) if len(node) == LEVELS and node in known.value else 1

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word to its subtree, and as a search to all subtrees in reach."""
        for batch in batches:
            at, node_names, dealt, asks = [], [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                v = vector(word)
                node = home(v, known.value)
                for reached_node, search in ((node, False), *((x, True) for x in reached(v, known.value))):
                    parts = parts_of(reached_node)
                    for part in range(parts) if search else (zlib.crc32(word.encode()) % parts,):
                        at.append(i)
                        node_names.append(name(reached_node))
                        dealt.append(part)
                        asks.append(search)
            rows_at = pa.array(at, pa.int64())
            columns = [pa.array(node_names, pa.string()), pa.array(dealt, pa.int32()), pa.array(asks, pa.bool_()), batch.column(0).take(rows_at), batch.column(1).take(rows_at)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "part", "search", "word", "n"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, the words before the searches."""
        at, words, n, trie = None, [], [], None
        for batch in batches:
            node, part, asks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys = list(zip(node, part, asks, strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if keys[start][:2] != at:
                    at, words, n, trie = keys[start][:2], [], [], None
                own = [batch.column(i).slice(start, stop - start) for i in (3, 4)]
                if not keys[start][2]:
                    words += own[0].to_pylist()
                    n += own[1].to_pylist()
                    continue
                if trie is None:
                    trie = Trie(words, n)
                for first in range(0, stop - start, BLOCK):
                    some = [c.slice(first, BLOCK) for c in own]
                    mine, theirs = trie.near(some[0].to_pylist())
                    other = pa.array([trie.words[i] for i in theirs], pa.string())
                    yield pa.RecordBatch.from_arrays([some[0].take(pa.array(mine)), some[1].take(pa.array(mine)), other, pa.array(trie.n[theirs])], ["word", "n", "other", "other_n"])

    sent = rows.select("word", "n").mapInArrow(send, "node string, part int, search boolean, word string, n long")
    parted = sent.repartition("node", "part").sortWithinPartitions("node", "part", "search")
    return parted.mapInArrow(search, "word string, n long, other string, other_n long")


def roots(links: DataFrame, ratio: int) -> DataFrame:
    """(``word``, ``root``) of words that have a form, by doubling the steps."""
    links = materialise(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(math.ceil(math.log2(64 / math.log2(ratio)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialise(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links


def variants(rows: DataFrame, ratio: int = 5, limit: int | None = None) -> DataFrame:
    """Each word (``word``, ``n``) with ``form``, ``root``, ``n_near`` (words at one edit) and ``form_n``."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    rows = materialise(rows.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(rows, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = rows.join(near, "word", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    formed = materialise(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"),
    ), "formed")
    ends = roots(formed.where("form is not null"), ratio)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
