"""Gradient-boosted trees over histograms: many models of one table at a time, one pass over the rows per level of a tree.

Rows are binned once by quantiles and packed in chunks of numpy columns: the bins of the features, label, fold, list, and for
every model the score and the gradients. A list (the rows that a ranker compares) of more than ``CHUNK`` rows is dealt into pieces
of about that many by the hash of the key; it is compared as a whole all the same. With many models a chunk has fewer rows
(``CELLS``), but for a list or piece that has more.

Models do not need each other, so while the rows of one fit a task (``WHOLE``) the models are dealt over the tasks, and each task
grows its own from all chunks without any exchange; rows that cannot teach a model are left out of it, and of two children only
the smaller one is summed up, as the other is what is left of their parent.

More rows than that stay in their chunks, and all models (folds, combinations, draws) grow together. Per tree each chunk first adds
the last tree to its scores and takes the gradients, which is kept for the levels of the tree; for lists in pieces, the first ``k``
rows of the whole list are found before, and what all pieces pull at them is added up. Per level each task sums its chunks'
gradients by node, feature and bin, the sums of all tasks are added by (model, node), by the driver while they are at most
``DRIVER_SUMS`` bytes and else in a shuffle whose one row per (model, node), its best split, comes back to the driver. The
state is written to the shared folder every ``KEEP`` trees; between them a lost part is made anew from the last written one.

Both ways give the same trees: gradients are rounded to a fixed grid, so sums do not depend on how the rows are laid out.

A model does not learn from rows of its ``fold``; ``out_of_fold`` scores them after any number of trees, so that 100, 200 and
300 trees are one run with three looks. Leaves are Newton steps with L2 penalty ``PENALTY``. A missing value is above all others.
"""

from __future__ import annotations

import bisect
import math
import pickle
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.session import drop_table, write_table

CHUNK = 1 << 16
CELLS = 1 << 19  # rows times models of a chunk, so that its scores, gradients and weights stay small
WHOLE = 1 << 21  # rows that one task holds at once to grow a model by itself, some 150 bytes each
BINS = 64
KEEP = 20
PENALTY = 1.0
GRID = float(1 << 30)  # gradients are multiples of 1 / GRID
LONG = 256  # rows of a list that is worked on by itself
BLOCK = 2048  # rows whose pairs are held at once
SPREAD = 600.0  # of scores whose exponentials are safely divided
DRIVER_SUMS = 1 << 25  # bytes of sums of a level that the driver adds up itself
ALL_LEFT = BINS  # threshold of a node that is not split


@dataclass(frozen=True)
class Spec:
    """One model; it does not learn from rows of ``fold``."""

    depth: int = 4
    rate: float = 0.05
    seed: int = 42
    fold: int | None = None


def walk(feature: np.ndarray, upto: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """Trees by rows: number, within its level, of the node where a row is after ``levels`` decisions; ``bins`` is features by rows."""
    tree, rows = np.arange(len(feature))[:, None], np.arange(bins.shape[1])
    at = np.zeros((len(feature), bins.shape[1]), np.int64)
    for level in range(levels):
        node = at + (1 << level) - 1
        at = 2 * at + (bins[feature[tree, node], rows] > upto[tree, node])
    return at


def move(at: np.ndarray, feature: np.ndarray, upto: np.ndarray, bins: np.ndarray, level: int) -> np.ndarray:
    """Numbers of the nodes below, for rows at the nodes ``at`` of a level of one tree."""
    right = np.zeros(len(at), bool)
    for i in range(1 << level):
        node = i + (1 << level) - 1
        if upto[node] != ALL_LEFT:
            goes = bins[feature[node]] > upto[node]
            right |= goes & (at == i) if level else goes
    return at * 2 + right


def leaves(feature: np.ndarray, upto: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """Number of the leaf of every row in one tree."""
    if depth > 7:  # decisions one by one are cheaper for few nodes only
        return walk(feature[None], upto[None], bins, depth)[0]
    at = np.zeros(bins.shape[1], np.uint8)
    for level in range(depth):
        at = move(at, feature, upto, bins, level)
    return at


def portions(models: Sequence[int], rows: int, most: int = 2_000_000) -> Iterator[np.ndarray]:
    """Models a few at a time, so that a table of models by rows stays small."""
    size = max(1, most // max(1, rows))
    for i in range(0, len(models), size):
        yield np.array(models[i : i + size])


@dataclass
class Tree:
    """A full tree in heap order: per inner node a feature and the last bin that goes left, per leaf a value, per node the
    curvature of the rows below it (``cover``)."""

    feature: np.ndarray
    upto: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = (1 << depth) - 1
        return cls(np.zeros(inner, np.int16), np.full(inner, ALL_LEFT, np.int16), np.zeros(inner + 1), np.zeros(2 * inner + 1))

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[leaves(self.feature, self.upto, bins, self.depth)]

    def expected(self) -> float:
        """Mean of the leaves by the cover below them."""
        below = self.cover[len(self.feature) :]
        return float(self.value @ below / below.sum()) if below.sum() else float(self.value[0])

    def contributions(self, bins: np.ndarray) -> np.ndarray:
        """Exact Shapley values, features by rows. What a leaf adds is its value times a product over the features on its path:
        whether the row passes them, or, where a feature is unknown, the share of the cover that does."""
        out = np.zeros(bins.shape)
        inner = len(self.feature)
        for leaf in range(len(self.value)):
            at, path = inner + leaf, {}
            while at:
                up, right = (at - 1) // 2, at % 2 == 0
                if self.upto[up] != ALL_LEFT:
                    f = int(self.feature[up])
                    passed, share = path.get(f, (np.ones(bins.shape[1], bool), 1.0))
                    path[f] = passed & ((bins[f] > self.upto[up]) == right), share * self.cover[at] / (self.cover[2 * up + 1] + self.cover[2 * up + 2])
                elif right:
                    break  # nothing goes there
                at = up
            if at or not path:
                continue
            for f, (passed, share) in path.items():
                others = [p for g, p in path.items() if g != f]
                known = np.zeros((len(path), bins.shape[1]))  # by how many of the other features are known
                known[0] = 1.0
                for n, (ok, part) in enumerate(others, 1):
                    known[1 : n + 1], known[0] = known[1 : n + 1] * part + known[:n] * ok, known[0] * part
                order = np.array([math.factorial(k) * math.factorial(len(others) - k) for k in range(len(path))]) / math.factorial(len(path))
                out[f] += self.value[leaf] * (passed - share) * (order @ known)
        return out


@dataclass
class Boosted:
    """Trees of all models, and the bin edges that they refer to."""

    specs: list[Spec]
    features: list[str]
    edges: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)  # per step, per model

    def inputs(self) -> list[Column]:
        return [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)]

    def score(self, df: DataFrame, keep: Sequence[str], models: Sequence[int] | None = None) -> DataFrame:
        """``keep``, ``model`` and ``score``: one row per row and model, each batch of rows by all trees."""
        models = list(range(len(self.specs))) if models is None else list(models)
        known = df.sparkSession.sparkContext.broadcast((self.edges, [[step[m] for step in self.trees] for m in models], [self.specs[m].rate for m in models]))
        n = len(keep)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, trees, rates = known.value
            for batch in batches:
                bins = binned(batch.columns[n:], edges)
                for m, own, rate in zip(models, trees, rates, strict=True):
                    score = np.zeros(batch.num_rows)
                    for tree in own:
                        score += rate * tree.predict(bins)
                    columns = [*batch.columns[:n], pa.array(np.full(batch.num_rows, m), pa.int32()), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "model", "score"])

        rows = df.select(*keep, *self.inputs())
        rows = dealt_out(rows) if len(models) > 1 else rows
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
        return rows.mapInArrow(run, f"{kept}, model int, score double")

    def expected(self, model: int = 0) -> float:
        """The score of a row of which nothing is known."""
        return self.specs[model].rate * sum(step[model].expected() for step in self.trees)

    def out_of_fold(self, df: DataFrame, keep: Sequence[str], looks: Sequence[int], fold: str = "fold") -> DataFrame:
        """``keep``, ``model``, ``n_estimators`` and ``score``: each row by the models that have not seen its fold, after each number of trees."""
        known = df.sparkSession.sparkContext.broadcast((self.edges, self.trees, self.specs))
        n = len(keep)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, trees, specs = known.value
            for batch in batches:
                folds = batch.column(n).to_numpy(zero_copy_only=False)
                for held in np.unique(folds):
                    models = [m for m, s in enumerate(specs) if s.fold == held]
                    rows = batch.take(pa.array(np.flatnonzero(folds == held)))
                    bins = binned(rows.columns[n + 1 :], edges)
                    scores = np.zeros((len(models), rows.num_rows))
                    for step, own in enumerate(trees, 1):
                        for m, score in zip(models, scores, strict=True):
                            score += specs[m].rate * own[m].predict(bins)
                        for m, score in zip(models, scores, strict=True) if step in looks else ():
                            columns = [*rows.columns[:n], *(pa.array(np.full(rows.num_rows, x), pa.int32()) for x in (m, step)), pa.array(score)]
                            yield pa.RecordBatch.from_arrays(columns, [*keep, "model", "n_estimators", "score"])

        rows = dealt_out(df.where(F.col(fold).isNotNull()).select(*keep, F.col(fold).cast("int").alias("_fold"), *self.inputs()))
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
        return rows.mapInArrow(run, f"{kept}, model int, n_estimators int, score double")

    def contributions(self, df: DataFrame, keep: Sequence[str], model: int = 0, prefix: str = "shap_") -> DataFrame:
        """``keep`` and the Shapley values of one model's score, a column per feature; they add up to the score less its mean."""
        known = df.sparkSession.sparkContext.broadcast((self.edges, [step[model] for step in self.trees], self.specs[model].rate))
        n, names = len(keep), [prefix + f for f in self.features]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, trees, rate = known.value
            for batch in batches:
                bins = binned(batch.columns[n:], edges)
                total = np.zeros(bins.shape)
                for tree in trees:
                    total += rate * tree.contributions(bins)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, total)], [*keep, *names])

        rows = df.select(*keep, *self.inputs())
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
        return rows.mapInArrow(run, ", ".join([kept, *[f"`{c}` double" for c in names]]))


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows that cost far more than their shuffle, spread over all cores, as a few files would not be."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last, per feature."""
    shares = [i / bins for i in range(1, bins)]
    wanted = [F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), shares, 10_000).alias(f) for f in features]
    row = df.agg(*wanted).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def binned(columns: Sequence[pa.Array], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Features by rows; null and NaN are in the last bin."""
    values = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]
    found = [np.where(np.isnan(v), BINS - 1, np.searchsorted(e, v)) for v, e in zip(values, edges, strict=True)]
    return np.array(found, np.uint8).reshape(len(columns), -1)


# --- packed chunks -------------------------------------------------------------------------------------------
STATE = (
    "n int, split int, names array<string>, pieces binary, piece binary, keys binary, labels binary, folds binary, lists binary, bins binary, "
    "weights binary, scores binary, grads binary, hess binary"
)
KINDS = {
    "pieces": np.int32, "piece": np.int32,  # of each list: into how many it was dealt, and the number of this one
    "keys": np.int64, "labels": np.float64, "folds": np.int16, "lists": np.int32, "bins": np.uint8, "weights": np.float64, "scores": np.float64, "grads": np.float64, "hess": np.float64,
}


def unpacked(batch: pa.RecordBatch) -> Iterator[dict]:
    for row in batch.to_pylist():
        n, names, _ = row.pop("n"), row.pop("names"), row.pop("split")
        chunk = {k: np.frombuffer(v, KINDS[k]) for k, v in row.items()}
        for k in ("bins", "weights", "scores", "grads", "hess"):
            chunk[k] = chunk[k].reshape(-1, n) if n else chunk[k].reshape(0, 0)
        yield {"names": names, **chunk}


def repacked(chunk: dict) -> pa.RecordBatch:
    sizes = len(chunk["keys"]), int((chunk["pieces"] > 1).sum())
    columns = [*(pa.array([x], pa.int32()) for x in sizes), pa.array([chunk["names"]], pa.list_(pa.string()))]
    columns += [pa.array([np.ascontiguousarray(chunk[k], kind).tobytes()], pa.binary()) for k, kind in KINDS.items()]
    return pa.RecordBatch.from_arrays(columns, ["n", "split", "names", *KINDS])


def packed(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray], n_models: int, weights: Sequence[Column], key: str, label: str, query: str | None, fold: str | None) -> DataFrame:
    """The table in chunks, without scores yet."""
    named = rows.withColumn("_list", F.coalesce(F.concat(F.lit("="), F.col(query or key).cast("string")), F.lit("")))
    if query:
        sizes = named.groupBy("_list").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > CHUNK)
        pieces = F.ceil(F.coalesce("_size", F.lit(1)) / CHUNK).cast("int")
        dealt = F.pmod(F.xxhash64(F.col(key).cast("long")), F.col("_pieces")).cast("int")
        named = named.join(sizes, "_list", "left").withColumn("_pieces", pieces).withColumn("_dealt", dealt).drop("_size")
    else:
        named = named.withColumns({"_pieces": F.lit(1), "_dealt": F.lit(0)})
    n_rows = rows.count()
    size = max(1, min(CHUNK, CELLS // max(1, n_models))) if n_rows > CHUNK else CHUNK  # rows that fill one chunk stay one
    share = CHUNK // max(1, min(4, 32 // max(1, n_models)))  # rows of a task; with many models, its sums are large
    if n_rows <= WHOLE:
        share = max(1, CHUNK // 16)
    parts = max(1, -(-n_rows // share)) if n_rows > min(share, CHUNK) else 1
    n_features = len(features)
    own = [F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]]
    placed = named.repartition(parts, "_list", "_dealt").sortWithinPartitions("_list", "_dealt", *own).select(  # rows of one key in any order would be another result
        *own, F.col("_list").alias("list"), F.col("_pieces").alias("pieces"), F.col("_dealt").alias("dealt"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
        F.array(*[w.cast("double") for w in weights]).cast("array<double>").alias("draws"),  # only here, so that they are not shuffled
    )

    def chunk_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        n = table.num_rows
        begins = np.array([0, *(begins_of(table) if query else ())], int)
        lists = np.zeros(n, int)
        lists[begins[1:]] = 1
        draws = table.column("draws").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T
        first = {c: table.column(c).take(pa.array(begins)) for c in ("list", "pieces", "dealt")}
        return repacked({
            "names": first["list"].to_pylist() if query else [], "pieces": first["pieces"].to_numpy(), "piece": first["dealt"].to_numpy(),
            "keys": table.column("key").to_numpy(), "labels": table.column("label").to_numpy(), "folds": table.column("fold").to_numpy(),
            "lists": np.cumsum(lists), "weights": draws,
            "bins": binned([table.column(f"x{i}").combine_chunks() for i in range(n_features)], edges),
            "scores": np.zeros((0, n)), "grads": np.zeros((0, n)), "hess": np.zeros((0, n)),
        })

    def begins_of(table: pa.Table) -> np.ndarray:
        """Rows, but the first, with which a list or piece begins; without lists every row is one."""
        if not query:
            return np.arange(1, table.num_rows)
        names = table.column("list").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return np.flatnonzero((np.diff(names) != 0) | (np.diff(table.column("dealt").to_numpy()) != 0)) + 1

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:  # cut where lists begin
                table = pa.Table.from_batches(held).combine_chunks()
                begins = begins_of(table).tolist()
                at = 0
                while table.num_rows - at >= size and (more := begins[bisect.bisect_right(begins, at) :]):
                    cut = more[max(0, bisect.bisect_right(more, at + size) - 1)]  # the last that fits, or else the next
                    yield chunk_of(table.slice(at, cut - at).to_batches())
                    at = cut
                held = table.slice(at).to_batches()
        if sum(b.num_rows for b in held):
            yield chunk_of(held)

    return placed.mapInArrow(pack, STATE)


# --- gradients -----------------------------------------------------------------------------------------------
def logistic_gradients(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-scores))
    return labels - p, np.maximum(p * (1.0 - p), 1e-16)


@dataclass
class Heads:
    """The first rows of lists, lists by ranks: their places among the rows at hand (-1: not among them), scores, labels and
    whether there are so many; per list what the best order would gain."""

    row: np.ndarray
    score: np.ndarray
    label: np.ndarray
    there: np.ndarray
    best: np.ndarray


class Lists:
    """Rows that come by list, for the gradients of the NDCG@k pair loss: pairs of a row with the first k of its list, weighed by
    what their swap would change. Equal scores are ranked by key."""

    def __init__(self, labels: np.ndarray, lists: np.ndarray, keys: np.ndarray, k: int):
        n = len(labels)
        self.labels, self.lists, self.keys, self.k = labels, lists, keys, k
        self.first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if n else np.zeros(0, int)
        self.count = np.diff(np.append(self.first, n))
        self.which = np.repeat(np.arange(len(self.first)), self.count)
        self.by_key = bool(np.all((lists[1:] != lists[:-1]) | (keys[1:] >= keys[:-1])))  # as chunks are: sorts are stable, so the key needs none
        self.width = min(k, int(self.count.max())) if n else 0
        self.discount = 1.0 / np.log2(np.arange(k) + 2.0)
        self.positives = np.add.reduceat(labels, self.first) if n else np.zeros(0)
        self.binary = bool(np.isin(labels, (0.0, 1.0)).all())
        self.long = np.flatnonzero(self.count > max(LONG, k))
        self.short_rows = np.flatnonzero(~np.isin(self.which, self.long))
        spans = [slice(self.first[i], self.first[i] + self.count[i]) for i in self.long]
        self.by_label = [[s.start + np.flatnonzero(labels[s] == y) for y in (0.0, 1.0)] for s in spans]

    def best(self, positives: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(self.discount)])[np.clip(positives.astype(np.int64), 0, self.k)]

    def heads(self, scores: np.ndarray) -> Heads:
        row = np.full((len(self.first), self.width), -1)
        if len(some := self.short_rows):
            which = self.which[some]
            order = some[np.lexsort((-scores[some], which) if self.by_key else (self.keys[some], -scores[some], which))]
            rank = np.arange(len(order)) - np.searchsorted(which, which)  # order keeps lists together
            top = rank < self.width
            row[which[top], rank[top]] = order[top]
        for i in self.long:
            start, n = self.first[i], self.count[i]
            own = scores[start : start + n]
            some = start + np.flatnonzero(own >= np.partition(own, n - self.k)[n - self.k])
            row[i] = some[np.lexsort((self.keys[some], -scores[some]))[: self.k]]
        return Heads(row, scores[row], self.labels[row], row >= 0, self.best(self.positives))

    def gradients(self, scores: np.ndarray, heads: Heads | None = None, known: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient, curvature, and what the rows behind the heads pull at them. For lists of which other rows lie elsewhere,
        ``heads`` has the first ones of all, and ``known``, by list, what all pull at them."""
        n = len(scores)
        grad, hess = np.zeros(n), np.zeros(n)
        if not n:
            return grad, hess, np.zeros((2, 0, 0))
        heads = heads or self.heads(scores)
        pairs = Pairs(self, scores, heads)
        here = heads.row >= 0
        rank = np.full(n, self.k)
        rank[heads.row[here]] = np.nonzero(here)[1]
        back = np.zeros((2, *heads.score.shape))
        far = (rank >= self.k) & (heads.best[self.which] > 0)
        if len(self.long) and pairs.powers:
            for i, by_label in zip(self.long, self.by_label, strict=True):
                for y, rows in enumerate(by_label):
                    rows = rows[far[rows]]
                    for j in range(0, len(rows), BLOCK):
                        some = rows[j : j + BLOCK]
                        grad[some], hess[some] = pairs.of_list(some, i, y, back)
                far[self.first[i] : self.first[i] + self.count[i]] = False
        rest = np.flatnonzero(far)
        for j in range(0, len(rest), BLOCK):
            some = rest[j : j + BLOCK]
            pull, bend = pairs.of(some, 0.0)
            grad[some], hess[some] = pull.sum(0), bend.sum(0)
            at = self.which[some]
            start = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))
            for s, x in enumerate((pull, bend)):
                back[s, at[start]] += np.add.reduceat(x, start, axis=1).T
        for i, total in (known or {}).items():
            back[:, i] = total
        here &= heads.best[:, None] > 0
        rows, lists, ranks = heads.row[here], *np.nonzero(here)
        for j in range(0, len(rows), BLOCK):
            some = slice(j, j + BLOCK)
            pull, bend = pairs.of(rows[some], self.discount[ranks[some]])
            at = lists[some], ranks[some]
            grad[rows[some]], hess[rows[some]] = pull.sum(0) - back[0][at], bend.sum(0) + back[1][at]
        return grad, hess, back


class Pairs:
    """Pull and curvature of rows by the heads of their lists: tables of ranks by rows."""

    def __init__(self, lists: Lists, scores: np.ndarray, heads: Heads):
        self.lists, self.scores, self.heads = lists, scores, heads
        self.discount = lists.discount[: heads.score.shape[1], None]
        with np.errstate(divide="ignore"):
            weight = np.where(heads.there & (heads.best[:, None] > 0), 1.0 / heads.best[:, None], 0.0)
        ends = (min(x.min() for x in (scores, heads.score[heads.there])), max(x.max() for x in (scores, heads.score[heads.there])))
        self.powers = None
        self.room, self.both, self.each = np.empty(len(self.discount) * BLOCK), np.ones((len(self.discount), 2)), np.ones((2, BLOCK))  # used again for every block
        if lists.binary and ends[1] - ends[0] < SPREAD:  # then one exponential per row will do
            middle = sum(ends) / 2.0
            self.powers = np.exp(scores - middle), np.exp(np.where(heads.there, heads.score, middle) - middle).T.copy()
            of_head = np.where(heads.there, heads.label, 0.0)
            self.weight = np.stack([weight * of_head, weight * (1.0 - of_head)], axis=1).reshape(-1, weight.shape[1]).T.copy()  # by list and label of the row
        else:
            self.weight, self.label, self.score = weight.T.copy(), heads.label.T.copy(), heads.score.T.copy()

    def of(self, rows: np.ndarray, own: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the discounts ``own``, zero behind the heads."""
        at, label = self.lists.which[rows], self.lists.labels[rows]
        gain = np.abs(self.discount - own)
        if self.powers:
            weight = self.weight.take(at * 2 + label.astype(np.int64), axis=1) * gain
            share = self.powers[0][rows]
            share = share / (share + self.powers[1].take(at, axis=1))  # one over one plus the exponential of what the head is ahead
            return (label - share) * weight, (share - share * share) * weight
        sign = label - self.label.take(at, axis=1)
        with np.errstate(over="ignore"):
            rho = 1.0 / (1.0 + np.exp(sign * (self.scores[rows] - self.score.take(at, axis=1))))
        pull = sign * rho * self.weight.take(at, axis=1) * gain
        return pull, np.abs(pull) * (1.0 - rho)

    def of_list(self, rows: np.ndarray, i: int, y: int, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums for rows of one list and label behind the heads; what they pull at these goes to ``back``."""
        weight = self.weight[:, 2 * i + y] * self.discount[:, 0]
        ranks = np.flatnonzero(weight)
        n, weight, share = len(ranks), weight[ranks], self.room[: len(ranks) * len(rows)].reshape(len(ranks), len(rows))
        both, each = self.both[:n], self.each[:, : len(rows)]
        both[:, 0] = self.powers[1][ranks, i]
        np.divide(1.0, self.powers[0][rows], out=each[0])
        np.matmul(both, each, out=share)  # one plus the quotient of the exponentials
        np.reciprocal(share, out=share)
        each = each[1]
        pull, of_heads = weight @ share, share @ each
        back[0, i, ranks] += weight * (y * len(rows) - of_heads)
        np.square(share, out=share)  # a share less its square is the curvature
        back[1, i, ranks] += weight * (of_heads - share @ each)
        return y * weight.sum() - pull, pull - weight @ share


def ndcg_gradients(scores: np.ndarray, labels: np.ndarray, lists: np.ndarray, keys: np.ndarray, k: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Of whole lists, one after the other."""
    return Lists(labels, lists, keys, k).gradients(scores)[:2]


def mixed_bits(z: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """In [0, 1) from key and seed."""
    start = mixed_bits(np.full(1, seed % (1 << 63), np.uint64))
    return (mixed_bits(keys.view(np.uint64) ^ start) >> np.uint64(11)) / float(1 << 53)


# --- growing -------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Rules:
    """What all models of a run share."""

    loss: str
    k: int
    subsample: float
    colsample: float
    least_child: float

    def drawn(self, keys: np.ndarray, seed: int, step: int) -> np.ndarray:
        """Rows that a tree of models with this seed learns from."""
        return (uniform(keys, seed * 1_000_003 + step) < self.subsample).astype(float)

    def gradients(self, chunk: dict, scores: np.ndarray, specs: Sequence[Spec], step: int, spans: Spans | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Models by rows."""
        grads, hess = np.zeros(scores.shape), np.zeros(scores.shape)
        kept = {s.seed: self.drawn(chunk["keys"], s.seed, step) for s in specs}
        lists = Lists(chunk["labels"], chunk["lists"], chunk["keys"], self.k) if self.loss == "ndcg" else None
        for m, spec in enumerate(specs):
            if lists is None:
                g, h = logistic_gradients(scores[m], chunk["labels"])
            elif spans is None:
                g, h, _ = lists.gradients(scores[m])
            else:
                g, h, _ = lists.gradients(scores[m], spans.heads(chunk, lists, scores[m], m), spans.known(chunk, m))
            weight = kept[spec.seed] if spec.fold is None else kept[spec.seed] * (chunk["folds"] != spec.fold)
            if len(chunk["weights"]):
                weight = weight * chunk["weights"][m]
            grads[m], hess[m] = on_grid(g * weight), on_grid(h * weight)
        return grads, hess


def on_grid(x: np.ndarray) -> np.ndarray:
    return np.rint(x * GRID) / GRID


def add_trees(scores: np.ndarray, trees: Sequence[Tree], specs: Sequence[Spec], bins: np.ndarray) -> None:
    for depth in {t.depth for t in trees}:
        for some in portions([m for m, t in enumerate(trees) if t.depth == depth], bins.shape[1]):
            feature, upto, value = (np.array([getattr(trees[m], x) for m in some]) for x in ("feature", "upto", "value"))
            rates = np.array([specs[m].rate for m in some])[:, None]
            scores[some] += rates * np.take_along_axis(value, walk(feature, upto, bins, depth), axis=1)


def level_sums(bins: np.ndarray, grads: np.ndarray, hess: np.ndarray, feature: np.ndarray, upto: np.ndarray, chosen: np.ndarray, level: int) -> np.ndarray:
    """Sums of gradient and curvature: (2, models, nodes, chosen features, bins)."""
    n_nodes = 1 << level
    total = np.zeros((2, len(chosen), n_nodes, chosen.shape[1], BINS))
    for some in portions(range(len(chosen)), bins.shape[1]):
        at = walk(feature[some], upto[some], bins, level) + (np.arange(len(some)) << level)[:, None]
        of = grads[some].ravel(), hess[some].ravel()
        for i in range(chosen.shape[1]):
            cell = (at * BINS + bins[chosen[some, i]]).ravel()
            for s in (0, 1):
                total[s, some, :, i] = np.bincount(cell, of[s], len(some) * n_nodes * BINS).reshape(len(some), n_nodes, BINS)
    return total


def scored(chunk: dict, specs: Sequence[Spec], last: list[Tree] | None) -> np.ndarray:
    """Models by rows, with the last trees added."""
    scores = chunk["scores"].copy() if len(chunk["scores"]) else np.zeros((len(specs), len(chunk["keys"])))
    if last is not None:
        add_trees(scores, last, specs, chunk["bins"])
    return scores


def stepped(state: DataFrame, specs: Sequence[Spec], last: list[Tree] | None, step: int, rules: Rules, spans: Broadcast | None = None) -> DataFrame:
    """The state with the last trees added to the scores, and the gradients for the next ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in unpacked(batch):
                scores = scored(chunk, specs, last)
                grads, hess = rules.gradients(chunk, scores, specs, step, spans and spans.value)
                yield repacked({**chunk, "scores": scores, "grads": grads, "hess": hess})

    return state.mapInArrow(run, STATE)


def rescored(state: DataFrame, specs: Sequence[Spec], last: list[Tree] | None) -> DataFrame:
    """The state with the last trees added to the scores, without gradients."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in unpacked(batch):
                none = np.zeros((0, len(chunk["keys"])))
                yield repacked({**chunk, "scores": scored(chunk, specs, last), "grads": none, "hess": none})

    return state.mapInArrow(run, STATE)


# --- lists in pieces -----------------------------------------------------------------------------------------
@dataclass
class Spans:
    """Of every list in pieces, by its name: the sum of its labels, by model its first rows (score, label, piece and place there),
    and then, by model, what all rows behind them pull at them. There is such a list for every ``CHUNK`` rows at most."""

    positives: dict[str, float] = field(default_factory=dict)
    first: dict[tuple[str, int], tuple[np.ndarray, ...]] = field(default_factory=dict)
    back: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)

    def heads(self, chunk: dict, lists: Lists, scores: np.ndarray, m: int) -> Heads:
        """Heads of the chunk's lists, for those in pieces the first of all pieces."""
        own = lists.heads(scores)
        places = np.flatnonzero(chunk["pieces"] > 1)
        if not len(places):
            return own
        width = max(own.row.shape[1], *(len(self.first[chunk["names"][i], m][0]) for i in places))
        out = Heads(*(np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=fill) for x, fill in ((own.row, -1), (own.score, 0.0), (own.label, 0.0), (own.there, False))), own.best.copy())
        for i in places:
            name = chunk["names"][i]
            score, label, piece, place = self.first[name, m]
            n = len(score)
            out.there[i] = np.arange(width) < n
            out.score[i, :n], out.label[i, :n], out.row[i] = score, label, -1
            out.row[i, :n] = np.where(piece == chunk["piece"][i], lists.first[i] + place, -1)
            out.best[i] = lists.best(np.array([self.positives[name]]))[0]
        return out

    def known(self, chunk: dict, m: int) -> dict[int, np.ndarray]:
        found = {int(i): self.back[chunk["names"][i], m] for i in np.flatnonzero(chunk["pieces"] > 1)}
        width = max((x.shape[1] for x in found.values()), default=0)
        return {i: np.pad(x, ((0, 0), (0, width - x.shape[1]))) for i, x in found.items()}


def spans_of(state: DataFrame, specs: Sequence[Spec], rules: Rules) -> Spans:
    """From scores that are up to date: two passes over the chunks."""
    columns = "name string, piece int, model int, positives double, score binary, label binary, key binary, place binary"

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in unpacked(batch):
                lists = Lists(chunk["labels"], chunk["lists"], chunk["keys"], rules.k)
                places = np.flatnonzero(chunk["pieces"] > 1)
                for m in range(len(specs)) if len(places) else ():
                    heads = lists.heads(chunk["scores"][m])
                    for i in places:
                        row = heads.row[i][heads.there[i]]
                        of = chunk["scores"][m][row], chunk["labels"][row], chunk["keys"][row], row - lists.first[i]
                        one = chunk["names"][i], int(chunk["piece"][i]), m, float(lists.positives[i]), *(x.tobytes() for x in of)
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in one], [c.split()[0] for c in columns.split(", ")]).cast(TOPS)

    found: dict[tuple[str, int], list[tuple]] = {}
    for name, piece, m, *rest in rows_of(state.mapInArrow(tops, columns).toArrow()):
        found.setdefault((name, m), []).append((piece, *rest))
    spans = Spans()
    for (name, m), parts in found.items():
        parts.sort(key=lambda p: p[0])
        spans.positives[name] = sum(p[1] for p in parts)
        score, label = (np.concatenate([np.frombuffer(p[i]) for p in parts]) for i in (2, 3))
        key, place = (np.concatenate([np.frombuffer(p[i], np.int64) for p in parts]) for i in (4, 5))
        piece = np.repeat([p[0] for p in parts], [len(p[4]) // 8 for p in parts])
        top = np.lexsort((key, -score))[: rules.k]
        spans.first[name, m] = score[top], label[top], piece[top], place[top]
    known = state.sparkSession.sparkContext.broadcast(spans)

    def pulls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in unpacked(batch):
                lists = Lists(chunk["labels"], chunk["lists"], chunk["keys"], rules.k)
                places = np.flatnonzero(chunk["pieces"] > 1)
                for m in range(len(specs)) if len(places) else ():
                    scores = chunk["scores"][m]
                    _, _, back = lists.gradients(scores, known.value.heads(chunk, lists, scores, m))
                    for i in places:
                        one = chunk["names"][i], int(chunk["piece"][i]), m, np.ascontiguousarray(back[:, i]).tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(one, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["name", "piece", "model", "back"])

    for name, _, m, back in sorted(rows_of(state.mapInArrow(pulls, "name string, piece int, model int, back binary").toArrow()), key=lambda r: r[:3]):
        n = len(spans.first[name, m][0])
        spans.back[name, m] = spans.back.get((name, m), 0.0) + np.frombuffer(back).reshape(2, -1)[:, :n]
    known.destroy()
    return spans


TOPS = pa.schema([("name", pa.string()), ("piece", pa.int32()), ("model", pa.int32()), ("positives", pa.float64()), *((c, pa.binary()) for c in ("score", "label", "key", "place"))])


SPLITS = {"model": np.int32, "node": np.int32, "feature": np.int32, "upto": np.int32, "left_g": np.float64, "left_h": np.float64, "all_g": np.float64, "all_h": np.float64}
SPLIT_SCHEMA = ", ".join(f"{n} {'int' if kind is np.int32 else 'double'}" for n, kind in SPLITS.items())


def best_splits(models: np.ndarray, nodes: np.ndarray, sums: np.ndarray, features: np.ndarray, least: float) -> pa.RecordBatch:
    """A row for each of ``models`` and ``nodes`` from sums (2, nodes, features, bins); the first of equally good splits, none without gain."""
    g, h = np.cumsum(sums[0], axis=2), np.cumsum(sums[1], axis=2)
    all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
    fit = lambda a, b: a * a / (b + PENALTY)
    gain = fit(g, h) + fit(all_g - g, all_h - h) - fit(all_g, all_h)
    gain = np.where((h >= least) & (all_h - h >= least), gain, -1.0).reshape(len(g), -1)
    at, row = gain.argmax(1), np.arange(len(g))
    f, b = np.divmod(at, sums.shape[3])
    good = gain[row, at] > 1e-9
    found = {
        "model": models, "node": nodes, "feature": np.where(good, features[row, f], -1), "upto": np.where(good, b, ALL_LEFT),
        "left_g": g[row, f, b], "left_h": h[row, f, b], "all_g": all_g[:, 0, 0], "all_h": all_h[:, 0, 0],
    }
    return pa.RecordBatch.from_arrays([pa.array(found[n].astype(kind)) for n, kind in SPLITS.items()], list(SPLITS))


def rows_of(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


class Level:
    """The nodes of one level of the trees that are this deep."""

    def __init__(self, trees: list[Tree], chosen: np.ndarray, level: int):
        self.level = level
        self.deep = np.array([m for m, t in enumerate(trees) if t.depth > level])
        inner = (1 << level) - 1
        self.feature, self.upto = (np.array([getattr(trees[m], x)[:inner] for m in self.deep]) for x in ("feature", "upto"))
        self.chosen = chosen[self.deep]
        self.models = np.repeat(self.deep, 1 << level)
        self.nodes = np.tile(np.arange(1 << level), len(self.deep))

    def sums(self, bins: np.ndarray, grads: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """(2, nodes of all models, chosen features, bins)."""
        total = level_sums(bins, grads[self.deep], hess[self.deep], self.feature, self.upto, self.chosen, self.level)
        return total.reshape(2, len(self.models), self.chosen.shape[1], BINS)

    def splits(self, sums: np.ndarray, least: float) -> pa.RecordBatch:
        return best_splits(self.models, self.nodes, sums, np.repeat(self.chosen, 1 << self.level, axis=0), least)


def splits_over_tasks(state: DataFrame, level: Level, least: float, chunks: int) -> list[tuple]:
    """The best split of every node of a level; one row per model and node. While the sums of all tasks, at most one of each chunk, are
    small, the driver adds them up, which saves a shuffle per level."""
    chosen = dict(zip(level.deep.tolist(), level.chosen, strict=True))

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for chunk in unpacked(batch):
                sums = level.sums(chunk["bins"], chunk["grads"], chunk["hess"])
                total = sums if total is None else total + sums
        if total is not None:
            each = np.ascontiguousarray(total.transpose(1, 0, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(level.models, pa.int32()), pa.array(level.nodes, pa.int32()), pa.array([x.tobytes() for x in each], pa.binary())], ["model", "node", "sums"])

    sums = state.mapInArrow(part, "model int, node int, sums binary")
    shape = (2, len(level.models), level.chosen.shape[1], BINS)
    if chunks * math.prod(shape) * 8 <= DRIVER_SUMS:
        place = {x: i for i, x in enumerate(zip(level.models.tolist(), level.nodes.tolist(), strict=True))}
        total = np.zeros(shape)
        for m, node, one in rows_of(sums.toArrow()):
            total[:, place[m, node]] += np.frombuffer(one).reshape(2, *shape[2:])
        return rows_of(level.splits(total, least))

    def added(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, node = (int(k.as_py()) for k in key)
        total = np.zeros((2, level.chosen.shape[1], BINS))
        for batch in parts:
            for one in batch.column("sums").to_pylist():
                total += np.frombuffer(one).reshape(total.shape)
        yield best_splits(np.array([m]), np.array([node]), total[:, None], chosen[m][None], least)

    found = sums.groupBy("model", "node").applyInArrow(added, SPLIT_SCHEMA)
    return rows_of(found.toArrow())


def grow(specs: Sequence[Spec], n_features: int, step: int, rules: Rules, splits: Callable[[Level], list[tuple]]) -> list[Tree]:
    """One tree for each of ``specs``; ``splits`` gives the best splits of a level."""
    trees = [Tree.empty(s.depth) for s in specs]
    count = max(1, round(rules.colsample * n_features))
    chosen = np.array([sorted(random.Random(f"{s.seed}:{step}").sample(range(n_features), count)) for s in specs])
    newton = lambda g, h: g / (h + PENALTY)
    for level in range(max(s.depth for s in specs)):
        for m, node, feature, upto, left_g, left_h, all_g, all_h in splits(Level(trees, chosen, level)):
            tree = trees[m]
            width = 1 << (tree.depth - level)  # leaves below this node
            leaf, at = node * width, (1 << level) - 1 + node
            split = feature >= 0
            tree.cover[at], tree.cover[2 * at + 1], tree.cover[2 * at + 2] = all_h, left_h if split else all_h, all_h - left_h if split else 0.0
            if split:
                tree.feature[at], tree.upto[at] = feature, upto
                tree.value[leaf : leaf + width // 2] = newton(left_g, left_h)
                tree.value[leaf + width // 2 : leaf + width] = newton(all_g - left_g, all_h - left_h)
            elif level == 0:
                tree.value[leaf : leaf + width] = newton(all_g, all_h)
    return trees


def grown_over_tasks(state: DataFrame, path: str, specs: Sequence[Spec], n_features: int, n_trees: int, rules: Rules, chunks: int, split: bool) -> list[list[Tree]]:
    """Chunks over the tasks: a pass per level, and per tree two more over chunks with lists in pieces."""
    spark = state.sparkSession
    trees: list[list[Tree]] = []
    held: DataFrame | None = None
    for step in range(n_trees):
        last, fresh, spans = trees[-1] if trees else None, None, None
        if split:
            fresh = rescored(state, specs, last).persist()
            spans = spark.sparkContext.broadcast(spans_of(fresh.where("split > 0"), specs, rules))
        new = stepped(state if fresh is None else fresh, specs, last if fresh is None else None, step, rules, spans)
        if step and step % KEEP == 0:
            old, path = path, write_table(new, "boost-state")
            drop_table(spark, old)
            state = spark.read.schema(STATE).parquet(path)
        else:
            state = new.persist()
        trees.append(grow(specs, n_features, step, rules, lambda level: splits_over_tasks(state, level, rules.least_child, chunks)))
        for df in (held, fresh):
            if df is not None:
                df.unpersist()
        held = state
    if held is not None:
        held.unpersist()
    drop_table(spark, path)
    return trees


# --- a model by itself ---------------------------------------------------------------------------------------
class Growing:
    """The sums of a level of one tree from the rows of a task; of two children the one with fewer rows is summed up."""

    def __init__(self, bins: np.ndarray, grads: np.ndarray, hess: np.ndarray, depth: int):
        self.bins = bins
        self.at = np.zeros(bins.shape[1], np.uint8 if depth <= 8 else np.uint32)
        self.some = np.flatnonzero((grads != 0) | (hess != 0))
        self.of = grads[self.some], hess[self.some]
        self.held: list[np.ndarray] = []  # bins of these rows, by chosen feature
        self.above: np.ndarray | None = None

    def added(self, rows: np.ndarray | None, at: np.ndarray, n_nodes: int) -> np.ndarray:
        """(2, nodes, features, bins) over ``rows`` of those with a gradient, or over all of them."""
        total = np.zeros((2, n_nodes, len(self.held), BINS))
        base, of = at.astype(np.int64) * BINS, self.of if rows is None else [x[rows] for x in self.of]
        for i, bins in enumerate(self.held):
            cell = base + (bins if rows is None else bins[rows])
            for s in (0, 1):
                total[s, :, i] = np.bincount(cell, of[s], n_nodes * BINS).reshape(n_nodes, BINS)
        return total

    def sums(self, level: Level) -> np.ndarray:
        n_nodes = 1 << level.level
        if not level.level:
            self.held = [self.bins[f].take(self.some) for f in level.chosen[0]]
            self.above = self.added(None, self.at[self.some], 1)
            return self.above
        self.at = move(self.at, level.feature[0], level.upto[0], self.bins, level.level - 1)
        at = self.at[self.some]
        left, right = np.bincount(at, minlength=n_nodes).reshape(-1, 2).T
        summed = np.stack([left < right, left >= right], axis=1).ravel()
        rows = np.flatnonzero(summed[at])
        total = self.added(rows, at[rows], n_nodes)
        other = np.flatnonzero(~summed)
        total[:, other] = self.above[:, other // 2] - total[:, other ^ 1]  # exact, as all are multiples of 1 / GRID
        self.above = total
        return total

    def leaves(self, tree: Tree) -> np.ndarray:
        return move(self.at, tree.feature, tree.upto, self.bins, tree.depth - 1) if tree.depth else self.at


def grown_alone(spec: Spec, rows: dict[str, np.ndarray], weight: np.ndarray | None, n_trees: int, rules: Rules) -> list[Tree]:
    """The trees of one model from all rows."""
    ranked = rules.loss == "ndcg"
    if spec.fold is not None:
        learnt = (rows["folds"] != spec.fold).astype(float)
        weight = learnt if weight is None else weight * learnt
    teach = np.ones(len(rows["keys"]), bool) if weight is None else weight != 0
    if ranked and len(teach):  # the rows of a list with one label, or without any weight, have no gradients; others are ranked with all of their list
        first = np.flatnonzero(np.concatenate([[True], np.diff(rows["lists"]) != 0]))
        some = np.logical_or.reduceat(teach, first) & (np.minimum.reduceat(rows["labels"], first) != np.maximum.reduceat(rows["labels"], first))
        teach = np.repeat(some, np.diff(np.append(first, len(teach))))
    if not teach.all():
        rows = {k: x[..., teach] for k, x in rows.items() if k != "weights"}
        weight = None if weight is None else weight[teach]
    bins, n_features = rows["bins"], len(rows["bins"])
    lists = Lists(rows["labels"], rows["lists"], rows["keys"], rules.k) if ranked else None
    scores = np.zeros(bins.shape[1])
    trees: list[Tree] = []
    for step in range(n_trees):
        g, h = lists.gradients(scores)[:2] if lists else logistic_gradients(scores, rows["labels"])
        drawn = rules.drawn(rows["keys"], spec.seed, step)
        drawn = drawn if weight is None else drawn * weight
        growing = Growing(bins, on_grid(g * drawn), on_grid(h * drawn), spec.depth)
        tree = grow([spec], n_features, step, rules, lambda level: rows_of(level.splits(growing.sums(level), rules.least_child)))[0]  # noqa: B023
        trees.append(tree)
        scores += spec.rate * tree.value[growing.leaves(tree)]
    return trees


def joined(chunks: Sequence[dict], ranked: bool) -> dict[str, np.ndarray]:
    """All chunks as one; with lists, their rows by list and key."""
    rows = {k: np.concatenate([c[k] for c in chunks], axis=-1) for k in ("keys", "labels", "folds", "bins", "weights")}
    if ranked:
        ids = {name: i for i, name in enumerate(sorted({name for c in chunks for name in c["names"]}))}
        rows["lists"] = np.concatenate([np.array([ids[name] for name in c["names"]], np.int32)[c["lists"]] for c in chunks])
        order = np.lexsort((*rows["bins"], rows["labels"], rows["keys"], rows["lists"]))
        rows = {k: x[..., order] for k, x in rows.items()}
    return rows


def grown_by_model(state: DataFrame, path: str, specs: Sequence[Spec], n_trees: int, rules: Rules) -> list[list[Tree]]:
    """Models over the tasks, each of which has all rows."""
    spark = state.sparkSession
    n = min(len(specs), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for share, chunk in zip(batch.column(0).to_pylist(), unpacked(batch.select(batch.schema.names[1:])), strict=True):
                held.setdefault(share, []).append(chunk)
        for share in list(held):
            rows = joined(held.pop(share), rules.loss == "ndcg")
            for i, m in enumerate(range(share, len(specs), n)):
                trees = grown_alone(specs[m], rows, rows["weights"][i] if len(rows["weights"]) else None, n_trees, rules)
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary())], ["model", "trees"])

    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("share")  # the chunks once for each share of the models
    size = F.col("n") * np.dtype(KINDS["weights"]).itemsize
    own = F.concat(*[F.substring("weights", 1 + (F.col("share") + i) * size, size) for i in range(0, len(specs), n)])
    dealt = state.select(every, "*").withColumn("weights", own).repartitionById(n, F.col("share"))
    found = {r.model: pickle.loads(r.trees) for r in dealt.mapInArrow(run, "model int, trees binary").collect()}
    drop_table(spark, path)
    return [[found[m][step] for m in range(len(specs))] for step in range(n_trees)]


def train(
    rows: DataFrame, features: Sequence[str], specs: Sequence[Spec], n_trees: int, loss: str = "ndcg", key: str = "parcel_id", label: str = "label",
    query: str | None = "block_id", fold: str | None = None, weights: Sequence[Column] = (), subsample: float = 0.8, colsample: float = 0.8,
    k: int = 20, least_child: float = 1e-3,
) -> Boosted:
    """All models of ``specs``, with a column of row weights each if ``weights`` are given; no rows give trees of zeros."""
    features, specs = list(features), list(specs)
    rules = Rules(loss, k, subsample, colsample, least_child)
    edges = bin_edges(rows, features)
    spark = rows.sparkSession
    path = write_table(packed(rows, features, edges, len(specs), weights, key, label, query if loss == "ndcg" else None, fold), "boost-state")
    state = spark.read.schema(STATE).parquet(path)
    n_chunks, n_rows, split = state.agg(F.count(F.lit(1)), F.sum("n"), F.sum("split")).first()
    if n_chunks == 0:
        return Boosted(specs, features, edges, [[Tree.empty(s.depth) for s in specs] for _ in range(n_trees)])
    if n_rows <= WHOLE:
        trees = grown_by_model(state, path, specs, n_trees, rules)
    else:
        trees = grown_over_tasks(state, path, specs, len(features), n_trees, rules, n_chunks, split > 0)
    return Boosted(specs, features, edges, trees)
