"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code
points are never dropped. ``LineRuns`` holds, for every key added so far, its 128-bit hash, the documents that hold it and
its keeper. Each batch is counted per hash and merged with all runs: hashes that no run has (the anti-join) get their keeper,
the largest id of this batch; the others add to the count only. The result is the batch's own run, on level 0. When a level
has ``fanout`` runs they are merged into one on the next level, so after n batches there are at most fanout * log(n) runs and
a hash was rewritten log(n) times. A run is a table bucketed and sorted by its hash, so that merging with it moves only the batch.

``without_repeats`` adds a table in batches of falling ids, so that the keeper of a key is the largest id that holds it. Keys
of at least ``min_docs`` documents lose their lines in all other documents. Keys held by more than a ``HOT``-th of all (document,
key) pairs are at most ``HOT``, so they go to the tasks as a dictionary; the others are joined by hash, and each of them has at most
that share of the rows. Sieves of fixed size keep documents without such lines out of the joins.

Every row is a document of its own, also one with an id that has come before; the rows of the largest id keep their lines. A
null id ranks below all others. Null and empty texts are one empty line. Repeated rows are treated alike, no rows give no rows.
Other columns stay; those named as in ``ADDED`` are replaced. Ids are whole numbers.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import Sieve, col, free_names
from lotwise.session import materialise, scratch_path

WHITE = b" \t\n\x0b\x0c\r"
ADDED = ("n_lines", "n_dropped", "kept")
HASH = ["a", "b"]
HOT = 10_000


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is shorter than ``min_chars``."""
    key = line.strip(WHITE)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key.lower()


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 16-byte hash for each line of ``text``; None for lines that are too short."""
    keys = (key_of(line, min_chars) for line in text.split(b"\n"))
    return [None if k is None else xxhash.xxh3_128_digest(k) for k in keys]


def bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def line_hashes(docs: DataFrame, batch: Column, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(``batch``, hash, ``docs``, ``last``): how many documents of one Arrow batch hold a key, and the largest id of them."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found: dict[tuple, list] = {}
            for at, id_, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), bytes_of(rows.column(2)), strict=True):
                for h in set(keys_of(text, min_chars)) - {None}:
                    entry = found.setdefault((at, h), [0, None])
                    entry[0] += 1
                    entry[1] = id_ if entry[1] is None else max(entry[1], id_ if id_ is not None else entry[1])
            yield pa.RecordBatch.from_arrays([
                pa.array([at for at, _ in found], pa.int32()), *halves([h for _, h in found]),
                pa.array([n for n, _ in found.values()], pa.int64()), pa.array([i for _, i in found.values()], pa.int64()),
            ], ["batch", "a", "b", "docs", "last"])

    rows = docs.select(batch.alias("batch"), col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(count, "batch int, a long, b long, docs long, last long")


class LineRuns:
    """Levelled runs of (hash, ``docs``, ``keeper``); each is bucketed and sorted by hash, and holds a hash once."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> str:
        """Merge the rows (hash, ``docs``, ``last``) of a batch with the runs; returns the name of the batch's own run."""
        own = lines.groupBy(HASH).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
        marks = []
        for i, run in enumerate(self.runs()):
            marks.append(F.col(f"in_{i}").isNotNull())
            own = own.join(self.spark.table(run).select(*HASH, F.lit(True).alias(f"in_{i}")), HASH, "left")
        known = reduce(lambda x, y: x | y, marks, F.lit(False))
        run = self._write(own.select(*HASH, "docs", F.when(~known, F.col("last")).alias("keeper")))
        self._put(run, 0)
        return run

    def merged(self, runs: list[str] | None = None) -> DataFrame:
        """Some or all runs as one. They are read as plain files: Spark 4.1 takes a union of bucketed tables for
        partitioned by hash, reads them otherwise, and leaves the rows of one hash apart."""
        runs = self.runs() if runs is None else runs
        schema = "a long, b long, docs long, keeper long"
        files = [self.paths[r] for r in runs]
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return rows.groupBy(HASH).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def drop(self) -> None:
        for run in self.runs():
            self.spark.sql(f"drop table if exists {run}")
        self.levels = []

    def _put(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        here = self.levels[level]
        here.append(run)
        if len(here) >= self.fanout:
            merged = self._write(self.merged(here))
            for old in here:
                self.spark.sql(f"drop table {old}")
            here.clear()
            self._put(merged, level + 1)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name


def falling(docs: DataFrame, id_col: str, batches: int) -> Column:
    """Number of the batch of a row: equal ids are together, larger ids come first, null ids last."""
    id_ = col(id_col).cast("long")
    cuts = [i / batches for i in range(1, batches)]
    bounds = (docs.agg(F.percentile_approx(id_, cuts, 1000)).first()[0] or []) if cuts else []
    return F.coalesce(reduce(lambda n, b: n + (id_ < b).cast("int"), sorted(set(bounds)), F.lit(0)), F.lit(batches))


def counted_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> tuple[DataFrame, int]:
    """All keys (hash, ``docs``, ``keeper``) after adding ``docs`` batch by batch, and the number of (document, key) pairs."""
    spark = docs.sparkSession
    path = scratch_path(spark, "line-hashes")
    hashed = line_hashes(docs, falling(docs, id_col, batches), id_col, text_col, min_chars)
    hashed.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(hashed.schema).parquet(path)
    sizes = {r.batch: r.n for r in lines.groupBy("batch").agg(F.sum("docs").alias("n")).collect()}  # one row per batch
    index = LineRuns(spark)
    for i in sorted(sizes):
        index.add(lines.where(F.col("batch") == i).drop("batch"))
    keys = materialise(index.merged(), "line-keys")
    index.drop()
    return keys, sum(sizes.values())


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 8, sieve_bits: int = 26,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the other lines joined by a line feed."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    keys, pairs = counted_lines(docs, id_col, text_col, min_chars, batches)
    frequent = keys.where(F.col("docs") >= min_docs)
    is_hot = F.col("docs") > pairs / HOT
    packed = lambda r: np.array([r.a, r.b], np.int64).tobytes()
    hot = sc.broadcast({packed(r): r.keeper for r in frequent.where(is_hot).collect()})  # fewer than HOT keys can have more than a HOT-th each
    rare = frequent.where(~is_hot)
    sieve = sc.broadcast(Sieve.of(rare.select(F.col("a").alias("hash")), sieve_bits))

    def candidates(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found:
            each = [list(set(keys_of(t, min_chars)) - {None} - hot.value.keys()) for t in bytes_of(rows.column(2))]
            doc = np.repeat(np.arange(len(each)), [len(e) for e in each])
            a, b = halves([h for e in each for h in e])
            ok = np.flatnonzero(sieve.value.passes(a.to_numpy().view(np.uint64)))
            at = pa.array(doc[ok])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), a.take(pa.array(ok)), b.take(pa.array(ok))], ["id", "v", "a", "b"])

    id_, v, gone_, got_, id2_, v2_ = free_names(docs, "id_", "v_", "gone_", "got_", "id2_", "v2_")
    version = F.xxhash64(F.coalesce(col(text_col), F.lit("")))
    short = docs.select(col(id_col).cast("long").alias("id"), version.alias("v"), col(text_col).alias("text"))
    held = short.mapInArrow(candidates, "id long, v long, a long, b long").distinct()
    lost = held.join(rare, HASH).where(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = materialise(lost.groupBy("id", "v").agg(F.collect_list(F.struct("a", "b")).alias("gone")), "gone")
    own = lambda i, w: F.xxhash64(F.coalesce(i, F.lit(-1)), w)
    touched = sc.broadcast(Sieve.of(gone.select(own(F.col("id"), F.col("v")).alias("hash")), sieve_bits))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(touched.value.passes(h.to_numpy().view(np.uint64)))

    def cut_rows(ids: pa.Array, texts: pa.Array, lost_here: Iterable[list | None], where: np.ndarray | None = None) -> pa.Array:
        """Null but at ``where``, if that is given."""
        n, dropped, kept = [], [], []
        for i, text, lost, here in zip(ids.to_pylist(), bytes_of(texts), lost_here, itertools.repeat(True) if where is None else where):  # noqa: B905
            if not here:
                n.append(None), dropped.append(None), kept.append(None)
                continue
            out = {np.array([x["a"], x["b"]], np.int64).tobytes() for x in lost or ()}
            lines = text.split(b"\n")
            stay = [x for x, h in zip(lines, keys_of(text, min_chars), strict=True) if h is None or h not in out and hot.value.get(h, i) == i]
            n.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        arrays = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(arrays, names=["n_lines", "n_dropped", "kept"])

    @F.arrow_udf("n_lines long, n_dropped long, kept string")
    def cut(ids: pa.Array, texts: pa.Array, lost_here: pa.Array) -> pa.Array:
        return cut_rows(ids, texts, lost_here.to_pylist())

    @F.arrow_udf("n_lines long, n_dropped long, kept string")
    def cut_clean(ids: pa.Array, texts: pa.Array, hashes: pa.Array) -> pa.Array:
        return cut_rows(ids, texts, itertools.repeat(None), ~touched.value.passes(hashes.to_numpy().view(np.uint64)))

    rows = docs.withColumns({id_: col(id_col).cast("long"), v: version})
    # One Python worker per task tests a row and cuts it, as each holds much memory; a nondeterministic function is not worked out twice.
    hashed = own(F.col(id_), F.col(v))
    clean = rows.withColumn(got_, cut_clean.asNondeterministic()(F.col(id_), col(text_col), hashed)).where(F.col(f"{got_}.n_lines").isNotNull())
    named = gone.select(F.col("id").alias(id2_), F.col("v").alias(v2_), F.col("gone").alias(gone_))
    other = rows.where(maybe(hashed)).join(named, F.col(id_).eqNullSafe(F.col(id2_)) & (F.col(v) == F.col(v2_)), "left")
    other = other.withColumn(got_, cut(F.col(id_), col(text_col), F.col(gone_)))
    done = clean.unionByName(other.drop(id2_, v2_, gone_))
    stay = [col(c) for c in docs.columns if c.lower() not in ADDED]
    return done.select(*stay, *[F.col(f"{got_}.{c}").alias(c) for c in ADDED])
