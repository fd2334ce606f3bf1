"""Substring dedup: a de Bruijn graph of token k-mers, its repeated paths compacted, spans taken from source coordinates.

A window of ``k`` words is an edge from its first k - 1 words to its last k - 1. ``repeated_spans`` finds the edges that occur
at more than one place and returns, per document, the runs of words covered by windows that also start earlier
(smaller id; in one document, earlier word), each with its source.

1. Anchors: the least hash of ``ANCHOR`` words in each window. Equal windows have equal anchors, so a window whose anchor
   occurs once is not repeated. Anchors are counted; those seen twice go into a sieve of fixed size (``Sieve``).
2. Windows that the sieve lets through are edges. A batch of texts keeps the first place of each edge and settles its later
   places itself, so an edge that is everywhere comes once per batch. Neighbouring edges with one anchor are sent as one row
   to the task of the anchor; edges of the at most ``HOT`` anchors that have more than a ``HOT``-th of all places go one by one.
3. There the places of an edge meet. Those after the first are repeats; neighbours whose first places are neighbours, too, are one
   row. The first places of edges with two places or more, with their nodes, are the graph. A node with two edges in or out is a fork.
4. Neighbouring repeats whose sources are neighbours are one run, cut where the source comes to a fork: a run of edges with no
   fork inside is one path, and each piece one span. Edges are 64-bit hashes, nodes 32 bits (a chance fork splits a path, no more).

Null and empty texts have no words. A null id sorts first. Rows with equal ids are documents of their own, unless their texts
are equal, too: these are one document, and each gets its result. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import Sieve, WordHashes, col, lowest, mix, pieces, rolled
from lotwise.session import drop_table, materialise, write_table

ANCHOR = 8
HOT = 10_000
PIECE = 4_000_000  # bytes of text that are looked at together
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, its order ``key`` (null first), a short hash of the text that tells rows of one id apart, and the text."""
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(
        col(id_col).alias("id"), F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
        F.pmod(F.xxhash64(text), F.lit(32749)).cast("int").alias("v"), text.alias("text"),
    )


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Of all runs of ``n`` words of texts put one after another, those that lie in one text."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return left[: max(0, total - n + 1)] >= n


def anchors_of(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hashes of which it is the least."""
    n = min(ANCHOR, k)
    each = mix(rolled(x, n))
    return lowest(each, k - n + 1), each


def repeated_anchors(rows: DataFrame, k: int) -> DataFrame:
    """Anchors of windows at two places or more, and how many: columns ``hash`` and ``n``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, 0, PIECE):
                x, counts = hashes.batch(part.column(0).to_pylist(), lower=False)
                least, each = anchors_of(x, k)
                at = np.flatnonzero(inside(counts, k))
                new = np.ones(len(at), bool)  # neighbouring windows mostly share their anchor, until it is the first in one
                new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (each[at[:-1]] == least[at[:-1]])
                found, n = np.unique(least[at[new]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["hash", "n"])

    return rows.select("text").mapInArrow(count, "hash long, n int").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")


def chained(row: np.ndarray, *steps: np.ndarray) -> np.ndarray:
    """Where a new run begins: another ``row``, or one of ``steps`` does not go up by one."""
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    for s in steps:
        new[1:] |= s[1:] != s[:-1] + 1
    return new


def lists(begins: np.ndarray, total: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, total).astype(np.int32)), pa.array(values, kind))


PACKED = "spot long, key long, at long, n int, source long, source_at long, edges array<long>, nodes array<int>"
SETTLED = "key long, at long, n int, source long, source_at long, own boolean, nodes array<int>"


def edges(rows: DataFrame, sieve: Sieve, hot: np.ndarray, k: int) -> DataFrame:
    """First places of edges per batch, neighbours with one anchor as one row, with their ``nodes`` (one more than ``edges``); and runs
    of ``n`` places that repeat an earlier one of their batch (``edges`` null). ``spot`` is the same for equal edges."""
    shared = rows.sparkSession.sparkContext.broadcast((sieve, hot))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known, frequent = shared.value
        for batch in batches:
            for part in pieces(batch, 2, PIECE):
                key, v = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                order = np.lexsort((v, key))
                texts = part.column(2).to_pylist()
                x, counts = hashes.batch([texts[i] for i in order], lower=False)
                del texts
                key, v = key[order], v[order]
                least, each = anchors_of(x, k)
                where = np.flatnonzero(inside(counts, k))
                where = where[known.passes(least[where])]
                doc = np.repeat(np.arange(len(counts)), counts)[where]
                pos = where - (np.cumsum(counts) - counts)[doc]
                edge, node = mix(rolled(x, k)[where]), (mix(rolled(x, k - 1)) >> np.uint64(32)).astype(np.uint32)
                # places in order of document and word; a stable sort by edge keeps that order
                by = np.argsort(edge, kind="stable")
                start = np.ones(len(by), bool)
                start[1:] = edge[by][1:] != edge[by][:-1]
                head = by[np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))] if len(by) else by
                first = np.empty(len(by), np.int64)
                first[by] = head  # for each place the place where its edge first was
                own = first == np.arange(len(by))
                same = (key[doc] == key[doc[first]]) & (v[doc] == v[doc[first]]) & (pos == pos[first])
                at_word = (v[doc].astype(np.int64) << 32) + pos

                rep = np.flatnonzero(~own & ~same)
                f = first[rep]
                begins = np.flatnonzero(chained(doc[rep], pos[rep], pos[f]) | np.append(np.ones(min(1, len(f)), bool), doc[f][1:] != doc[f][:-1]))
                r, s, sizes = rep[begins], f[begins], np.diff(np.append(begins, len(rep)))
                spread = mix(key[doc[r]].view(np.uint64) ^ at_word[r].view(np.uint64))

                one = np.flatnonzero(own)
                at = where[one]
                spot, lone = least[at].copy(), np.isin(least[at], frequent)
                turn = np.zeros(len(one), np.int64)
                for j in range(k - min(ANCHOR, k), -1, -1):  # the leftmost of equal ones stays
                    turn[each[at + j] == spot] = j
                spot[lone] = edge[one][lone]
                new = chained(doc[one], pos[one]) | lone
                new[1:] |= lone[:-1] | (turn[1:] != turn[:-1] - 1)
                groups = np.flatnonzero(new)
                many = np.diff(np.append(groups, len(one)))
                p, n, m = one[groups], len(groups), len(begins)
                ends = groups + np.arange(n)  # each list of nodes is longer by one
                which = np.arange(len(one) + n) + np.repeat(at[groups] - ends, many + 1)

                longs = lambda a: pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))
                both = lambda a, b: pa.concat_arrays([a, b])
                none = lambda size, kind=pa.int64(): pa.nulls(size, kind)  # noqa: B008, E731
                all_ = np.append(p, r)
                yield pa.RecordBatch.from_arrays([
                    longs(np.append(spot[groups], spread)), longs(key[doc[all_]]), longs(at_word[all_]), pa.array(np.append(many, sizes).astype(np.int32)),
                    both(none(n), longs(key[doc[s]])), both(none(n), longs(at_word[s])),
                    both(lists(groups, len(one), edge[one].view(np.int64), pa.int64()), none(m, pa.list_(pa.int64()))),
                    both(lists(ends, len(which), node[which].view(np.int32), pa.int32()), none(m, pa.list_(pa.int32()))),
                ], ["spot", "key", "at", "n", "source", "source_at", "edges", "nodes"])

    return rows.select("key", "v", "text").mapInArrow(find, PACKED)


def settled(packed: DataFrame) -> DataFrame:
    """Runs of ``n`` places that come after the first place of their edge, with that place (``own``: it is the first in the batch only),
    and, without a ``source``, runs of first places of repeated edges, with ``nodes``."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_own = table.column("source").is_valid()
        done = table.filter(is_own)
        for b in done.select(["key", "at", "n", "source", "source_at"]).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ones(len(b), bool)), pa.nulls(len(b), pa.list_(pa.int32()))], NAMES)
        rows = table.filter(pc.invert(is_own)).combine_chunks()
        if not rows.num_rows:
            return
        size = rows.column("n").to_numpy()
        edge = rows.column("edges").combine_chunks().flatten().to_numpy()
        node = rows.column("nodes").combine_chunks().flatten()
        row = np.repeat(np.arange(len(size)), size)
        key = rows.column("key").to_numpy()[row]
        at = rows.column("at").to_numpy()[row] + np.arange(len(row)) - (np.cumsum(size) - size)[row]
        by = np.argsort(edge, kind="stable")  # rows of a spot come by document and word
        start = np.ones(len(by), bool)
        start[1:] = edge[by][1:] != edge[by][:-1]
        begin = np.flatnonzero(start)
        count = np.diff(np.append(begin, len(by)))
        first = np.empty(len(by), np.int64)
        first[by] = np.repeat(by[begin], count)
        twice = np.zeros(len(by), bool)  # rows of one document that came more than once
        twice[by[1:]] = ~start[1:] & (key[by][1:] == key[by][:-1]) & (at[by][1:] == at[by][:-1])
        is_first = np.zeros(len(by), bool)
        is_first[by[begin[count > 1]]] = True

        later = np.flatnonzero((first != np.arange(len(by))) & ~twice)
        f = first[later]
        new = chained(row[later], at[later], at[f])
        new[1:] |= key[f][1:] != key[f][:-1]
        where = np.flatnonzero(new)
        sizes = np.diff(np.append(where, len(later)))
        r, s = later[where], f[where]
        yield pa.RecordBatch.from_arrays([
            pa.array(key[r]), pa.array(at[r]), pa.array(sizes.astype(np.int32)), pa.array(key[s]), pa.array(at[s]), pa.array(np.zeros(len(r), bool)), pa.nulls(len(r), pa.list_(pa.int32())),
        ], NAMES)

        heads = np.flatnonzero(is_first)
        where = np.flatnonzero(chained(row[heads], at[heads]))
        sizes = np.diff(np.append(where, len(heads)))
        r, ends = heads[where], where + np.arange(len(where))
        which = np.arange(len(heads) + len(where)) + np.repeat(r + row[r] - ends, sizes + 1)  # one node more for each row before
        nothing = pa.nulls(len(r), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(key[r]), pa.array(at[r]), pa.array(sizes.astype(np.int32)), nothing, nothing, pa.array(np.zeros(len(r), bool)),
            lists(ends, len(which), node.to_numpy()[which], pa.int32()),
        ], NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            spot = batch.column(0).to_numpy()
            held.append(batch)
            if len(spot) and spot[0] != spot[-1]:  # the last spot may go on in the next batch
                cut = int(np.searchsorted(spot, spot[-1]))
                yield from settle(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from settle(pa.Table.from_batches(held))

    return packed.repartition("spot").sortWithinPartitions("spot", "key", "at").mapInArrow(run, SETTLED)


NAMES = ["key", "at", "n", "source", "source_at", "own", "nodes"]
V, POS = "int(shiftright({}, 32))", "int({} & 4294967295L)"
BLOCK = 10  # runs and forks meet by document and 1024 words


def forks(firsts: DataFrame, sieve_bits: int) -> DataFrame:
    """Places (``source``, ``cut``) of the graph's edges that leave a fork."""
    ends = "inline(concat(transform(slice(nodes, 1, n), x -> struct(x as node, true as out)), transform(slice(nodes, 2, n), x -> struct(x as node, false as out))))"
    forked = materialise(firsts.selectExpr(ends).groupBy("node", "out").count().where("count > 1").select("node").distinct(), "forks")
    hashed = lambda x: mix(x.astype(np.uint32).astype(np.uint64))

    @F.pandas_udf("long")
    def hash_of(node: pd.Series) -> pd.Series:
        return pd.Series(hashed(node.to_numpy()).view(np.int64))

    shared = firsts.sparkSession.sparkContext.broadcast(Sieve.of(forked.select(hash_of("node").alias("hash")), sieve_bits))

    def maybe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            node = batch.column(3).flatten().to_numpy()[np.arange(len(row)) + row]  # all but the last of each row
            ok = np.flatnonzero(shared.value.passes(hashed(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), batch.column(0).take(pa.array(row[ok])), pa.array(batch.column(1).to_numpy()[row[ok]] + step[ok])], ["node", "source", "cut"])

    return firsts.select("key", "at", "n", "nodes").mapInArrow(maybe, "node int, source long, cut long").join(forked, "node", "left_semi").select("source", "cut")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, sieve_bits: int = 26) -> DataFrame:
    """``key`` and ``v`` of a document, a run of its words [start, stop) that has come before, and where (``source``, ``source_pos``).

    Runs of one document may overlap or touch, where their sources or paths differ.
    """
    if k < 2:
        raise ValueError("k must be 2 or more")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    path = write_table(repeated_anchors(rows, k), "anchors")
    anchors = spark.read.schema("hash long, n long").parquet(path)
    total = anchors.agg(F.sum("n")).first()[0] or 0
    hot = np.array([r.hash for r in anchors.where(F.col("n") > total / HOT).collect()], np.int64).view(np.uint64)  # fewer than HOT
    sieve = Sieve.of(anchors.select("hash"), sieve_bits)
    drop_table(spark, path)
    found = materialise(settled(edges(rows, sieve, hot, k)), "places")

    order = Window.partitionBy("key", F.expr(V.format("at"))).orderBy("at")
    follows = lambda c, step: F.coalesce(F.lag(c).over(order) + (F.lag("n").over(order) if step else 0) == F.col(c), F.lit(False))
    joins_on = follows("at", True) & follows("source_at", True) & follows("source", False)
    later = found.where("source is not null and not own")
    numbered = later.withColumn("run", F.when(joins_on, F.lit(0)).otherwise(1)).withColumn("run", F.sum("run").over(order))
    runs = numbered.groupBy("key", F.expr(V.format("at")).alias("v"), "run").agg(
        F.min("at").alias("at"), F.sum("n").alias("n"), F.min("source").alias("source"), F.min("source_at").alias("source_at")
    ).drop("run", "v")
    cuts = forks(found.where("source is null"), sieve_bits).withColumn("block", F.shiftright("cut", BLOCK))
    blocks = runs.withColumn("block", F.explode(F.sequence(F.shiftright("source_at", BLOCK), F.shiftright(F.col("source_at") + F.col("n") - 1, BLOCK))))
    is_inside = (F.col("cut") > F.col("source_at")) & (F.col("cut") < F.col("source_at") + F.col("n"))
    cut_runs = blocks.join(cuts, ["source", "block"], "left").groupBy("key", "at", "n", "source", "source_at").agg(F.collect_set(F.when(is_inside, F.col("cut") - F.col("source_at"))).alias("steps"))
    begins = cut_runs.withColumn("steps", F.array_sort(F.concat(F.array(F.lit(0).cast("long")), "steps")))
    each = begins.selectExpr("key", "at", "source", "source_at", "inline(transform(steps, (b, i) -> struct(b as b, coalesce(get(steps, i + 1), n) as e)))")
    word = lambda at, step: f"{POS.format(at)} + int({step})"
    spans = each.selectExpr("key", f"{V.format('at')} v", f"{word('at', 'b')} start", f"{word('at', 'e')} - 1 + {k} stop", "source", f"{word('source_at', 'b')} source_pos")
    in_batch = found.where("own").selectExpr("key", f"{V.format('at')} v", f"{POS.format('at')} start", f"{word('at', 'n')} - 1 + {k} stop", "source", f"{POS.format('source_at')} source_pos")
    return spans.unionByName(in_batch)


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", sieve_bits: int = 26) -> DataFrame:
    """Per row: the id, ``n_words``, ``n_removed`` and ``kept``, its other words joined by one space.

    Only rows that a sieve of the documents with spans lets through are joined with the spans.
    """
    cuts = materialise(spans.groupBy("key", "v").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")), "cuts")
    hashed = lambda key, v: F.xxhash64(key, v)
    shared = docs.sparkSession.sparkContext.broadcast(Sieve.of(cuts.select(hashed("key", "v").alias("hash")), sieve_bits))
    kind = docs.schema[id_col].dataType.simpleString()

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(h.to_numpy().view(np.uint64)))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                n, removed, kept = [], [], []
                for text, spans_here in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.encode().split()
                    n.append(len(words))
                    at, left, gone = 0, [], 0
                    for s in sorted((s["start"], s["stop"]) for s in spans_here or ()):
                        left += words[at : max(at, s[0])]
                        gone += max(0, s[1] - max(at, s[0]))
                        at = max(at, s[1])
                    removed.append(gone)
                    kept.append(b" ".join(left + words[at:]).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    def cut_clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that the sieve stops: one Python worker per task for the test and the cut, as each holds much memory."""
        for batch in batches:
            stopped = batch.filter(pa.array(~shared.value.passes(batch.column(2).to_numpy().view(np.uint64))))
            yield from cut([pa.RecordBatch.from_arrays([*stopped.columns[:2], pa.nulls(len(stopped))], ["id", "text", "cuts"])])

    rows = keyed(docs, id_col, text_col).withColumn("hash", hashed("key", "v"))
    out = f"id {kind}, n_words long, n_removed long, kept string"
    clean = rows.select("id", "text", "hash").mapInArrow(cut_clean, out)
    other = rows.where(maybe("hash")).join(cuts, ["key", "v"], "left").select("id", "text", "cuts").mapInArrow(cut, out)
    return clean.unionByName(other).withColumnRenamed("id", id_col)
