"""MinHash near-dedup by the chosen-path similarity join.

A document's set is its distinct ``size``-word shingles (lower-case A-Z); a shorter text's whole word sequence is its one
shingle. ``near_duplicates`` links documents with Jaccard similarity of at least ``percent`` / 100 and gives each row its
component.

1. Equal sets are one class (a 128-bit digest), so copies are settled by a grouping and are never paired.
2. Trees: in each of ``TREES`` independent trees a class goes to the node of its minwise tokens under two chosen hash
   functions. Nodes of up to ``SMALL`` classes are compared exhaustively, by signatures of ``SIGNATURE`` bytes. A larger node has
   its members compared with one pivot, and branches by the next minwise token, to depth ``DEPTH``. A pair at similarity 0.8
   stays together through d choices with probability 0.8^d, so 16 trees miss it with probability 1e-7 (d = 2) to 2e-4 (d = 4).
3. Pairs whose signatures agree in ``LEAST_AGREE`` places (five deviations below the mean at 0.8) are confirmed on full sets:
   first the best partners of each class, then all other pairs that are not yet in one component.
4. Nodes that are still large at the end hold copies with small edits. Members outside the largest component of such a group
   are compared with all its members, in blocks, so no link is lost and copies are not expanded into pairs.

Null and empty texts, and texts without words, have an empty set, are linked with nothing and are their own component.
Rows with equal ids are documents of their own; the component is the least id reachable (null only if no id is known).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lotwise.llm.common import GOLDEN, Sieve, WordHashes, col, free_names, mix, pieces, rolled, starts_of
from lotwise.session import materialise

TREES = 16
LEVELS = 4          # minwise tokens of a tree's own
DEPTH = 4
SMALL = 32
SIGNATURE = 128
LEAST_AGREE = 80
BLOCK = 256
FACTORS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingle_sets(texts: list[str | None], hashes: WordHashes, size: int) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    x, counts = hashes.batch(texts, lower=True)
    many = mix(rolled(x, size))
    out = []
    for s, n in zip(starts_of(counts).tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(many[s : s + n - size + 1]))
        else:
            out.append(mix(rolled(x[s : s + n], n) + np.uint64(n)) if n else x[:0])
    return out


def digest(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row the id, a hash ``v`` of the text, ``n_shingles``, ``cls`` (digest of the set, null if empty), minwise ``tokens`` and ``sig``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, 2):
                sets = shingle_sets(part.column(2).to_pylist(), hashes, size)
                n = np.array(list(map(len, sets)), np.int64)
                some = n > 0
                least = np.zeros((len(sets), SIGNATURE), np.uint32)
                if some.any():
                    every, at = np.concatenate(sets), starts_of(n)[some]
                    for k, factor in enumerate(FACTORS):
                        least[some, k] = np.minimum.reduceat(every * factor, at) >> np.uint64(32)
                tokens = pa.FixedSizeListArray.from_arrays(pa.array(least[:, : TREES * LEVELS].ravel().view(np.int32)), TREES * LEVELS).cast(pa.list_(pa.int32()))
                sig = [row.tobytes() for row in (least & np.uint32(255)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(list(map(digest, sets)), pa.binary()), tokens, pa.array(sig, pa.binary())],
                    ["id", "v", "n_shingles", "cls", "tokens", "sig"],
                )

    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("v"), col(text_col).alias("text"))
    return rows.mapInArrow(sketch, f"id {kind}, v long, n_shingles long, cls binary, tokens array<int>, sig binary")


@F.pandas_udf(IntegerType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many places two signatures agree."""
    one, two = (np.frombuffer(b"".join(map(bytes, s)), np.uint8).reshape(-1, SIGNATURE) for s in (a, b))
    return pd.Series((one == two).sum(1).astype(np.int32))


def compare_small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each node that agree well enough; rows come sorted by node, a node has at most ``SMALL`` rows."""
    names = ["a", "b", "agree"]

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        at = 0
        while at < len(rows):
            stop = at
            while stop < len(rows) and rows[stop][0] == rows[at][0]:
                stop += 1
            sig = np.frombuffer(b"".join(r[2] for r in rows[at:stop]), np.uint8).reshape(stop - at, SIGNATURE)
            agree = (sig[:, None, :] == sig[None, :, :]).sum(2)
            for i, j in zip(*np.nonzero(np.triu(agree >= LEAST_AGREE, 1)), strict=True):
                out.append((*sorted((rows[at + i][1], rows[at + j][1])), int(agree[i, j])))
            at = stop
        a, b, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int32())], names)

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        yield pairs(held[:cut])
        held = held[cut:]
    yield pairs(held)


def with_sizes(members: DataFrame) -> DataFrame:
    """Members of nodes that have two or more, with the node's size ``n``."""
    sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialise(members.join(sizes, "path"), "nodes")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, agree) of the trees, and members (path, cls) of nodes that stayed large, if any."""
    roots = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.get("tokens", F.lit(t * LEVELS)), F.get("tokens", F.lit(t * LEVELS + 1))).alias("path")) for t in range(TREES)))
    live = with_sizes(classes.select("cls", F.explode(roots).alias("r")).select("r.*", "cls"))
    small, stars = [], []
    signed = classes.select("cls", "sig")
    for depth in range(2, DEPTH + 1):
        small.append(live.where(F.col("n") <= SMALL))
        big = live.where(F.col("n") > SMALL)
        if big.isEmpty():
            big = None
            break
        pivots = big.groupBy("path").agg(F.min("cls").alias("pivot"))
        stars.append(big.join(pivots, "path").where("cls != pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
        if depth < DEPTH:
            token = F.get("tokens", F.pmod(F.col("tree") * LEVELS + depth, F.lit(TREES * LEVELS)))
            live = with_sizes(big.join(classes.select("cls", "tokens"), "cls").select("tree", F.xxhash64("path", F.lit(depth), token).alias("path"), "cls"))
    leaves = small[0]
    for s in small[1:]:
        leaves = leaves.unionByName(s)
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = leaves.join(signed, "cls").select("path", "cls", "sig").repartition(n, "path").sortWithinPartitions("path")
    found = nodes.mapInArrow(compare_small, "a binary, b binary, agree int")
    if stars:
        star = stars[0]
        for s in stars[1:]:
            star = star.unionByName(s)
        found = found.unionByName(agreeing(star, signed))
    return materialise(found.groupBy("a", "b").agg(F.max("agree").alias("agree")), "candidates"), big


def agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Distinct ``pairs`` (a, b) whose signatures agree well enough."""
    one, two = (signed.select(F.col("cls").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    both = pairs.distinct().join(one, "a").join(two, "b")
    return both.select("a", "b", agreement("sig_a", "sig_b").alias("agree")).where(F.col("agree") >= LEAST_AGREE)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough by their full sets."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("cls").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(check, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``cls`` and ``label``, the least class reachable, for the ends of ``links`` (a, b).

    Each round a class points to the least of itself and its neighbours, pointers are followed to their end, and the links
    between the ends are the next round's: a link within one component is read once, however many rounds follow.
    """
    known = lambda c: roots.select(F.col("cls").alias(c), F.col("label").alias(f"label_{c}"))
    edges, labels = materialise(links.select("a", "b").distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = followed(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("cls").alias("label"), F.col("label").alias("above"))
            labels = materialise(labels.join(up, "label", "left").select("cls", F.coalesce("above", "label").alias("label")), "labels")
        ends = edges.join(known("a"), "a").join(known("b"), "b").where("label_a != label_b")
        edges = materialise(ends.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels


def followed(pointers: DataFrame) -> DataFrame:
    """``cls`` and the ``label`` at the end of its pointers, which never rise; the steps double each round."""
    pointers = materialise(pointers, "pointers")
    while True:
        up = pointers.select(F.col("cls").alias("label"), F.col("label").alias("above"))
        step = materialise(pointers.join(up, "label").select("cls", "label", "above"), "pointers")
        if step.where("label != above").isEmpty():
            return pointers
        pointers = step.select("cls", F.col("above").alias("label"))


def crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends are not yet in one component."""
    one, two = (labels.select(F.col("cls").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def confirmed_in_blocks(large: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, among the members (path, cls) of nodes that stayed large.

    Nodes that share members are one group. Those of its members outside its largest component are the query set; all members
    are compared with all of it, in blocks of about ``BLOCK`` by ``BLOCK``, so a group is never in one task. Only links leave a task,
    of a block no more than join its components: one between components that earlier links of the block have joined adds nothing.
    """
    pivots = large.groupBy("path").agg(F.min("cls").alias("a"))
    group = components(large.join(pivots, "path").where("cls != a").select("a", F.col("cls").alias("b"))).withColumnRenamed("label", "grp")
    named = materialise(group.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "groups")
    sizes = named.groupBy("grp", "label").count()
    main = sizes.groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
    main = main.where("most < all").select("grp", "main", F.ceil(F.col("all") / BLOCK).alias("rows"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("cols"))
    members = named.join(main, "grp").join(classes.select("cls", "sig"), "cls").join(sets, "cls")
    block = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).alias(c)
    every = lambda c: F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(c)
    data = ("label", "cls", "sig", "hashes")
    queries = members.where("label != main").select("grp", every("rows"), block("cols"), F.lit(0).alias("side"), *data)
    rest = members.select("grp", block("rows"), every("cols"), F.lit(1).alias("side"), *data)
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = queries.unionByName(rest).withColumn("at", F.xxhash64("grp", "rows", "cols")).select("at", "side", *data)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, signs, above = None, [], None, {}

        def root(label: bytes) -> bytes:
            while label in above:
                label = above[label]
            return label

        for batch in batches:
            found = []
            for key, side, label, cls, sig, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    at, asked, signs, above = key, [], None, {}  # a block's queries come first
                if side == 0:
                    asked.append((label, cls, np.frombuffer(sig, np.uint8), np.frombuffer(hashes, np.uint64)))
                    continue
                if not asked:
                    continue
                if signs is None:
                    signs = np.array([x[2] for x in asked])
                mine = np.frombuffer(hashes, np.uint64)
                for i in np.flatnonzero((signs == np.frombuffer(sig, np.uint8)).sum(1) >= LEAST_AGREE).tolist():
                    if (mine_at := root(label)) != (other := root(asked[i][0])) and similar(mine, asked[i][3], percent):
                        above[max(mine_at, other)] = min(mine_at, other)
                        found.append(sorted((cls, asked[i][1])))
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.binary()) for j in (0, 1)], ["a", "b"])

    return both.repartition(n, "at").sortWithinPartitions("at", "side").mapInArrow(compare, "a binary, b binary").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id``, ``kept`` (whether the row has the least id of its component) and ``v``.

    ``v``, the xxhash64 of the text, tells rows of one id apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(sketches(docs, id_col, text_col, size), "sketches")
    filled = rows.where("cls is not null").groupBy("cls")
    classes = materialise(filled.agg(F.min("id").alias("rep"), F.first("tokens").alias("tokens"), F.first("sig").alias("sig")), "classes")
    pairs, large = candidates(classes)

    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    if large is not None:
        ends = ends.unionByName(large.select("cls"))
    wanted = classes.select("cls", "rep").join(ends.distinct(), "cls")
    known = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")))
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(wanted.select(known("rep").alias("hash"))))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.passes(h.to_numpy().view(np.uint64)))

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, 0):
                found = [s for s in shingle_sets(part.column(0).to_pylist(), hashes, size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(digest, found)), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["cls", "hashes"])

    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where(maybe(known("id"))).select("text")
    sets = texts.mapInArrow(full, "cls binary, hashes binary").join(ends.distinct(), "cls", "left_semi")
    sets = materialise(sets.groupBy("cls").agg(F.first("hashes").alias("hashes")), "sets")

    best = [pairs.groupBy(F.col(x)).agg(F.max_by(F.col(y), F.struct("agree", y)).alias(y)).select("a", "b") for x, y in ("ab", "ba")]
    first = materialise(best[0].unionByName(best[1]).distinct(), "first")
    links = materialise(confirmed(first, sets, percent), "confirmed")
    labels = components(links)
    others = crossing(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), labels)
    more = materialise(confirmed(others, sets, percent), "confirmed")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    if large is not None:
        more = materialise(confirmed_in_blocks(large, labels, classes, sets, percent), "confirmed")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    named = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    placed = named.join(least, "label").select("cls", "component")
    out = rows.select("id", "v", "n_shingles", "cls").join(placed, "cls", "left").select("id", "v", "n_shingles", F.coalesce("component", "id").cast(kind).alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept, "v")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the least id, and one of rows with equal id and text."""
    names = docs.columns
    id_, v_, rows_, row_ = free_names(docs, "id_", "v_", "rows_", "row_")
    kept = near_duplicates(docs, id_col, text_col, size, percent).where("kept").groupBy(F.col(id_col).alias(id_), F.col("v").alias(v_)).agg(F.count(F.lit(1)).alias(rows_))
    stay = docs.join(kept, col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(col(text_col)) == F.col(v_)))
    one = F.row_number().over(Window.partitionBy(id_, v_).orderBy(F.xxhash64(*map(col, names))))
    many = stay.where(F.col(rows_) > 1).withColumn(row_, one).where(F.col(row_) == 1).drop(row_)
    return stay.where(F.col(rows_) == 1).unionByName(many).select(*map(col, names))
