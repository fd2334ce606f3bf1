"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised bit overlap.

Entropy is measured in every window of ``WINDOW`` bytes, by the counts of the byte that enters and the one that leaves.
How often each entropy value comes up over all windows of the corpus (``ranks``, one pass, ``LEVELS`` numbers) orders the
values: the rarer, the lower the rank; flat windows are never taken. In each run of ``WINDOW`` neighbouring windows the
leftmost of lowest rank scores; windows that score at least ``POPULAR`` times are the features. Their hashes set
``PROBES`` bits each in filters of ``FILTER_BITS`` bits; a filter takes ``MOST`` features, then the next begins.

A fingerprint is the text ``features:filters in base64``. ``likeness`` is the mean, over the filters of the fingerprint with
fewer, of the best overlap with a filter of the other: shared bits above those expected by chance, over the most possible.
Equal fingerprints have likeness 1. A text without such a window (a short or a flat one) is one feature as a whole; an
empty or null text has no filter and is like another such text only.

With ``short`` (ranks of windows of ``SHORT`` bytes over the whole corpus), texts under ``SHORT_BELOW`` bytes also get the
features of such windows in runs of ``SHORT``, scored at least ``SHORT_POPULAR`` times, and those under four windows
all their pieces of ``TINY`` bytes; only flat texts and those under ``TINY`` bytes are then one feature as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import col, pieces

WINDOW = 64
LEVELS = 1024
POPULAR = 16
SHORT = 8
SHORT_POPULAR = SHORT * POPULAR // WINDOW
SHORT_BELOW = 4 * WINDOW
TINY = 4
FILTER_BITS = 2048
PROBES = 5
MOST = 160
#: c log2 c in 1/65536 for each count, and the sum at which a window is flat (a few values only)
WEIGHT = np.array([0] + [round(c * math.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)
FULL = int(WEIGHT[WINDOW])
FLAT_LEVEL = LEVELS // 10
POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def levels(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Entropy of each window of ``x`` as a whole number below ``LEVELS``."""
    n = len(x)
    if n < window:
        return np.zeros(0, np.int64)
    behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the window - 1 before, and after
    for k in range(1, window):
        same = (x[k:] == x[:-k]).view(np.uint8)
        behind[k:] += same
        ahead[:-k] += same
    gain = WEIGHT[behind + 1] - WEIGHT[behind]  # right for each byte that enters, once a whole window lies behind it
    loss = WEIGHT[ahead + 1] - WEIGHT[ahead]
    first = np.bincount(x[:window], minlength=256)
    total = np.concatenate([[WEIGHT[first].sum()], gain[window:] - loss[: n - window]]).cumsum()
    full = int(WEIGHT[window])
    return (full - total) * (LEVELS - 1) // full


def windows_in(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which window starts of texts put one after another lie in one text."""
    n = int(sizes.sum())
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    return left[: max(0, n - window + 1)] >= window


def scored(texts: list[bytes], rank: np.ndarray, window: int, popular: int) -> dict[int, list[bytes]]:
    """The windows of each text that score at least ``popular`` times, in order; texts without any are left out."""
    sizes = np.array(list(map(len, texts)), np.int64)
    joined = b"".join(texts)
    level = levels(np.frombuffer(joined, np.uint8), window)
    if not len(level):
        return {}
    inside = windows_in(sizes, window)
    key = rank[level]
    worst = np.int64(1) << np.int64(62)
    key = np.where(inside & (level >= FLAT_LEVEL), (key.astype(np.int64) << 40) + np.arange(len(key)), worst)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(key)]
    low, span = key, 1
    while span < window and len(low) > span:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < window:
        return {}
    runs = low[inside[: len(low)] & inside[window - 1 :][: len(low)] & (text[: len(low)] == text[window - 1 :][: len(low)])]
    at, score = np.unique(runs[runs < worst] & ((1 << 40) - 1), return_counts=True)
    at = at[score >= popular]
    picked: dict[int, list[bytes]] = {}
    for i, t in zip(at.tolist(), text[at].tolist(), strict=True):
        picked.setdefault(t, []).append(joined[i : i + window])
    return {t: list(dict.fromkeys(found)) for t, found in picked.items()}


def features(texts: list[bytes], rank: np.ndarray, short: np.ndarray | None = None) -> list[list[bytes]]:
    """The features of each text, in order; those of short windows last."""
    found = scored(texts, rank, WINDOW, POPULAR)
    if short is not None:
        small = [i for i, t in enumerate(texts) if 2 * SHORT <= len(t) < SHORT_BELOW]
        for j, more in scored([texts[i] for i in small], short, SHORT, SHORT_POPULAR).items():
            found[small[j]] = found.get(small[j], []) + more
        for i, t in enumerate(texts):
            if TINY <= len(t) < 4 * SHORT:
                found[i] = found.get(i, []) + list(dict.fromkeys(t[k : k + TINY] for k in range(len(t) - TINY + 1)))
    return [found.get(i, [t] if t else []) for i, t in enumerate(texts)]


def fingerprint(found: list[bytes]) -> str:
    filters = np.zeros((-(-len(found) // MOST), FILTER_BITS // 8), np.uint8)
    for i, f in enumerate(found):
        h = xxhash.xxh3_128_intdigest(f)
        for _ in range(PROBES):
            h, bit = divmod(h, FILTER_BITS)
            filters[i // MOST, bit >> 3] |= 1 << (bit & 7)
    return f"{len(found)}:{base64.b64encode(filters.tobytes()).decode()}"


def opened(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The filters of a fingerprint and how many features each has."""
    n, _, filters = text.partition(":")
    bits = np.frombuffer(base64.b64decode(filters), np.uint8).reshape(-1, FILTER_BITS // 8)
    return bits, np.minimum(MOST, int(n) - MOST * np.arange(len(bits)))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (x, nx), (y, ny) = sorted((opened(a), opened(b)), key=lambda f: (len(f[0]), f[1].sum()))
    if not len(x):
        return 0.0
    miss = (1 - 1 / FILTER_BITS) ** PROBES
    chance = FILTER_BITS * (1 - miss ** nx[:, None]) * (1 - miss ** ny[None, :])
    shared = POP[x[:, None, :] & y[None, :, :]].sum(2)
    most = np.minimum(POP[x].sum(1)[:, None], POP[y].sum(1)[None, :])
    over = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(over.max(1).mean())


def ranks(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> np.ndarray:
    """Rank of each entropy level: how many levels are rarer over all windows of all texts. At most ``LEVELS`` rows are collected."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for part in pieces(batch, 0, 1_000_000):
                raw = [(t or "").encode() for t in part.column(0).to_pylist()]
                level = levels(np.frombuffer(b"".join(raw), np.uint8), window)
                total += np.bincount(level[windows_in(np.array(list(map(len, raw)), np.int64), window)], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["level", "n"])

    rows = docs.select(col(text_col).alias("text")).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, np.int64)
    for r in rows:
        n[r.level] = r.n
    out = np.empty(LEVELS, np.int64)
    out[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return out


def compare_edited(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, short: np.ndarray | None = None) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and how alike they are, also to the next row's.

    The edited text has its last quarter replaced by the start of the next row's text; rows go by id (a number, null first),
    equal ids by text, and after the last comes the first. Rows are dealt to ``ranges`` of ids, cut at approximate quantiles
    (four for each shuffle partition unless given); the first row of each range is also sent to the range before it. A
    range is read as a stream, so no more than a batch is held. Equal ids stay in one range.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * n
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    cuts = np.array(sorted(set(rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first().c or [])))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).to_numpy()) if len(cuts) else 0).astype(np.int32))

    dealt = rows.withColumn("range", place("id"))
    first = dealt.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("f")).orderBy("range").collect()
    heads = [(r.range, first[i - 1].range, r.f.id) for i, r in enumerate(first)]  # one for each range
    lent = (
        dealt.join(F.broadcast(spark.createDataFrame(heads, f"range int, before int, first_id {kind}")), "range")
        .where(F.col("id").eqNullSafe(F.col("first_id"))).groupBy("id", "before").agg(F.min("text").alias("text"))
        .select("id", "text", F.col("before").alias("range"), F.lit(True).alias("lent"))
    )
    both = dealt.withColumn("lent", F.lit(False)).unionByName(lent)
    ordered = both.repartition(n, "range").sortWithinPartitions("range", "lent", F.col("id").asc_nulls_first(), "text")
    shared = spark.sparkContext.broadcast((rank, short))

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one, and its fingerprint
        for batch in batches:
            for part in pieces(batch, 1, 1_000_000):
                todo = []
                texts = [t.encode() for t in part.column(1).to_pylist()]
                for row, found in zip(zip(*(c.to_pylist() for c in part.columns), strict=True), features(texts, *shared.value), strict=True):
                    mine = (*row, fingerprint(found))
                    if held and held[2] == row[2] and not held[3]:
                        todo.append((held, mine))
                    held = mine
                yield edited_rows(todo, *shared.value, part.schema.field(0).type)

    made = ordered.mapInArrow(compared, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("id", id_col)


def edited_rows(pairs: list[tuple], rank: np.ndarray, short: np.ndarray | None, id_type: pa.DataType) -> pa.RecordBatch:
    """The result for pairs of (id, text, range, lent, fingerprint), each row with the next one."""
    edited = [(a[1][: len(a[1]) - len(a[1]) // 4] + b[1][: len(a[1]) // 4]).encode() for a, b in pairs]
    prints = list(map(fingerprint, features(edited, rank, short)))
    columns = {
        "id": pa.array([a[0] for a, _ in pairs], id_type),
        "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array([a[4] for a, _ in pairs], pa.string()),
        "edited_fingerprint": pa.array(prints, pa.string()),
        "near_edited": pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
        "near_next": pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
