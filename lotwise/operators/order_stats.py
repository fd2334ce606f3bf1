"""Exact order statistics that never gather a whole column in one task.

* ``global_quantiles``  - a few exact quantiles of whole columns, by bracketing and counting.
* ``value_positions``   - for every distinct value, how many rows lie below it (ranks, AUC, percentiles).
* ``grouped_quantiles`` - exact quantiles per group, with a second way for very large groups.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BRACKET_ACCURACY = 10_000
BRACKET_ROWS = 200_000      # a bracket that holds no more rows than this is resolved exactly
BUCKET_ROWS = 1_000_000     # distinct values sorted by one task in value_positions
GROUP_ROWS = 1_000_000      # largest group that one percentile buffer may hold


# ------------------------------------------------------------------------------------------------
def global_quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[Column | str, Sequence[float]]]
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns.

    A sketch gives a bracket around each wanted rank; counting the rows below and inside the bracket
    proves that it holds the rank, and brackets are narrowed until they are small. Only scalars reach
    the driver: their number depends on ``wanted``, not on the data.
    """
    names = list(wanted)
    cols = {n: (F.col(c) if isinstance(c, str) else c).cast("double") for n, (c, _) in wanted.items()}
    probs = {n: list(p) for n, (_, p) in wanted.items()}
    if not names:
        return {}
    base = df.select(*[cols[n].alias(f"v{i}") for i, n in enumerate(names)])
    if base.count() <= BRACKET_ROWS:  # every buffer is bounded by the row count just checked
        marks = [F.array(*[F.lit(float(p)) for p in probs[n]]) for n in names]
        row = base.agg(*[F.percentile(f"v{i}", marks[i]) for i in range(len(names))]).first()
        return {n: [None] * len(probs[n]) if row[i] is None else list(row[i]) for i, n in enumerate(names)}

    delta = 2.0 / BRACKET_ACCURACY
    aggs = []
    for i, n in enumerate(names):
        v = F.col(f"v{i}")
        marks = [q for p in probs[n] for q in (max(p - delta, 0.0), min(p + delta, 1.0))]
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            F.percentile_approx(v, marks, BRACKET_ACCURACY).alias(f"q{i}"),
        ]
    first = base.agg(*aggs).first()

    jobs = []  # one per (column, probability)
    for i, n in enumerate(names):
        count = first[f"n{i}"]
        for j, p in enumerate(probs[n]):
            job = {"i": i, "name": n, "j": j, "n": count, "below": 0, "value": None}
            if count:
                k = p * (count - 1)
                job.update(k0=math.floor(k), k1=math.ceil(k), frac=k - math.floor(k))
                if count <= BRACKET_ROWS:
                    job.update(lo=first[f"lo{i}"], hi=first[f"hi{i}"], inside=count)
                else:
                    q = first[f"q{i}"]
                    lo = first[f"lo{i}"] if p - delta <= 0 else q[2 * j]
                    hi = first[f"hi{i}"] if p + delta >= 1 else q[2 * j + 1]
                    job.update(lo=lo, hi=hi, inside=None)
            jobs.append(job)

    _narrow(base, [job for job in jobs if job["n"] and job["inside"] is None], first)
    _resolve(base, [job for job in jobs if job["n"]])

    out: dict[str, list[float | None]] = {n: [None] * len(probs[n]) for n in names}
    for job in jobs:
        out[job["name"]][job["j"]] = job["value"]
    return out


def _between(job) -> Column:
    v = F.col(f"v{job['i']}")
    return (v >= F.lit(job["lo"])) & (v <= F.lit(job["hi"]))


def _narrow(base: DataFrame, jobs: list[dict], first) -> None:
    """Count below/inside each bracket, widen a bracket that misses its rank, shrink a large one."""
    pending = list(jobs)
    while pending:
        aggs = []
        for a, job in enumerate(pending):
            v = F.col(f"v{job['i']}")
            aggs += [
                F.count_if(v < F.lit(job["lo"])).alias(f"b{a}"),
                F.count_if(_between(job)).alias(f"c{a}"),
            ]
        row = base.agg(*aggs).first()
        shrink = []
        for a, job in enumerate(pending):
            job["below"], job["inside"] = row[f"b{a}"], row[f"c{a}"]
            held = job["below"] <= job["k0"] and job["k1"] < job["below"] + job["inside"]
            if not held:  # start from the whole column with a wider margin; one as wide as the column holds every rank
                job["lo"], job["hi"] = first[f"lo{job['i']}"], first[f"hi{job['i']}"]
                job["below"], job["inside"] = 0, job["n"]
                job["slack"] = 4.0 * job.get("slack", 1.0)
            if job["inside"] > BRACKET_ROWS and job["lo"] < job["hi"]:
                shrink.append(job)
        if not shrink:
            return
        aggs = []
        for a, job in enumerate(shrink):
            v = F.col(f"v{job['i']}")
            width = 4.0 * job.get("slack", 1.0) / BRACKET_ACCURACY
            p0 = max((job["k0"] - job["below"]) / job["inside"] - width, 0.0)
            p1 = min((job["k1"] - job["below"]) / job["inside"] + width, 1.0)
            aggs.append(
                F.percentile_approx(F.when(_between(job), v), [p0, p1], BRACKET_ACCURACY).alias(f"q{a}")
            )
        row = base.agg(*aggs).first()
        pending = []
        for a, job in enumerate(shrink):
            lo, hi = row[f"q{a}"]
            if (lo, hi) != (job["lo"], job["hi"]):  # otherwise few distinct values fill the bracket
                job["lo"], job["hi"], job["inside"] = lo, hi, None
                pending.append(job)


def _resolve(base: DataFrame, jobs: list[dict]) -> None:
    """Pick the two neighbouring order statistics of each rank inside its bracket."""
    brackets: dict[tuple, int] = {}
    for job in jobs:
        job["key"] = brackets.setdefault((job["i"], job["lo"], job["hi"]), len(brackets))
    if not brackets:
        return
    sample = {job["key"]: job for job in jobs}
    entries = F.array_compact(
        F.array(
            *[
                F.when(_between(sample[key]), F.struct(F.lit(key).alias("key"), F.col(f"v{i}").alias("v")))
                for (i, _, _), key in brackets.items()
            ]
        )
    )
    counted = (
        base.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.key").alias("key"), F.col("e.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(W.partitionBy("key").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranks = None
    for job in jobs:
        for k in {job["k0"], job["k1"]}:
            k -= job["below"]
            hit = (F.col("key") == job["key"]) & (F.col("upto") - F.col("n") <= k) & (F.col("upto") > k)
            ranks = hit if ranks is None else ranks | hit
    rows = counted.withColumn("upto", upto).where(ranks).collect()  # at most two per wanted quantile

    def at(job, k):
        k -= job["below"]
        for r in rows:
            if r["key"] == job["key"] and r["upto"] - r["n"] <= k < r["upto"]:
                return r["v"]
        raise AssertionError("rank outside its bracket")

    for job in jobs:
        lo, hi = at(job, job["k0"]), at(job, job["k1"])
        job["value"] = lo + (hi - lo) * job["frac"]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {n: v[0] for n, v in global_quantiles(df, {c: (c, [0.5]) for c in columns}).items()}


# ------------------------------------------------------------------------------------------------
def value_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per (group, distinct non-null value): ``n``, ``below``, ``total`` (+ extras, ``below_<extra>``).

    Equal values are counted before the shuffle. Values are cut into buckets by quantiles of the whole
    column, so that a group holding most of the rows is still spread over many tasks; the running counts
    inside a bucket are shifted by the totals of the buckets before it.
    """
    extra = dict(extra or {})
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("n"), *[c.alias(x) for x, c in extra.items()])
    )
    measures = ["n", *extra]
    n_rows = df.select(F.count(value)).first()[0]
    before = lambda part: W.partitionBy(*part).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    name = lambda m: "below" if m == "n" else f"below_{m}"
    tot = lambda m: "total" if m == "n" else f"total_{m}"

    if n_rows <= BUCKET_ROWS:
        part = keys or [F.lit(0)]
        out = counted
        for m in measures:
            out = out.withColumn(name(m), F.coalesce(F.sum(m).over(before(part)), F.lit(0)))
        for m in measures:
            out = out.withColumn(tot(m), F.sum(m).over(W.partitionBy(*part)))
        return out

    buckets = max(2, n_rows // BUCKET_ROWS)
    marks = [b / buckets for b in range(1, buckets)]
    cuts = df.select(F.percentile_approx(F.col(value).cast("double"), marks, 10 * buckets).alias("q")).first()["q"]
    cuts = sorted({c for c in cuts if math.isfinite(c)}) or [0.0]
    # infinities fall into the outer buckets; NaN, the greatest value in order, into one of its own behind them
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol="_bucket", handleInvalid="keep")
    placed = cut.transform(counted)
    part = [*keys, "_bucket"]
    sums = placed.groupBy(*part).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    # at most one row per bucket and group
    group = W.partitionBy(*(keys or [F.lit(0)]))
    ordered = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    for m in measures:
        sums = sums.withColumn(f"_o_{m}", F.coalesce(F.sum(f"_s_{m}").over(ordered), F.lit(0)))
        sums = sums.withColumn(tot(m), F.sum(f"_s_{m}").over(group))
    sums = sums.select(*part, *[f"_o_{m}" for m in measures], *[tot(m) for m in measures])
    out = placed.join(sums, part)
    for m in measures:
        inner = F.coalesce(F.sum(m).over(before(part)), F.lit(0))
        out = out.withColumn(name(m), inner + F.col(f"_o_{m}"))
    return out.select(*keys, value, *measures, *[name(m) for m in measures], *[tot(m) for m in measures])


def average_rank() -> Column:
    """Mean rank over ties, from the columns of ``value_positions``."""
    return F.col("below") + (F.col("n") + F.lit(1)) / F.lit(2.0)


# ------------------------------------------------------------------------------------------------
def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Sequence[tuple[Column, Mapping[str, float]]],
    extra: Sequence[Column] = (),
    group_rows: int = GROUP_ROWS,
    known_max: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, with further aggregates in ``extra``.

    ``wanted`` lists ``(value, {output name: probability})``. Where the largest group is small enough
    for one buffer, a plain aggregation answers. Otherwise the large groups, and only these, are
    answered through ``value_positions``. A caller that can bound the group size passes ``known_max``
    and saves the count.
    """
    keys = list(keys)
    if known_max is not None and known_max <= group_rows:
        return _direct_quantiles(df, keys, wanted, extra)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= group_rows:
        return _direct_quantiles(df, keys, wanted, extra)

    large = sizes.where(F.col("_rows") > group_rows).select(*keys)
    small_part = _direct_quantiles(_match(df, large, keys, "left_anti"), keys, wanted, extra)
    rest = _match(df, large, keys, "left_semi")
    out = rest.groupBy(*keys).agg(*(extra or [F.count(F.lit(1)).alias("_rows")]))
    for value, names in wanted:
        placed = value_positions(rest.select(*keys, value.cast("double").alias("_v")), keys, "_v")
        picks = []
        for name, p in names.items():
            k = (F.col("total") - 1) * F.lit(float(p))
            lo, hi = F.floor(k), F.ceil(k)
            at = lambda r: F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("n")), F.col("_v")))
            picks.append((at(lo) + (at(hi) - at(lo)) * F.max(k - lo)).alias(name))
        got = placed.groupBy(*keys).agg(*picks)
        out = _match(out, got, keys, "left")
    return small_part.unionByName(out.select(*small_part.columns))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where null equals null, as in grouping."""
    marked = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(marked[f"_k_{k}"])
        cond = c if cond is None else cond & c
    joined = left.join(marked, cond, how)
    return joined.drop(*[f"_k_{k}" for k in keys])


def _direct_quantiles(df, keys, wanted, extra):
    aggs, outputs = [], []
    for t, (value, names) in enumerate(wanted):
        probs = F.array(*[F.lit(float(p)) for p in names.values()])
        aggs.append(F.percentile(value.cast("double"), probs).alias(f"_q{t}"))
        outputs += [F.get(F.col(f"_q{t}"), F.lit(j)).alias(n) for j, n in enumerate(names)]
    grouped = df.groupBy(*keys).agg(*aggs, *extra)
    others = [c for c in grouped.columns if c not in keys and not c.startswith("_q")]
    return grouped.select(*keys, *outputs, *others)
