"""Deterministic suitability scores: robust scaling, group scores, soft minimum, gates, ladders.

Scaling follows the fit/transform shape of Spark ML: ``fit_scaling`` reads whole columns and returns a
handful of numbers, which then are literals in one stage of expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.numeric import add_all, clip, half_even, ladder
from lotwise.operators.order_stats import global_quantiles

SCORED_COLUMNS = [*K.FEATURES, "compactness_ratio"]
GROUP_COLUMNS = {"SLOPE": "score_pente", "HYDROLOGY": "score_hydro", "MORPHOLOGY": "score_morpho", "SUNLIGHT": "score_soleil"}


@dataclass
class Scaling:
    """Fill value and percentile range per column."""

    fill: dict[str, float] = field(default_factory=dict)
    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)


def fit_scaling(
    df: DataFrame, columns: Sequence[str] = SCORED_COLUMNS, pct_low: float = 1.0, pct_high: float = 99.0,
    default: float = 0.5,
) -> Scaling:
    """Median (the default where a column is absent or all null), then percentiles of the filled column."""
    present = [c for c in columns if c in df.columns]
    marks = [pct_low / 100.0, pct_high / 100.0]
    known = global_quantiles(df, {c: (c, [0.5, *marks]) for c in present})
    fill = {c: default for c in columns}
    fill.update({c: q[0] for c, q in known.items() if q[0] is not None})
    # filling moves the percentiles only where there was something to fill
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present]).first() if present else {}
    filled = global_quantiles(
        df, {c: (F.coalesce(F.col(c).cast("double"), F.lit(fill[c])), marks) for c in present if holes[c]}
    )
    spans = {c: filled.get(c) or known[c][1:] for c in present}
    low = {c: spans[c][0] if c in spans else fill[c] for c in columns}
    high = {c: spans[c][1] if c in spans else fill[c] for c in columns}
    return Scaling(fill, low, high)


def fit_raw_scaling(df: DataFrame, columns: Sequence[str], pct_low: float = 1.0, pct_high: float = 99.0) -> Scaling:
    """As the plain normaliser does: percentiles of the non-null values, null takes the low end."""
    spans = global_quantiles(df, {c: (c, [pct_low / 100.0, pct_high / 100.0]) for c in columns})
    low = {c: 0.0 if v[0] is None else v[0] for c, v in spans.items()}
    high = {c: 1.0 if v[1] is None else v[1] for c, v in spans.items()}
    return Scaling(dict(low), low, high)


def normalized(s: Scaling, name: str, invert: bool = False, stretch: bool = False, value: Column | None = None) -> Column:
    """Clip to the percentile range and scale to 0..1; a degenerate range gives 0.5 whatever ``invert``.

    The population minimum and maximum are clipped onto the range ends, so the stretch needs no pass of
    its own: its extremes are the logistic values at 0 and at 1.
    """
    lo, hi = s.low[name], s.high[name]
    if lo is None or lo == hi:
        return F.lit(0.5)
    x = F.coalesce((F.col(name) if value is None else value).cast("double"), F.lit(s.fill[name]))
    n = (F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)
    if stretch:
        n = F.lit(1.0) / (F.lit(1.0) + F.exp((n - 0.5) * -6.0))
        low, high = 1 / (1 + math.exp(3.0)), 1 / (1 + math.exp(-3.0))
        n = (n - low) / (high - low + 1e-9)
    return F.lit(1.0) - n if invert else n


def group_scores(df: DataFrame, s: Scaling, has_svf: bool | None = None) -> DataFrame:
    """Slope, hydrology, morphology and sunlight scores on 0..100, one digit."""
    has_svf = "svf_mean" in df.columns if has_svf is None else has_svf
    has_thalweg = "has_thalweg_mean" in df.columns
    n = lambda name, invert=False, stretch=False: _norm(df, s, name, invert, stretch)
    slope = n("slope_p50", True, True) * 0.40 + n("slope_p90", True, True) * 0.35 + n("slope_std", True) * 0.25
    hydro = n("twi_mean", True, True)
    if has_thalweg:
        wet = F.least(F.greatest(F.coalesce(F.col("has_thalweg_mean"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        hydro = hydro * (F.lit(1.0) - wet * 0.4)
    morpho = n("profile_curvature_mean") * 0.44 + n("tri_mean", True) * 0.36 + n("compactness_ratio") * 0.20
    sun = sunlight(df, s, has_svf)
    return df.withColumns(
        {
            "score_pente": half_even(slope * 100.0),
            "score_hydro": half_even(hydro * 100.0),
            "score_morpho": half_even(morpho * 100.0),
            "score_soleil": half_even(sun * 100.0),
        }
    )


def _norm(df, s, name, invert=False, stretch=False):
    return normalized(s, name, invert, stretch) if name in df.columns else F.lit(0.5)


def sunlight(df: DataFrame, s: Scaling, has_svf: bool) -> Column:
    if has_svf:
        return (
            _norm(df, s, "aspect_south_ratio_mean") * 0.40
            + _norm(df, s, "hillshade_winter_mean") * 0.35
            + _norm(df, s, "svf_mean") * 0.25
        )
    return _norm(df, s, "aspect_south_ratio_mean") * 0.57 + _norm(df, s, "hillshade_winter_mean") * 0.43


def tau_group_scores(df: DataFrame, s: Scaling) -> DataFrame:
    """Unstretched group scores ``p h m s`` used to calibrate tau; fit ``s`` on valid rows."""
    n = lambda name, invert=False: _norm(df, s, name, invert)
    slope = n("slope_p50", True) * 0.40 + n("slope_p90", True) * 0.35 + n("slope_std", True) * 0.25
    morpho = n("profile_curvature_mean") * 0.55 + n("tri_mean", True) * 0.45
    return df.withColumns(
        {"p": slope * 100.0, "h": n("twi_mean", True) * 100.0, "m": morpho * 100.0, "s": sunlight(df, s, True) * 100.0}
    )


def softmin(values: Sequence[Column], tau: Column | float) -> Column:
    """Exponentially weighted mean that leans to the smallest value (shifted by the minimum)."""
    t = F.greatest(F.lit(tau) if not isinstance(tau, Column) else tau, F.lit(1e-9))
    low = F.least(*values)
    w = [F.exp((low - v) / t) for v in values]
    return add_all([a * b for a, b in zip(w, values)]) / add_all(w)


def tau_std_curve(groups: DataFrame, taus: Sequence[float]) -> DataFrame:
    """Population std of the combined score for each tau, in one pass (``groups`` holds ``p h m s``)."""
    cols = [F.col(c) for c in ("p", "h", "m", "s")]
    grid = groups.select(*cols, F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    mixed = (add_all(cols) / 4.0) * 0.70 + softmin(cols, F.col("tau")) * 0.30
    return grid.groupBy("tau").agg(F.stddev_pop(mixed).alias("score_std"))


def calibrate_tau(
    groups: DataFrame, target_std: float = 18.0, low: float = 0.5, high: float = 100.0, steps: int = 50, depth: int = 5
) -> float:
    """Bisection for the tau that gives ``target_std``.

    All midpoints that the next ``depth`` steps could visit are evaluated in one job, so fifty steps
    take ten jobs and the path is the one plain bisection would take.
    """
    done = 0
    while done < steps:
        d = min(depth, steps - done)
        tree: list[float] = []
        spans = [(low, high)]
        for _ in range(d):
            mids = [(a + b) / 2 for a, b in spans]
            tree += mids
            spans = [half for (a, b), m in zip(spans, mids) for half in ((a, m), (m, b))]
        std = {r["tau"]: r["score_std"] for r in tau_std_curve(groups, tree).collect()}  # 2**depth rows at most
        for _ in range(d):
            mid = (low + high) / 2
            if std[mid] < target_std:
                high = mid
            else:
                low = mid
        done += d
    return (low + high) / 2


def choose_tau(valid: DataFrame, default: float = 10.0, min_rows: int = 50) -> float:
    """Calibrated tau from valid rows; the default when there are too few."""
    if valid.limit(min_rows + 1).count() <= min_rows:
        return default
    s = fit_scaling(valid, K.FEATURES)
    return calibrate_tau(tau_group_scores(valid, s).select("p", "h", "m", "s"))


def _weighted(weights: dict[str, float]) -> Column:
    return half_even(add_all([F.col(GROUP_COLUMNS[g]) * w for g, w in weights.items()]))


def raw_scores(df: DataFrame, tau: float) -> DataFrame:
    groups = [F.col(c) for c in GROUP_COLUMNS.values()]
    return (
        df.withColumn("score_continu", _weighted(K.WEIGHTS_ALL))
        .withColumn("score_softmin", half_even(softmin(groups, tau)))
        .withColumn("cpi_brut", half_even(F.col("score_continu") * 0.70 + F.col("score_softmin") * 0.30))
    )


def gates(df: DataFrame, strict_reasons: bool = False) -> DataFrame:
    """Cap factor and its reason. By default every steep parcel is reported as the combined gate, as the
    original rule order does; ``strict_reasons`` names the slope gate on its own."""
    above = lambda c, t: F.coalesce(F.col(c) > t, F.lit(False)) if c in df.columns else F.lit(False)
    wet, steep, full = above("has_thalweg_mean", 0.20), above("slope_p90", 25.0), above("ces_existant", 0.80)
    base = F.greatest(F.col("cpi_brut"), F.lit(1.0))
    cap = lambda cond, limit: F.when(cond, F.lit(limit) / base)
    factor = F.least(F.lit(1.0), cap(wet, 30.0), cap(steep, 25.0), cap(full, 40.0))
    steep_reason = F.when(wet, K.GATE_BOTH).otherwise(K.GATE_SLOPE) if strict_reasons else F.lit(K.GATE_BOTH)
    reason = F.when(steep, steep_reason).when(wet, K.GATE_THALWEG).when(full, K.GATE_COVERAGE).otherwise("")
    return df.withColumns({"gate_factor": factor, "gate_reason": reason})


def final_score(df: DataFrame) -> DataFrame:
    cpi = half_even(clip(F.col("cpi_brut") * F.col("gate_factor"), 0.0, 100.0))
    return df.withColumn("CPI_v3", cpi).withColumn("CPI_v3_label", ladder(F.col("CPI_v3"), K.LADDER_FINAL))


def technical_score(df: DataFrame, tau: float) -> DataFrame:
    """Three groups, same gate factor as the final score."""
    groups = [F.col(GROUP_COLUMNS[g]) for g in K.WEIGHTS_TECHNICAL]
    raw = half_even(_weighted(K.WEIGHTS_TECHNICAL) * 0.70 + half_even(softmin(groups, tau)) * 0.30)
    cpi = half_even(clip(raw * F.col("gate_factor"), 0.0, 100.0))
    return df.withColumn("CPI_technique", cpi).withColumn(
        "CPI_technique_label", ladder(F.col("CPI_technique"), K.LADDER_TECHNICAL)
    )


def value_score(df: DataFrame, s: Scaling, has_svf: bool | None = None) -> DataFrame:
    has_svf = "svf_mean" in df.columns if has_svf is None else has_svf
    value = half_even(clip(sunlight(df, s, has_svf) * 100.0, 0.0, 100.0))
    return df.withColumn("CPI_valeur", value).withColumn("CPI_valeur_label", ladder(F.col("CPI_valeur"), K.LADDER_VALUE))


def warnings(df: DataFrame) -> DataFrame:
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    odd = F.coalesce(col("compactness_ratio") < 0.20, F.lit(False)) | F.coalesce(col("elongation_ratio") > 3.0, F.lit(False))
    tight = F.coalesce(col("emprise_residuelle_m2") < K.MIN_FOOTPRINT_M2, F.lit(False))
    return df.withColumns(
        {
            "shape_warning": F.when(odd, K.SHAPE_WARNING).otherwise(""),
            "ces_warning": F.when(tight, K.COVERAGE_WARNING).otherwise(""),
        }
    )


def score_parcels(df: DataFrame, s: Scaling, tau: float, strict_reasons: bool = False) -> DataFrame:
    """All score columns, in one stage of expressions."""
    out = raw_scores(group_scores(df, s), tau)
    out = final_score(gates(out, strict_reasons))
    return warnings(value_score(technical_score(out, tau), s))


def viewer_labels(df: DataFrame) -> DataFrame:
    """Display label, colour and confidence mark, on ladders of their own."""
    conf = F.col("consensus_confidence")
    mark = F.when(conf.isNull(), K.CONFIDENCE_MISSING)
    for bound, sign in K.CONFIDENCE_MARKS:
        mark = mark.otherwise(sign) if bound is None else mark.when(conf >= bound, sign)
    cpi = F.col("CPI_technique")
    return df.withColumns(
        {
            "viewer_label": ladder(cpi, K.LADDER_VIEWER, K.LABEL_MISSING),
            "viewer_colour": ladder(cpi, K.LADDER_COLOUR, K.COLOUR_MISSING),
            "confidence_mark": mark,
        }
    )


def minmax_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max of each column over the table, a degenerate column gives 0.5."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))]).first()
    out = {}
    for c in columns:
        a, b = ends[f"a_{c}"], ends[f"b_{c}"]
        out[c] = F.lit(0.5) if a is None or a == b else (F.col(c) - a) / (b - a)
    return df.withColumns(out)


