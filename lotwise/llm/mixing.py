"""Mixing to target weights: soft membership in domains, and document rates by projected-gradient least squares.

``classifier`` learns a multinomial naive Bayes model over hashed words from a labelled table (at most ``max_labelled`` ids,
those with the smallest hashes; that table is broadcast). ``memberships`` adds ``n_tokens`` and ``posterior`` (one
probability per domain, in the order of ``Classes.domains``). ``fit`` seeks rates r >= 0 with

    sum over documents of rate x tokens x posterior = target x all tokens,   for every domain,

by projected gradient from r = 1, in the metric of document lengths, so that a rate depends on the posterior only. Gradients are added
up and their sum is projected: the rate of a document is max(0, 1 - posterior . sum), so nothing per document is kept on the driver or
between steps, and however many steps there were a rate costs the same. A gradient is weighed by the inverse of the common spread (the
sums of tokens x posterior x posterior) of the documents whose rate is above zero: where none falls to zero or leaves it, one step is
the whole way. A step is halved until it brings down what the projected gradient descends on (the squares of the rates, less their
goals), which is convex, so the steps lead to the rates next to 1 that meet the targets. A step needs one aggregation to as many
numbers as there are pairs of domains. ``with_rates`` adds ``rate`` and ``copies``: the whole part of the rate, and one more where the
fraction exceeds a hash of the text and id, so the same rows come at every run.

Domains without labelled rows are left out, the other targets grow in proportion; targets that cannot be met are approached
(``Rates.residual``). Without labelled rows, documents or tokens all rates are 1. Null and empty texts have no tokens and the prior
as posterior. Repeated rows count each; other columns stay, those named as the added ones are replaced. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import col, free_names
from lotwise.llm.quality_rules import words_of

BUCKETS = 1 << 16
PUNCTUATION = ".,;:!?()\"'"
RIDGE = 1e-9
ADDED = ("n_tokens", "posterior", "rate", "copies")


@dataclass
class Classes:
    domains: list[str]
    prior: list[float]
    table: DataFrame  # one row: for each bucket the log probabilities of the domains, then 1


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.btrim(word, F.lit(PUNCTUATION))), F.lit(BUCKETS)).cast("int")


def lowered(text_col: str) -> Column:
    return words_of(F.lower(F.coalesce(col(text_col), F.lit(""))))


def classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", domain_col: str = "domain", text_col: str = "text", max_labelled: int = 20_000, max_domains: int = 50, smoothing: float = 0.1) -> Classes:
    """``labelled`` has one domain per id (of several the first by name counts)."""
    named = labelled.select(col(id_col).alias("id"), col(domain_col).cast("string").alias("domain")).where("id is not null and domain is not null")
    picked = named.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    sizes = picked.groupBy("domain").count().orderBy("domain").limit(max_domains + 1).collect()
    if len(sizes) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    domains, n = [r.domain for r in sizes], sum(r["count"] for r in sizes)
    words = docs.select(col(id_col).alias("id"), lowered(text_col).alias("w")).join(F.broadcast(picked), "id")
    tokens = words.select("domain", F.explode_outer("w").alias("w")).where("w is not null").select("domain", bucket(F.col("w")).alias("bucket"))
    counts = tokens.groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)), F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    names = [f"n{i}" for i in range(len(domains))]
    row = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", *names))).alias("c"), *(F.sum(c).alias(c) for c in names))
    log = lambda x, c: F.log((x[c] + smoothing) / (F.col(c) + smoothing * BUCKETS))
    table = row.select(F.transform("c", lambda x: F.array(*(log(x, c) for c in names), F.lit(1.0))).alias("t"))
    return Classes(domains, [r["count"] / n for r in sizes], table)


def memberships(docs: DataFrame, classes: Classes, text_col: str = "text") -> DataFrame:
    d = len(classes.domains)
    plain = docs.drop(*ADDED)
    words_, table_, sums_, logits_, odds_ = free_names(plain, "words_", "table_", "sums_", "logits_", "odds_")
    own = plain.withColumn(words_, lowered(text_col)).withColumn(table_, classes.table.scalar())
    zero = F.array_repeat(F.lit(0.0), d + 1)
    sums = F.aggregate(words_, zero, lambda s, w: F.zip_with(s, F.get(table_, bucket(w)), lambda x, y: x + y))
    summed = own.withColumn(sums_, sums).drop(words_, table_)
    logits = F.array(*(F.get(sums_, F.lit(i)) + float(np.log(p)) for i, p in enumerate(classes.prior))) if d else F.array().cast("array<double>")
    scored = summed.withColumn(logits_, logits).withColumn(odds_, F.transform(logits_, lambda x: F.exp(x - F.array_max(logits_))))
    total = F.aggregate(odds_, F.lit(0.0), lambda s, x: s + x)
    return scored.withColumns({"n_tokens": F.get(sums_, F.lit(d)).cast("long"), "posterior": F.transform(odds_, lambda x: x / total)}).drop(sums_, logits_, odds_)


@dataclass
class Rates:
    steps: list[tuple[list[float], float]]  # weighed residuals of the domains, and the momentum that follows
    residual: float                         # what is left, as a share of all tokens
    totals: list[float]                     # tokens expected from each domain

    def column(self, extrapolated: bool = False) -> Column:
        """The rate of a document, from its ``posterior``."""
        if not self.steps:
            return F.lit(1.0)
        history = F.array(*(F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(m).alias("m")) for g, m in self.steps))

        def step(s: Column, h: Column) -> Column:
            slope = F.aggregate(F.zip_with("posterior", h["g"], lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)
            rate = F.greatest(F.lit(0.0), s["y"] - slope)
            return F.struct(rate.alias("r"), (rate + h["m"] * (rate - s["r"])).alias("y"))

        return F.aggregate(history, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step, lambda s: s["y"] if extrapolated else s["r"])

    def sums(self, members: DataFrame, extrapolated: bool = False) -> np.ndarray:
        """Tokens from each domain at these rates."""
        return _at(members, len(self.totals), self.column(extrapolated))[0]


def _at(members: DataFrame, d: int, rate: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """At these rates the tokens from each domain, their spread over documents with a rate above zero, and the squares of the rates."""
    names = free_names(members, "n_", "r_", "q_", *(f"p{i}_" for i in range(d)))
    n, r, q, p = *map(F.col, names[:3]), [F.col(x) for x in names[3:]]
    known = members.select(F.coalesce(F.col("n_tokens").cast("double"), F.lit(0.0)).alias(names[0]), "posterior", *(F.coalesce(F.get("posterior", F.lit(i)), F.lit(0.0)).alias(x) for i, x in enumerate(names[3:])))
    weighed = known.where(n > 0).withColumn(names[1], rate).withColumn(names[2], F.when(r > 0, n).otherwise(F.lit(0.0)))
    spread = {f"m{i}_{j}": F.sum(q * p[i] * p[j]) for i in range(d) for j in range(i, d)}
    sums = {f"t{i}": F.sum(n * r * p[i]) for i in range(d)} | spread | {"squares": F.sum(n * r * r)}
    row = weighed.agg(*(F.coalesce(c, F.lit(0.0)).alias(name) for name, c in sums.items())).first()
    curve = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    return np.array([row[f"t{i}"] for i in range(d)]), curve, row["squares"]


def fit(members: DataFrame, classes: Classes, targets: dict[str, float], tolerance: float = 1e-4, patience: int = 20) -> Rates:
    """Rates for ``members`` (``n_tokens``, ``posterior``), which are read once per step; give a written table.

    Steps go on until all totals are within ``tolerance``, or until ``patience`` steps have not brought them nearer by a hundredth,
    as with targets that no rates can meet; what is left is ``residual`` then.
    """
    d = len(classes.domains)
    weights = np.array([max(0.0, float(targets.get(x, 0.0))) for x in classes.domains])
    all_tokens = float(members.agg(F.sum(F.col("n_tokens").cast("double"))).first()[0] or 0)
    if not d or not all_tokens or not weights.sum():
        return Rates([], 0.0, [0.0] * d)
    goal = weights / weights.sum() * all_tokens

    def at(total: np.ndarray) -> tuple[Rates, np.ndarray, np.ndarray, float]:
        out = Rates([(total.tolist(), 0.0)], 0.0, [0.0] * d)
        got, curve, squares = _at(members, d, out.column())
        return out, got, curve, float(squares / 2 + total @ goal)

    total = np.zeros(d)
    out, got, curve, height = at(total)
    kept, best, since = (out, got), np.inf, 0
    while True:
        left = np.abs(got - goal).max()
        since = 0 if left < 0.99 * best else since + 1
        if left < best:
            kept, best = (out, got), left
        if left <= tolerance * all_tokens or since >= patience:
            break
        # a little of all tokens, for domains that no document with a rate has
        step = np.linalg.solve(curve + RIDGE * all_tokens * np.eye(d), got - goal)
        share, fall = 1.0, float(step @ (got - goal))
        while True:
            tried = at(total + share * step)
            if tried[3] <= height - 1e-4 * share * fall or share < 1e-6:
                break
            share /= 2
        total = total + share * step
        out, got, curve, height = tried
    out, got = kept
    return Rates(out.steps, float(np.abs(got - goal).max() / all_tokens), got.tolist())


def with_rates(members: DataFrame, rates: Rates, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """``members`` with ``rate`` and ``copies``."""
    key = [col(id_col), *([col(text_col)] if text_col else [])]
    draw = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = members.withColumn("rate", rates.column())
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
