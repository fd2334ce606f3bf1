"""Secret scan: patterns for known forms, and sliding-window Shannon entropy over candidate strings.

``scan`` adds to its input ``spans``, an array of (kind, start, stop) in code points, stop exclusive, by start and then in
the order of ``kinds()``. The forms ``assign``, ``access`` and ``hex`` are found leftmost and without overlap per kind.
For each of ``CLASSES`` (a class of characters, a window, a threshold in bits) the runs of that class of at least a window's
length are candidates; those that match a pattern of the allow list, or hold one of its values, are passed over. A window
slides over each other candidate; the counts of its characters, and the sum of c log2 c over them, change by the one
that enters and the one that leaves. Windows at or above the threshold are merged where they touch and give spans.

Sums are of integers (2^20 parts), so results do not depend on the order of steps. Null and empty texts have no spans.
Repeated rows are scanned each; other columns stay (one named ``spans`` is replaced). All work is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import col

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a match takes the rest of its run, so the least length can stand in the pattern
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: kind, characters, window, least entropy in bits
CLASSES = (
    ("hex_entropy", "0123456789ABCDEFabcdef", 24, 3.0),
    ("mixed_entropy", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0),
)
#: candidates that are plain words, plain numbers, or ids in the usual form with dashes
ALLOW_PATTERNS = (r"^[A-Z]?[a-z]+$", r"^[A-Z]+$", r"^[0-9]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[-_+/]*$")
ALLOW_VALUES = ("EXAMPLE", "example")
PARTS = 1 << 20


def kinds() -> list[str]:
    return ["assign", "access", "hex", *(c[0] for c in CLASSES)]


def weight(c: int) -> int:
    """c log2 c in parts."""
    return round(c * math.log2(c) * PARTS) if c else 0


def most(window: int, bits: float) -> int:
    """A window has at least ``bits`` of entropy if its sum of weights is not above this."""
    return math.floor((math.log2(window) - bits) * window * PARTS)


def run_of(characters: str, window: int) -> str:
    return f"[{characters.replace('-', '')}{'-' * ('-' in characters)}]{{{window},}}"


def matches(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, leftmost and without overlap: (start, stop, hit). The gaps between them give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,hit:string>>")
    found = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.char_length(x["hit"])).alias("at"),
            F.concat(s["found"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.char_length(x["hit"])).alias("stop"), x["hit"].alias("hit")))).alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(text.rlike(pattern), found).otherwise(empty)


def dense_windows(hit: Column, characters: str, window: int, bits: float) -> Column:
    """Merged windows (lo, hi) of ``hit`` with at least ``bits`` of entropy."""
    f = F.array(*(F.lit(weight(c)) for c in range(window + 2)))
    alphabet = F.lit(characters)
    chars = F.split(hit, "")
    none = F.from_json(F.lit("[]"), "array<struct<lo:int,hi:int>>")
    start = F.struct(
        F.array_repeat(F.lit(0), len(characters) + 1).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), none.alias("done"), F.lit(0).alias("at"),
    )
    pairs = F.transform(chars, lambda ch, i: F.struct(F.instr(alphabet, ch).alias("new"), F.when(i >= window, F.instr(alphabet, F.get(chars, i - window))).otherwise(0).alias("old")))

    def step(s: Column, x: Column) -> Column:
        new, old, counts = x["new"], x["old"], s["counts"]
        count_new, count_old = F.get(counts, new), F.get(counts, old)
        change = F.when(new == old, F.lit(0).cast("long")).otherwise(
            F.get(f, count_new + 1) - F.get(f, count_new) + F.when(old > 0, F.get(f, count_old - 1) - F.get(f, count_old)).otherwise(F.lit(0).cast("long"))
        )
        shifted = F.transform(counts, lambda c, j: c + (j == new).cast("int") - ((j == old) & (old > 0)).cast("int"))
        total, stop = s["sum"] + change, s["at"] + 1
        dense = (stop >= window) & (total <= most(window, bits))
        fresh = dense & ((s["lo"] < 0) | (s["hi"] < stop - window))
        return F.struct(
            shifted.alias("counts"), total.alias("sum"),
            F.when(fresh, stop - window).otherwise(s["lo"]).alias("lo"), F.when(dense, stop).otherwise(s["hi"]).alias("hi"),
            F.when(fresh & (s["lo"] >= 0), F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))).otherwise(s["done"]).alias("done"),
            stop.alias("at"),
        )

    last = lambda s: F.when(s["lo"] >= 0, F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))).otherwise(s["done"])
    return F.aggregate(pairs, start, step, last)


def allowed(hit: Column) -> Column:
    out = F.lit(False)
    for p in ALLOW_PATTERNS:
        out = out | hit.rlike(p)
    for v in ALLOW_VALUES:
        out = out | hit.contains(v)
    return out


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    span = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= LEAST_VALUE)
    found = [F.transform(m, span(k)) for k, m in (("assign", assign), ("access", matches(text, ACCESS)), ("hex", matches(text, HEX)))]
    for kind, characters, window, bits in CLASSES:
        candidates = F.filter(matches(text, run_of(characters, window)), lambda m: ~allowed(m["hit"]))
        inside = F.transform(candidates, lambda m: F.transform(  # noqa: B023
            dense_windows(m["hit"], characters, window, bits),  # noqa: B023
            lambda w: F.struct(F.lit(kind).alias("kind"), (m["start"] + w["lo"]).alias("start"), (m["start"] + w["hi"]).alias("stop")),  # noqa: B023
        ))
        found.append(F.flatten(inside))
    order = F.array(*map(F.lit, kinds()))
    keyed = F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    ordered = F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return docs.withColumn("spans", ordered)


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with each stretch that spans cover, overlapping ones together, replaced by ``mask``."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        between = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(s["out"], between, F.lit(mask))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest_columns(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
