"""Fill-in-the-middle: a text is cut at two unit borders and written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

One ``fullmatch`` of ``(unit)*`` by the ``regex`` library keeps every repetition of its group; ``match.ends(1)`` then gives the
number of units and both cut places, with no loop over units. The library's store for repetitions is finite, so a text of
more than ``SLICE`` code points is matched in slices that end where a unit does (after ``border``); the ends of the slices
are put together and are those of one match. Only the text and two numbers go to Python, and three numbers come back; the
output is put together from substrings in the JVM.

Draws are the first four groups of eight digits of the hex sha256 of ``<seed>:<id>``, so they depend on the id alone. With n
units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the larger. A text is left plain
if it is empty, holds a sentinel, or h3 % 100 >= ``percent``; otherwise it is spm if h4 % 100 < ``spm_percent``, else psm.

Null texts count as empty, a null id as an empty one. Repeated rows are treated alike, no rows give no rows. Other columns
stay; those named as in ``ADDED`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import col, free_names

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
SLICE = 1_000_000


def unit_ends(pattern: regex.Pattern, text: str, border: str, size: int = SLICE) -> np.ndarray:
    """Where each unit of ``text`` ends."""
    parts, start = [], 0
    while start < len(text) or not parts:
        stop = len(text)
        if stop - start > size:
            found = text.find(border, start + size)
            stop = stop if found < 0 else found + len(border)
        match = pattern.fullmatch(text, start, stop)
        if match is None:
            raise ValueError("the units do not cover the text")
        parts.append(np.array(match.ends(1), np.int64))
        start = stop
    return np.concatenate(parts)


def cuts(text: Column, first: Column, second: Column, unit: str, border: str) -> Column:
    """(n, prefix, upto): the number of units, and the code points before the first and before the second cut."""

    @F.pandas_udf("n long, prefix long, upto long")
    def cut(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(f"({unit})*")
        rows = np.zeros((len(texts), 3), np.int64)
        for i, (t, x, y) in enumerate(zip(texts, a, b, strict=True)):
            ends = unit_ends(pattern, t, border)
            n = len(ends)
            lo, hi = sorted((x % (n + 1), y % (n + 1)))
            rows[i] = n, ends[lo - 1] if lo else 0, ends[hi - 1] if hi else 0
        return pd.DataFrame(rows, columns=["n", "prefix", "upto"])

    return cut(text, first, second)


def draws(id_: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50,
    unit: str = LINE, border: str = "\n",
) -> DataFrame:
    """``docs`` with ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``unit`` is a pattern whose repetitions cover any text and never run past ``border``.
    """
    text_, cut_, draws_ = free_names(docs, "text_", "cut_", "draws_")
    rows = docs.withColumns({text_: F.coalesce(col(text_col), F.lit("")), draws_: F.array(*draws(col(id_col), seed))})
    rows = rows.withColumn(cut_, cuts(F.col(text_), F.get(draws_, F.lit(0)), F.get(draws_, F.lit(1)), unit, border))
    text, at = F.col(text_), lambda f: F.col(f"{cut_}.{f}").cast("int")
    plain = (text == "") | (F.get(draws_, F.lit(2)) % 100 >= percent)
    for s in SENTINELS:
        plain = plain | F.contains(text, F.lit(s))
    form = F.when(plain, "plain").when(F.get(draws_, F.lit(3)) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    prefix = F.substring(text, F.lit(1), at("prefix"))
    middle = F.substring(text, at("prefix") + 1, at("upto") - at("prefix"))
    suffix = F.substring(text, at("upto") + 1, F.char_length(text))
    cutting = F.col("form") != "plain"
    return rows.withColumns({
        "n": F.col(f"{cut_}.n"),
        "prefix_chars": F.when(cutting, F.col(f"{cut_}.prefix")),
        "middle_chars": F.when(cutting, F.col(f"{cut_}.upto") - F.col(f"{cut_}.prefix")),
        "output": F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text),
    }).drop(text_, cut_, draws_)


def restored(output: Column, form: Column) -> Column:
    """The text from ``output`` and ``form`` alone. No part holds a sentinel, so the sentinels are where they were put."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
