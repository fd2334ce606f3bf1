"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are reduced to lower-case letters with one space for each other character. ``fit`` counts n-grams of 1 to
``max_n`` characters per language over all given rows, in Spark; the matrix of log probabilities (buckets x languages,
so its size is fixed by the parameters and by ``max_languages``) is broadcast, and ``predict`` adds up, for each text,
the columns of the n-grams that it has, in numpy, a batch of whole texts at a time.

``predict`` gives per row the id, ``lang_pred`` and ``score``, the posterior of that language. A text that is null or
has no letter is ``und`` with score 0, and so is every text if nothing was learned. Rows without a language or text
teach nothing. Equal posteriors go to the language that sorts first. Repeated rows count each, other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import GOLDEN, col, mix, pieces, starts_of

UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str | None], bits: int, max_n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..max_n the buckets of all n-grams, and how many of them each text has."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    counts = np.array([len(p) for p in points], np.int64)
    x = letters()[np.concatenate([*points, np.zeros(0, np.uint32)])].astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), counts)
    out, rolled = [], np.zeros(len(x), np.uint64)
    for n in range(1, max_n + 1):
        rolled = (rolled[: len(x) - n + 1] * GOLDEN + x[n - 1 :]) if len(x) >= n else np.zeros(0, np.uint64)
        inside = text[: len(rolled)] == text[n - 1 : n - 1 + len(rolled)]
        bucket = (mix(rolled[inside] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)
        out.append((bucket, np.maximum(counts - n + 1, 0)))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log probabilities
    prior: np.ndarray
    bits: int
    max_n: int


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 15, max_n: int = 3, smoothing: float = 0.5, max_languages: int = 500) -> Model:
    """Counts over all ``rows``; ``max_languages`` bounds the matrix and is checked, never cut to."""
    known = rows.select(col(lang_col).alias("lang"), col(text_col).alias("text")).where("lang is not null and text is not null")
    size = 1 << bits

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, 1):
                langs = part.column(0).to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                for buckets, counts in grams(part.column(1).to_pylist(), bits, max_n):
                    both = np.bincount(np.repeat(number, counts) * size + buckets, minlength=len(names) * size).reshape(-1, size)
                    for name, c in zip(names, both, strict=True):
                        total[name] = total.get(name, 0) + c
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    seen = [r.lang for r in known.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()]
    if len(seen) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    counts = np.zeros((size, max(1, len(seen))))
    summed = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # at most buckets x languages rows
    at = {name: i for i, name in enumerate(seen)}
    counts[table["bucket"].to_numpy(), [at[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    log = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * size)
    prior = np.log(np.array([sizes[x] for x in seen], float) / max(1, sum(sizes.values()))) if seen else np.zeros(1)
    return Model(seen, np.ascontiguousarray(log.T), prior, bits, max_n)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        m = shared.value
        for batch in batches:
            for part in pieces(batch, 1):
                texts = part.column(1).to_pylist()
                total = np.repeat(m.prior[None], len(texts), 0)
                lettered = np.zeros(len(texts), bool)
                for buckets, counts in grams(texts, m.bits, m.max_n):
                    some = counts > 0
                    if not some.any():
                        continue
                    at = starts_of(counts)[some]
                    for j in range(total.shape[1]):
                        total[some, j] += np.add.reduceat(m.table[j][buckets], at)
                for i, t in enumerate(texts):
                    lettered[i] = bool(t) and has_letter(t)
                p = np.exp(total - total.max(1, keepdims=True))
                best = total.argmax(1)
                value = p[np.arange(len(p)), best] / p.sum(1)
                ok = lettered & bool(m.languages)
                langs = [m.languages[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(np.where(ok, value, 0.0))], ["id", "lang_pred", "score"])

    out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(score, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
