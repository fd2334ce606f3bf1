"""Quality classifier: nearest labelled neighbours in a latent-semantic space.

A text is the vector of its hashed byte trigrams: logarithms of counts, weighted by rarity, length one. ``fit`` takes
at most ``per_class`` labelled rows of each class (those whose ids have the smallest hashes), finds the leading singular
directions of their vectors and keeps their latent vectors. Directions and vectors are of a size fixed by the parameters
and are broadcast. ``score`` multiplies every text's latent vector with all of them in blocks, so the cosines are exact,
and the ``neighbours`` most alike vote for their label with the cosine to the power ``sharpness``.

``score`` gives per row the id and ``score`` in 0..1. Null, empty and very short texts (no trigram), and texts like no labelled
one, get the share of label 1 in the sample; with no labelled row every score is 0.5. Repeated labels of one id count
once, the larger. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import GOLDEN, col, mix, pieces

BUCKETS = 4096


def counts_of(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """Logarithms of the counts of each text's hashed byte trigrams."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array(list(map(len, raw)), np.int64)
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    text = np.repeat(np.arange(len(raw)), sizes)
    if len(x) < 3:
        return np.zeros((len(raw), buckets), np.float32)
    inside = text[:-2] == text[2:]
    gram = (x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:])[inside]
    bucket = (mix(gram * GOLDEN) % np.uint64(buckets)).astype(np.int64)
    return np.log1p(np.bincount(text[:-2][inside] * buckets + bucket, minlength=len(raw) * buckets).reshape(-1, buckets)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    rarity: np.ndarray
    directions: np.ndarray  # buckets x dimensions
    vectors: np.ndarray     # sample x dimensions
    labels: np.ndarray
    neighbours: int
    sharpness: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        prior = self.labels.mean() if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(texts), prior)
        near = unit(unit(counts_of(texts) * self.rarity) @ self.directions) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1).astype(float), 0) ** self.sharpness
        total = weight.sum(1)
        vote = (weight * self.labels[at]).sum(1)
        return np.clip(np.where(total > 1e-12, vote / np.maximum(total, 1e-12), prior), 0, 1)


def fit(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = 750, dimensions: int = 64, neighbours: int = 25, sharpness: float = 4.0,
) -> Model:
    """Learn from ``labelled`` (id, 0/1 label); at most ``per_class`` rows of either class are taken."""
    one = labelled.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    one = one.groupBy("id").agg(F.max("label").alias("label"))
    picks = [one.where(f"label = {y}").orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sample = picks[0].unionByName(picks[1])

    def vectors(batches):
        for batch in batches:
            for part in pieces(batch, 2, 1_000_000):
                for at in range(0, part.num_rows, 256):
                    few = part.slice(at, 256)
                    rows = [v.tobytes() for v in counts_of(few.column(2).to_pylist())]
                    yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(rows, pa.binary())], ["id", "label", "v"])

    kind = one.schema["id"].dataType.simpleString()
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    made = texts.join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(vectors, f"id {kind}, label int, v binary")
    rows = made.groupBy("id").agg(F.max("label").alias("label"), F.min("v").alias("v")).orderBy("id").collect()  # 2 x per_class at most
    x = np.array([np.frombuffer(bytes(r.v), np.float32) for r in rows]).reshape(len(rows), BUCKETS)
    labels = np.array([r.label for r in rows], float)
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(1)
    x = unit(x * rarity)
    values, left = np.linalg.eigh((x @ x.T).astype(float)) if len(x) else (np.zeros(0), np.zeros((0, 0)))
    keep = np.argsort(-values)[:dimensions]
    keep = keep[values[keep] > 1e-6]
    directions = (x.T @ (left[:, keep] / np.sqrt(values[keep]))).astype(np.float32)
    return Model(rarity, directions, unit(x @ directions), labels, neighbours, sharpness)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            for part in pieces(batch, 1, 1_000_000):
                for at in range(0, part.num_rows, 256):
                    few = part.slice(at, 256)
                    values = shared.value.scores(few.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([few.column(0), pa.array(values.astype(float))], ["id", "score"])

    out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(scored, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)
