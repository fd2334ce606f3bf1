"""Byte-level BPE: overlapping chunks, stitched where their pre-tokens resynchronise, and exact decoding.

``encode`` gives one row per input row: the id column, ``n_tokens`` and ``ids``, the token ids packed as little-endian
unsigned 32-bit integers (``unpack`` makes a numpy array of them). ``decode`` gives the raw bytes of packed ids.

A text of up to ``chunk`` characters is one piece. A longer one is cut into chunks that overlap by ``overlap`` characters;
all chunks of all texts are pre-tokenised side by side. A chunk's first cut is the first pre-token start, in the overlap with
the next chunk, that both have found: the pattern looks ahead only, so from there on both agree, and what precedes it is
right if the chunk's own start was. Where a text has no such place, the rest of it is one piece. Pieces are then encoded
each on its own and their ids put together in order.

Null and empty texts have no tokens. A null id, repeated rows and columns of any name are let through; each row counts.
Ids that the vocabulary lacks, or bytes that are no whole ids, decode to null.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import col, pieces

CHUNK = 1 << 15
OVERLAP = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def ranges(kind: str, most: int = 0x110000) -> str:
    """The characters of class ``kind`` below ``most`` as ranges, by the engine of tiktoken (other engines know another Unicode)."""
    probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, most))))
    runs: list[list[int]] = []
    for c in map(ord, bytes(probe.encode_ordinary(every)).decode()):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def spelled_out(pattern: str, most: int) -> str:
    """``pattern`` with its character classes (``\\p{L}``, ``\\s``, ``\\S`` ...) as ranges of characters below ``most``."""
    out, bracket, at = [], False, 0
    for m in re.finditer(r"\\[pP]\{\w+\}|\\[sS]|\\.|[\[\]]", pattern):
        out.append(pattern[at : m.start()])
        at, item = m.end(), m[0]
        if item in "[]":
            bracket = item == "["
        elif item[1] in "pPsS":
            inner = ranges(item.lower(), most)
            if bracket and item[1] in "PS":
                raise ValueError(f"{item} within brackets is not supported")
            item = inner if bracket else f"[{'^' * item[1].isupper()}{inner}]"
        out.append(item)
    return "".join([*out, pattern[at:]])


class Merges(dict):
    """Packed ids of pre-tokens; filled as they come, emptied when ``limit`` are kept.

    The pairs of one pre-token are merged by tiktoken, which gets each pre-token on its own.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 100_000):
        super().__init__()
        self.limit = limit
        self.ids = tiktoken.Encoding("pairs", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, token: str) -> bytes:
        ids = self.ids(token)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[token] = packed
        return packed


class Splitter:
    """Pre-tokens of a text; ``narrow`` is the pattern for texts without characters above U+FFFF (nearly all, and faster)."""

    def __init__(self, narrow: str, wide: str):
        self.narrow, self.wide = re.compile(narrow), regex.compile(wide)

    def __call__(self, text: str):
        return self.narrow if text.isascii() or max(text) <= "\uffff" else self.wide

    def starts(self, text: str, overlap: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
        """Starts of pre-tokens in the first and the last ``overlap`` characters at which the text can be cut.

        A place counts when a character that is no white space precedes it, so that what stands before it is parted
        alike without what follows, and when the text goes on far enough to be sure of the pre-token before it.
        """
        n, left, right = len(text), [], []
        for m in self(text).finditer(text):
            s, e = m.span()
            if e >= n or s + 3 > n:
                break
            if (e <= overlap or e >= n - overlap) and not text[e - 1].isspace():
                if e <= overlap and not first:
                    left.append(e)
                if e >= n - overlap and not last:
                    right.append(e)
        return left, right


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Row per row of ``docs``: the id, ``n_tokens`` and packed ``ids``. See the module text."""
    if not 3 < overlap < chunk:
        raise ValueError("overlap must be over 3 and under chunk")
    patterns = spelled_out(pattern, 0x10000), spelled_out(pattern, 0x110000)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(ranks)  # one vocabulary: its size is that of the given file
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def encode_rows(batches):
        split, merges = Splitter(*patterns), Merges(shared.value)
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1, 1_000_000):
                ids = [b"".join(map(merges.__getitem__, split(t).findall(t))) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], [*part.schema.names[:-1], "ids"])

    def find_starts(batches):
        split = Splitter(*patterns)
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("text", "chunk", "n_chunks")), strict=True)
            found = [split.starts(t, overlap, k == 0, k == n - 1) for t, k, n in rows]
            left, right = (pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, left, right], [*batch.schema.names, "starts_left", "starts_right"])

    short = texts.where(F.char_length("text") <= chunk).mapInArrow(encode_rows, f"id {id_type}, ids binary")

    long = texts.where(F.char_length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    copies = long.groupBy("id", "digest").count()
    n_chunks = F.ceil((F.char_length("text") - overlap) / F.lit(float(chunk))).cast("int")
    chunks = (
        long.withColumn("n_chunks", n_chunks)
        .select("id", "digest", "n_chunks", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"), "text")
        .withColumn("text", F.when(F.col("chunk") == F.col("n_chunks") - 1, F.expr(f"substring(text, chunk * {chunk} + 1)")).otherwise(F.expr(f"substring(text, chunk * {chunk} + 1, {chunk + overlap})")))
    )
    found = chunks.mapInArrow(find_starts, f"id {id_type}, digest string, n_chunks int, chunk int, text string, starts_left array<int>, starts_right array<int>")
    found = found.repartition("id", "digest").groupBy("id", "digest", "n_chunks", "chunk").agg(*(F.first(c).alias(c) for c in ("text", "starts_left", "starts_right")))
    order = Window.partitionBy("id", "digest").orderBy("chunk")
    shift = F.transform(F.lead("starts_left").over(order), lambda x: x + chunk)
    cut = F.array_min(F.array_intersect("starts_right", shift))
    stitched = (
        found.withColumn("cut", cut)
        .withColumn("sure", F.min(F.col("cut").isNotNull().cast("int")).over(order))
        .withColumn("cut", F.when(F.col("sure") == 1, F.col("cut")))
        .withColumn("begin", F.coalesce(F.lag("cut").over(order) - chunk, F.lit(0)))
        .withColumn("piece", F.count("cut").over(order) - F.col("cut").isNotNull().cast("int"))
        .withColumn("stop", F.when(F.col("chunk") == F.col("n_chunks") - 1, F.char_length("text")).otherwise(F.coalesce("cut", F.lit(chunk))))
        .withColumn("part", F.expr("substring(text, begin + 1, stop - begin)"))
    )
    whole = stitched.groupBy("id", "digest", "piece").agg(F.expr("listagg(part, '') within group (order by chunk)").alias("text"))
    encoded = whole.mapInArrow(encode_rows, f"id {id_type}, digest string, piece long, ids binary")
    joined = encoded.groupBy("id", "digest").agg(F.expr("listagg(ids, X'') within group (order by piece)").alias("ids"))
    same = joined["id"].eqNullSafe(copies["id"]) & (joined["digest"] == copies["digest"])
    rows = joined.join(copies, same).select(joined["id"], "ids", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy")).drop("copy")
    return short.unionByName(rows).select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its packed ids as ``out_col`` (null for null or broken ids)."""
    raw = {rank: token for token, rank in ranks.items()}
    shared = encoded.sparkSession.sparkContext.broadcast([raw.get(i) for i in range(max(raw, default=-1) + 1)])
    names = encoded.columns
    schema = encoded.drop(out_col).schema.add(out_col, "binary")

    def decode_rows(batches):
        token = shared.value

        def one(ids):
            try:
                return None if ids is None else b"".join(map(token.__getitem__, unpack(ids).tolist()))
            except (IndexError, TypeError, ValueError):
                return None

        for batch in batches:
            keep = [i for i, name in enumerate(names) if name != out_col]
            out = pa.array([one(x) for x in batch.column(names.index(ids_col)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), out], [*(names[i] for i in keep), out_col])

    return encoded.mapInArrow(decode_rows, schema)
