"""Quality rules: counts that a text must meet, and a log-likelihood ratio of hashed n-grams against trusted texts.

``rules`` adds to its input ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
``base_failed``, ``llr`` and ``kept``. Tokens of the ratio are runs of letters, digits and ``_``, and runs of other
signs; each token, and each pair of neighbours, falls into one of ``BUCKETS``. Two multinomials over the buckets, one of
all documents and one of trusted documents, give each bucket a log ratio; ``llr`` is the mean over a document's n-grams.
A document is kept if it has not failed the base rules and ``llr >= threshold``, whatever the other documents are.

``model`` counts all documents; of the trusted ids it takes at most ``max_trusted``, those with the smallest hashes (that
table is broadcast). Without trusted documents all ratios are 0. The model is one row with an array of ``BUCKETS`` numbers,
read through a scalar subquery. Null and empty texts have counts 0, ``llr`` 0 and fail the base rules. Repeated rows count
each; other columns stay, except those named as above, which are replaced. All work is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import SPACES, col, free_names

BUCKETS = 1 << 16
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WHITE = " \t\n\x0b\x0c\r"
THRESHOLD = -0.5
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def window_keys(words: Column, bits: Column) -> Column:
    """Sorted keys of the 3-word windows: the low bits are the place, as many as places need, the others are of a hash."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def keys(h: Column) -> Column:
        key = lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), bits).bitwiseOR(i.cast("long"))
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), key)

    return F.sort_array(bound(hashes, keys))


def place_bits(words: Column) -> Column:
    return F.ceil(F.log2(F.size(words) + 1.0)).cast("int")


def shared_places(keys: Column, bits: Column) -> Column:
    """Places of the windows whose hash is that of another one."""
    other = lambda k, x: F.coalesce(F.call_function("shiftright", F.get(keys, k), bits) == F.call_function("shiftright", x, bits), F.lit(False))
    shared = F.filter(keys, lambda x, k: other(k - 1, x) | other(k + 1, x))
    return F.transform(shared, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int"))


def repeated_words(places: Column, words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Only windows that share a hash become strings; these decide."""
    texts = F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")))

    def covered(ordered: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(ordered, k)["g"] == x["g"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
        return bound(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))

    return F.when(F.size(places) > 0, bound(F.sort_array(texts), covered)).otherwise(0).cast("long")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    own = docs.drop(*ADDED)
    words_, bits_, keys_, places_ = free_names(own, "words_", "bits_", "keys_", "places_")
    words, bits = F.col(words_), F.col(bits_)
    placed = own.withColumn(words_, words_of(text)).withColumn(bits_, place_bits(words)).withColumn(keys_, window_keys(words, bits))
    counted = placed.withColumn(places_, shared_places(F.col(keys_), bits)).withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.concat_ws("", words)).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col(places_), words),
    })
    return counted.drop(words_, bits_, keys_, places_).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def features(tokens: Column) -> Column:
    pairs = F.transform(tokens, lambda t, i: bucket(t, F.coalesce(F.get(tokens, i + 1), F.lit(""))))
    return F.concat(F.transform(tokens, lambda t: bucket(t)), pairs)


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))


def model(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = 20_000, smoothing: float = 1.0) -> DataFrame:
    """One row: ``ratios``, the log ratio of each bucket."""
    ids = trusted.select(col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_trusted).withColumn("trusted", F.lit(1))
    flagged = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(ids), "id", "left")
    counts = (
        flagged.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), tokens_of(F.col("text")).alias("tokens"))
        .select("trusted", F.explode_outer(features(F.col("tokens"))).alias("bucket"))
        .where("bucket is not null")  # explode() would put a filter on the array, worked out anew for each token, below it
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    )
    spark = docs.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    rows = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    ratio = lambda x: F.log((x["target"] + smoothing) / (F.col("target") + smoothing * BUCKETS)) - F.log((x["raw"] + smoothing) / (F.col("raw") + smoothing * BUCKETS))
    return rows.select(F.transform("c", lambda x: F.when(F.col("target") > 0, ratio(x)).otherwise(0.0)).alias("ratios"))


def mean_ratio(tokens: Column, ratios: Column) -> Column:
    """Mean of the ratios of all tokens and pairs, in one walk that carries the token before; the pair before the first is taken off."""
    ratio = lambda *x: F.get(ratios, bucket(*x))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("last"))
    walk = F.aggregate(
        tokens, start,
        lambda s, t: F.struct((s["sum"] + ratio(t) + ratio(s["last"], t)).alias("sum"), t.alias("last")),
        lambda s: s["sum"] + ratio(s["last"], F.lit("")) - ratio(F.lit(""), F.get(tokens, F.lit(0))),
    )
    return F.when(F.size(tokens) == 0, 0.0).otherwise(walk / (2.0 * F.size(tokens)))


def rules(docs: DataFrame, ratios: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns of ``ADDED``. Write the result before filtering it: a filter on ``kept`` would be pushed below
    the projections, where it works out words and tokens anew for every use of them."""
    tokens_, ratios_ = free_names(docs, "tokens_", "ratios_")
    based = base_rules(docs, text_col).withColumns({tokens_: tokens_of(col(text_col)), ratios_: ratios.scalar()})
    scored = based.withColumn("llr", mean_ratio(F.col(tokens_), F.col(ratios_))).drop(tokens_, ratios_)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
