"""Importance resampling of documents towards a target set.

Two generative models of hashed word n-grams (1 and 2) are counted: one of the target texts, one of all texts. A document's
log importance is the sum over its n-grams of log(target) - log(raw); the k documents with the largest log importance plus
Gumbel noise are a sample of k without replacement in proportion to importance.

The target is a bounded sample of documents labelled good (``TARGET_DOCS``, by a hash of the id); counts of the raw model
cover every document. k is the number of documents with words times the share of good ones among the labelled with words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark.llm.common import WorkerCache, own_names, settled, ship_code

BUCKET_BITS = 16
TARGET_DOCS = 20_000
NOISE_SEED = 42
CACHED_WORDS = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: Any sign that str.split() doesn't take for white space; \s is ASCII only in Spark.
_WORD = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class _Tokens(WorkerCache):
    """Hashes of the tokens (runs of word characters, runs of other signs) of a word, as uint64 bytes."""

    def __missing__(self, word: str) -> bytes:
        tokens = (word,) if word.isalnum() else _TOKEN.findall(word)
        found = b"".join([xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass")) for t in tokens])
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_TOKENS = _Tokens()


def buckets_of(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """The hashed n-grams of a text, repeats included."""
    h = np.frombuffer(b"".join(map(_TOKENS.__getitem__, (text or "").split())), np.uint64)
    grams = np.concatenate([h, (h[:-1] * _M1 + h[1:]) ^ _M2])
    return ((grams * _M1) >> np.uint64(64 - bits)).astype(np.int64)


def _counts(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all texts and of those flagged as target; each task sends at most one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _TOKENS.begin()
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = buckets_of(text, bits)
                few = len(found) < 1 << (bits - 4)
                at, n = np.unique(found, return_counts=True) if few else (slice(None), np.bincount(found, minlength=1 << bits))
                raw[at] += n
                if good:
                    target[at] += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = docs.mapInArrow(count, "bucket long, raw long, target long")
    found = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # 2 ** bits rows at most
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[found.bucket], target[found.bucket] = found.raw, found.target
    return raw, target


def _has_words(text: Column) -> Column:
    return F.regexp_like(text.cast("string"), F.lit(_WORD))


class Importance:
    """The fitted ratio of the two models, and the share of good documents among the labelled with words."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, good: Column, bits: int, target_docs: int) -> None:
        ship_code(docs)
        self.text_col, self.bits, self.id_col = text_col, bits, id_col
        marked = labels.select(F.col("doc_id").cast("long").alias("_label"), good.alias("_good")).where("_label is not null and _good is not null")
        marked = marked.groupBy("_label").agg(F.max("_good").alias("_good"))
        there = docs.where(_has_words(F.col(text_col))).select(F.col(id_col).cast("long").alias("_label")).distinct().join(marked, "_label")
        n = there.groupBy("_good").count().collect()
        counts = {bool(r["_good"]): r["count"] for r in n}
        self.share = counts.get(True, 0) / sum(counts.values()) if counts.get(True) else None
        if self.share is None:
            return
        # the smallest hashes, of few more rows than are wanted: the same sample on every run
        place = F.pmod(F.xxhash64("_label", F.lit("target")), F.lit(1 << 30))
        part = min(1.0, 1.1 * target_docs / counts[True] + 1e-3)
        ids = marked.where(F.col("_good") & (place < part * (1 << 30))).orderBy(place, "_label").limit(target_docs)
        flagged = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(
            F.broadcast(ids.select("_label", F.lit(True).alias("_good"))), F.col("_id") == F.col("_label"), "left")  # target_docs rows at most
        raw, target = _counts(flagged.select("text", F.coalesce("_good", F.lit(False)).alias("good")), bits)
        ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
        self.ratio = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 ** bits numbers

    def score(self, text: Column) -> Column:
        """The log importance of a text; null without words."""
        ratio, bits = self.ratio, self.bits

        @F.pandas_udf("double")
        def log_ratio(texts: pd.Series) -> pd.Series:
            _TOKENS.begin()
            out = []
            for t in texts:
                found = buckets_of(t, bits)
                out.append(float(ratio.value[found].sum()) if len(found) else None)
            return pd.Series(out, dtype="float64")

        return F.round(F.nanvl(log_ratio(text), F.lit(None)), 6)


def _noise(id_col: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.round(-F.log(-F.log(u)), 6)


def threshold_of(scored: DataFrame, key: str, k: int, enough: int = 10_000, buckets: int = 4096) -> float | None:
    """The k-th largest value of ``key``, by counting in ever narrower buckets; only a few values reach the driver."""
    low, high, n = scored.agg(F.min(key), F.max(key), F.count(key)).first()
    if n == 0 or k <= 0:
        return None
    if k >= n:
        return low
    above, inside = 0, n  # rows over high; rows from low to high
    while inside > enough and low < high:
        step = (high - low) / buckets
        place = F.least(F.lit(buckets - 1), F.floor((F.col(key) - low) / step)).cast("int")
        here = scored.where(F.col(key).between(low, high)).groupBy(place.alias("place")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("place")).collect()
        for r in here:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high, inside = r["low"], r["high"], r["n"]
    if low == high:
        return low
    values = scored.where(F.col(key).between(low, high)).groupBy(key).count().orderBy(F.desc(key)).collect()
    for value, n in values:
        above += n
        if above >= k:
            return value
    return low


def importance_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: Column | None = None,
    bits: int = BUCKET_BITS, target_docs: int = TARGET_DOCS, seed: int = NOISE_SEED,
) -> DataFrame:
    """One row per document: doc_id, log_importance, perturbed (with noise), kept.

    ``good`` is the condition on ``labels`` (doc_id, ...) for the target, ``quality = 1`` by default; rows without an id or
    a verdict are passed over, of several verdicts a good one counts. Documents without words have null scores and are
    never kept, nor do they count for how many are. Noise depends on the id alone: rows repeating an id and its text share its decision, and ties at the
    threshold are all kept; null ids share one noise. Without good labels nothing can be learned and every document with
    words is kept. Empty tables give no rows; other columns are not read.
    """
    scored, threshold, _ = _decided(docs, labels, id_col, text_col, good, bits, target_docs, seed)
    kept = F.coalesce(F.col("perturbed") >= F.lit(threshold), F.lit(False))
    return scored.select("doc_id", "log_importance", "perturbed", kept.alias("kept"))


def _decided(docs, labels, id_col, text_col, good, bits, target_docs, seed):
    good = F.col("quality") == 1 if good is None else good
    model = Importance(docs, labels, id_col, text_col, good, bits, target_docs)
    rows = _scored(docs, model, id_col, text_col, seed).select(F.col(id_col).alias("doc_id"), "log_importance", "perturbed")
    scored = settled(rows, "importance")
    k = round(scored.agg(F.count("perturbed")).first()[0] * (1.0 if model.share is None else model.share))
    threshold = threshold_of(scored, "perturbed", k)
    return scored, threshold if threshold is not None else float("inf"), model


def _scored(docs: DataFrame, model: Importance, id_col: str, text_col: str, seed: int) -> DataFrame:
    if model.share is None:
        score = F.when(_has_words(F.col(text_col)), F.lit(0.0))
    else:
        score = model.score(F.col(text_col).cast("string"))
    rows = docs.withColumn("log_importance", score)
    return rows.withColumn("perturbed", F.col("log_importance") + _noise(F.col(id_col), seed))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of ``docs`` with all their columns. Texts are scored again in place of moving them through a join."""
    scored, threshold, model = _decided(docs, labels, id_col, text_col, None, BUCKET_BITS, TARGET_DOCS, NOISE_SEED)
    plain, own = own_names(docs, id_col, text_col)
    rows = _scored(plain, model, own[0], own[1], NOISE_SEED).where(F.col("perturbed") >= F.lit(threshold))
    return rows.select(*plain.columns).toDF(*docs.columns)
