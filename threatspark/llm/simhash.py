"""Near duplicates by SimHash and multi-index hashing.

A fingerprint of 64 bits is cut into as many segments as make (max_bits // segments) at most 1. By the pigeonhole
principle two fingerprints within ``max_bits`` agree in at least one segment up to one bit. Distinct fingerprints are put
into a table by (segment, value); each one probes the table with its own value and with every value that clears one of its
set bits. As one of two values that differ in one bit has that bit set, all pairs are met from one side. Whole distances
are verified in the join; the links run through connected components.

Copies fold into one fingerprint before anything is joined. Values held by very many fingerprints (a large group of near
copies) are linked by the points they have in common, which takes no pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatspark.llm.common import own_names, settled, ship_code
from threatspark.llm.graph import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Values of a segment held by more distinct fingerprints are linked without pairs: so many pairs are as many rows.
CROWD = 4096
_ROWS = 1 << 16


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - shingle_words + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, n, _ROWS):
        high = min(n, low + _ROWS)
        spans = zip(starts[low:high].tolist(), ends[low + shingle_words - 1 : high + shingle_words - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and a hash of the text that tells rows with one id apart."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_of(t, shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    text = F.col(text_col).cast("string")
    return ship_code(docs).select(F.col(id_col).alias("doc_id"), simhash(text).alias("fp"), F.xxhash64(text).alias("text_hash"))


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """u, v: links between distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits, that connect all such pairs.

    These are the pairs themselves, but for values of a segment held by more than ``crowd`` fingerprints: there
    :func:`_crowd_links` joins the same groups with a number of rows in proportion to the fingerprints.
    """
    segments = max(1, -(-(max_bits + 1) // 2))
    bounds = [64 * k // segments for k in range(segments + 1)]

    def value(k: int) -> str:
        width = bounds[k + 1] - bounds[k]
        mask = f" & {(1 << width) - 1}L" if width < 64 else ""
        return f"(shiftrightunsigned(fp, {bounds[k]}){mask})"

    own = ", ".join(f"struct({k} AS seg, {value(k)} AS val)" for k in range(segments))
    balls = ", ".join(
        f"transform(filter(sequence(-1, {bounds[k + 1] - bounds[k] - 1}), i -> i < 0 OR getbit({value(k)}, greatest(i, 0)) = 1), "
        f"i -> struct({k} AS seg, if(i < 0, {value(k)}, {value(k)} & ~shiftleft(1L, greatest(i, 0))) AS val, i < 0 AS exact))"
        for k in range(segments)
    )
    held = distinct.select(F.col("fp").alias("a"), F.expr(f"inline(array({own}))"))
    probes = distinct.select(F.col("fp").alias("b"), F.expr(f"inline(concat({balls}))"))
    near = F.expr(f"bit_count(a ^ b) <= {max_bits}") & (~F.col("exact") | (F.col("a") < F.col("b")))
    full = settled(held.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seg", "val"), "crowds")
    dense = None
    if not full.isEmpty():
        inside = held.select("seg", "val", F.col("a").alias("fp")).unionByName(probes.select("seg", "val", F.col("b").alias("fp")))
        dense = _crowd_links(inside.join(full, ["seg", "val"], "left_semi").select("fp").distinct(), max_bits)
        held = held.join(full, ["seg", "val"], "left_anti")
    # Spark sizes both sides as if each fingerprint were still one row, so it would broadcast millions of them
    pairs = held.join(probes.hint("merge"), (held.seg == probes.seg) & (held.val == probes.val) & near).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return pairs if dense is None else pairs.unionByName(dense)


def _crowd_links(fingerprints: DataFrame, max_bits: int) -> DataFrame:
    """Links that connect all fingerprints within ``max_bits``, without pairs.

    Every fingerprint names the points within half the distance of it; for an odd distance, the edges at these points. Two
    fingerprints share a name exactly if they are within the distance, so whoever shares one is linked to the smallest. A
    name is shared by a few hundred fingerprints at most (for three bits: two balls of 65), each has 4160 of them.
    """
    masks = [sum(1 << b for b in bits) for n in range(max_bits // 2 + 1) for bits in combinations(range(64), n)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    points = fingerprints.select("fp", F.explode(signed).alias("mask")).select("fp", F.expr("fp ^ mask").alias("point"))
    if max_bits % 2:
        points = points.select("fp", "point", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("edge")).select(
            "fp", F.expr("point & ~shiftleft(1L, edge)").alias("point"), "edge")
    names = [c for c in points.columns if c != "fp"]
    shared = points.groupBy(*names).agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return shared.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> DataFrame:
    """The rows of ``fingerprints`` with component_id, component_size and ``stays``."""
    rows = settled(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"))
    distinct = settled(rows.groupBy("fp").agg(F.min(order).alias("low"), F.count("*").alias("n")), "distinct")
    labels = components(near_links(distinct.select("fp"), max_bits))
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "low", "n", F.coalesce("label", "fp").alias("label"))
    lows = named.groupBy("label").agg(F.min("low").alias("first"), F.sum("n").alias("component_size"))
    # written, so that both sides of the last join are plain exchanges and a hot fingerprint is split
    found = settled(named.join(lows, "label").select(
        "fp", F.col("first.b").alias("component_id"), F.col("first.c").alias("first_text"), "component_size"), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("first_text"))
    return rows.join(found, "fp").withColumn("stays", stays)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), component_size.

    Null or blank texts have fingerprint zero and link like any other. Null ids never become a component_id unless the
    component has no other. Repeated rows each get a row. An empty table gives no rows; other columns are not read.
    """
    return _grouped(docs, id_col, text_col, shingle_words, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One document of each component with all its columns: that with the smallest id, then hash of its text.

    Rows that repeat id and text are one document and all stay with it. The rows that go are taken away by an anti join,
    as they are the fewer.
    """
    gone = _grouped(docs, id_col, text_col, shingle_words, max_bits).where(~F.col("stays"))
    gone = settled(gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct(), "near")
    plain, (own_id, own_text) = own_names(docs, id_col, text_col)
    keyed = plain.withColumns({"_own": F.col(own_id), "_own_text": F.xxhash64(F.col(own_text).cast("string"))})
    same = F.col("_own").eqNullSafe(F.col("_gone")) & (F.col("_own_text") == F.col("_gone_text"))
    return keyed.join(gone, same, "left_anti").select(*plain.columns).toDF(*docs.columns)
