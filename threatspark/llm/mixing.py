"""Mixing sources to target weights.

Words are added up per source. Sources in the order of their names (null last) take turns at the given weights, and share
a given multiple of all words. A target stops at ``most`` times its source's words; what is over is shared again by weight
until no source is above. The repetition rate of a source is its target over its words: each of its documents is emitted
floor(rate) times, and once more with the probability of the fraction, drawn from a hash of the document and a seed.

Targets have the form min(most * words, weight * level). The level is found in rounds, each one aggregate over the table
of sources, so the number of sources is free: none of them is sorted or summed up in one task. Documents meet their source
in a join that the optimizer broadcasts if the table of sources is small, and splits at a hot source if it isn't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark.llm.common import settled

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 0
_WORD = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _draw(id_: Column, text: Column, seed: int) -> Column:
    """A number from 0 to below 1 out of 52 bits of a digest of seed, id and text: the same on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _numbered(sources: DataFrame) -> DataFrame:
    """The sources with ``at``, their place by code point from 0, null last: a distributed sort and one count a partition."""
    rows = settled(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), "sources")
    part = F.shiftrightunsigned("id", 33)
    counts = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    ahead, before = 0, []
    for p, n in counts:  # one pair for each partition of the sort
        before += [F.lit(p), F.lit(ahead).cast("long")]
        ahead += n
    place = F.create_map(*before)[part] if before else F.lit(0)
    return rows.select("source", "source_size", (place + F.col("id").bitwiseAND((1 << 33) - 1)).alias("at"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target for a table of distinct ``source`` with their ``source_size`` in words.

    Targets add up to ``share`` times all words, or to ``most`` times, if that is less. A source without words has the
    target 0. An empty table gives no rows.
    """
    if not weights or min(weights) <= 0 or share < 0 or most <= 0:
        raise ValueError("weights and most must be above 0, share not below")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    rows = settled(
        _numbered(sizes).select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "targets")
    words, open_ = rows.agg(F.sum("source_size"), F.sum("w")).first()
    total, capped, level = share * (words or 0), -1, 0.0
    if words:
        level = total / open_
        while True:
            over = F.col("w") * F.lit(level) >= F.col("cap")
            n, full, open_ = rows.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w")))).first()
            if n == capped or open_ is None:
                level = level if open_ is not None else float("inf")
                break
            capped, level = n, (total - (full or 0.0)) / open_
    return rows.select("source", "source_size", F.least(F.col("w") * F.lit(level), F.col("cap")).alias("target"))


def _planned(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float, seed: int, keep: Sequence[str],
) -> DataFrame:
    """The columns ``keep`` of the documents as c0, c1, ..., then doc_id, size, source_size, target and copies."""
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("own"),
        _size(F.col(text_col)).alias("size"), _draw(F.col(id_col), F.col(text_col), seed).alias("draw"))
    sizes = rows.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = settled(source_targets(sizes, weights, share, most), "mix")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.join(targets, F.col("own").eqNullSafe(F.col("source"))).withColumn("rate", rate)
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select(*[f"c{k}" for k in range(len(keep))], "doc_id", "size", "source_size", "target", copies.alias("copies"))


def copies_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (both of its source), copies.

    Words are runs of other characters than blank and 0x09 to 0x0D. A null text has none. Documents without a source are
    one source, the last. Rows that repeat id and text are drawn alike, each gets its row; documents without words are
    drawn, too. A null id counts as empty in the draw. An empty table gives no rows; other columns are not read.
    """
    return _planned(docs, id_col, text_col, source_col, weights, share, most, seed, [])


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """The mixture itself: every row of ``docs`` with all its columns as often as :func:`copies_of` says, possibly never."""
    planned = _planned(docs, id_col, text_col, source_col, weights, share, most, seed, docs.columns).where("copies > 0")
    emitted = planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return emitted.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)
