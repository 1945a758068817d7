"""Exact duplicates by deterministic block naming.

The normalised text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted and named by integers
in that order; then adjacent names of a document are paired, the distinct pairs are sorted and named, and so on until one
name is left. Two texts get the same (level, name) exactly if they are equal: a name stands for one block or one pair of
names, never for a hash.

Blocks travel through one shuffle, where equal ones are folded before they are sent. The sort key of a block is (XXH64,
block): hashes with one block, which is nearly all of them, are named and looked up by the hash alone; a hash shared by
different blocks is named by the blocks themselves, on a second path that carries their bytes. Pairs of names are sorted
and joined as they are. No step gathers a group: equal blocks, pairs and texts meet in counts and minima that are combined
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark.llm.common import BLANKS, own_names, settled

BLOCK_BYTES = 8192


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_chars (code points of the text as given), norm (UTF-8 without white space), sha of norm."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, BLANKS, "").cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"), norm.alias("norm"))
    return rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))


def _blocks(rows: DataFrame, block_bytes: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    """One row per block: row columns, n (blocks of the row), pos, block, h. An empty text is one empty block."""
    n = F.greatest(F.ceil(F.octet_length("norm") / block_bytes), F.lit(1)).cast("int")
    cut = rows.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    block = F.substring(F.col("norm"), F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    cut = cut.select("doc_id", "n_chars", "sha", "n", "pos", block.alias("block"))
    return cut.withColumn("h", block_hash(F.col("block")).cast("long"))


def _numbered(distinct: DataFrame, *key: str) -> DataFrame:
    """Adds ``name``: integers in the order of the (distinct) key, from a distributed sort."""
    return distinct.orderBy(*key).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, n_chars, sha, n, pos, name, copies: the named blocks, repeated rows folded into ``copies``."""
    # equal blocks fold before the shuffle that brings them together; what leaves it is one number per hash
    hashes = settled(blocks.select("h", "block").distinct().groupBy("h").agg(F.count("*").alias("blocks")), "blocks")
    slim = blocks.groupBy("doc_id", "n_chars", "sha", "n", "pos", "h").agg(F.count("*").alias("copies"))
    names = _numbered(hashes.where("blocks = 1").select("h"), "h")
    clashing = hashes.where("blocks > 1").select("h")
    if clashing.isEmpty():
        return slim.join(names, "h").drop("h")
    named = slim.join(names, "h").drop("h")
    shared = blocks.join(clashing, "h")
    by_block = _numbered(shared.select("h", "block").distinct(), "h", "block").withColumn("name", -F.col("name") - 1)
    rest = shared.join(by_block, ["h", "block"]).groupBy("doc_id", "n_chars", "sha", "n", "pos", "name")
    return named.unionByName(rest.agg(F.count("*").alias("copies")))


def _identified(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, block_hash) -> DataFrame:
    """doc_id, n_chars, sha, copies, level, name: one identity for each text."""
    key = ["doc_id", "n_chars", "sha"]
    current = settled(_named_blocks(_blocks(_rows(docs, id_col, text_col), block_bytes, block_hash)), "names")
    done = [current.where("n = 1").select(*key, "copies", F.lit(0).alias("level"), "name")]
    current, level = current.where("n > 1"), 0
    longest = current.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = current.groupBy(*key, "n", F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            side(0).alias("a"), side(1).alias("b"), F.max("copies").alias("copies")
        )
        # the last name of an odd row has no partner; names are never this number
        pairs = pairs.withColumn("b", F.coalesce("b", F.lit(-(1 << 62))))
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        named = pairs.join(names, ["a", "b"])
        current = settled(
            named.select(*key, F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("at").alias("pos"), "name", "copies"),
            f"level{level}",
        )
        done.append(current.where("n = 1").select(*key, "copies", F.lit(level).alias("level"), "name"))
        current = current.where("n > 1")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deleting blank and 0x09 to 0x0D. Of equal texts the row with the most code
    points in the original text stays, then the smallest doc_id.

    Null text counts as empty; empty texts are one group. A null doc_id sorts last. Rows repeating doc_id and text each
    get a row and count in ``group_size``, only one of them can be kept. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    rows = _identified(docs, id_col, text_col, block_bytes, block_hash)
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    groups = rows.groupBy("level", "name").agg(
        F.sum("copies").alias("group_size"), F.min_by("doc_id", order).alias("keep_id"), F.max("n_chars").alias("most"),
    )
    # both sides of the join are plain exchanges, so that a name held by a third of the rows is split
    rows = rows.join(settled(groups, "groups"), ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most")) & (F.col("copy") == 1)
    return rows.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows repeating doc_id and text one stays."""
    stay = exact_duplicates(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("n_chars").alias("_chars"), F.col("text_sha256").alias("_sha"))
    plain, (own_id, own_text) = own_names(docs, id_col, text_col)
    text = F.coalesce(F.col(own_text), F.lit(""))
    keyed = plain.withColumns({
        "_id0": F.col(own_id), "_chars0": F.length(text).cast("long"),
        "_sha0": F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256),
    })
    joined = keyed.join(stay, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_chars0") == F.col("_chars")) & (F.col("_sha0") == F.col("_sha")))
    return joined.dropDuplicates(["_id", "_chars", "_sha"]).select(*plain.columns).toDF(*docs.columns)
