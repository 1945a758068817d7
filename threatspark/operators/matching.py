"""Matching hosts against lists and feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.hosts import in_list, strip, suffixes


@dataclass(frozen=True)
class ListTables:
    """Block and allow list as tables with a column ``host``, of any size, in place of the literals of ``HostLists``."""

    block: DataFrame
    allow: DataFrame


def with_lists(df: DataFrame, host: str, lists: L.HostLists | ListTables, block: str, allow: str) -> DataFrame:
    """Add two flags: the host, in any case, or one of its parents is an entry of the block list, of the allow list.

    Entries of a table are matched once for each distinct host, by an equi-join on the host's suffixes; only suffixes with
    as many labels as some entry has go into the join. The optimizer broadcasts the entries if their size allows it.
    """
    if not isinstance(lists, ListTables):
        return df.withColumns({block: in_list(F.col(host), lists.block), allow: in_list(F.col(host), lists.allow)})
    name = strip(F.lower(F.coalesce(F.col(host), F.lit(""))))
    kinds = ((lists.block, True), (lists.allow, False))
    entries = None
    for table, blocked in kinds:
        part = table.select(strip(F.lower("host")).alias("_suffix"), F.lit(blocked).alias("_blocked"))
        entries = part if entries is None else entries.unionByName(part)
    entries = entries.filter(F.col("_suffix") != "").groupBy("_suffix").agg(F.bool_or("_blocked").alias("_b"), F.bool_or(~F.col("_blocked")).alias("_a"))
    sizes = F.coalesce(entries.agg(F.collect_set(F.size(F.split("_suffix", r"\.")))).scalar(), F.array().cast("array<int>"))  # 127 at most
    asked = df.select(name.alias("_name")).distinct()
    probes = asked.select("_name", F.explode(suffixes(F.col("_name"))).alias("_suffix")).filter(F.array_contains(sizes, F.size(F.split("_suffix", r"\."))))
    hits = probes.join(entries, "_suffix")
    hits = hits.groupBy("_name").agg(F.bool_or("_b").alias("_hit_b"), F.bool_or("_a").alias("_hit_a"))
    joined = df.withColumn("_host_name", name).join(hits, F.col("_host_name") == F.col("_name"), "left")
    return joined.select(*df.columns, F.coalesce("_hit_b", F.lit(False)).alias(block), F.coalesce("_hit_a", F.lit(False)).alias(allow))


def list_suffix_match(df: DataFrame, host: str, lists: L.HostLists | ListTables = L.HostLists()) -> DataFrame:
    """Add ``in_block_list`` and ``in_allow_list``: the host or one of its parents is an entry."""
    return with_lists(df, host, lists, "in_block_list", "in_allow_list")


def feed_rank(hosts: DataFrame, host: str, feeds: list[DataFrame], min_labels: int = 2) -> DataFrame:
    """For distinct hosts: the position (1 = first) of the first feed that lists the host or a parent of it.

    Feeds can be large, so this is an equi-join on the exploded suffixes and the size of the feeds decides the join
    type; only hosts with a hit come back. The TLD alone is never a suffix, which keeps ``com`` out of the shuffle.
    """
    listed = None
    for rank, feed in enumerate(feeds, start=1):
        ranked = feed.select(F.col("host").alias("_suffix"), F.lit(rank).alias("_rank"))
        listed = ranked if listed is None else listed.unionByName(ranked)
    listed = listed.groupBy("_suffix").agg(F.min("_rank").alias("_rank"))
    exploded = hosts.select(host, F.explode(suffixes(F.col(host), min_labels)).alias("_suffix"))
    return exploded.join(listed, "_suffix").groupBy(host).agg(F.min("_rank").alias("feed_rank"))


def feed_parent_match(df: DataFrame, host: str, feed: DataFrame, name: str = "in_feed") -> DataFrame:
    """Add a flag: the host itself, or a parent of at least two labels, is in the feed.

    Each distinct host is judged once; the rows then join the hosts that hit.
    """
    hit = feed_rank(df.select(host).distinct(), host, [feed])
    return df.join(hit, host, "left").withColumn(name, F.col("feed_rank").isNotNull()).drop("feed_rank")


def new_domains_only(df: DataFrame, judged: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose domain has not been judged safe or blocked yet (alerted domains are judged again)."""
    done = judged.filter((F.col("prediction") != "phishing") | F.col("blocked")).select(domain).distinct()
    return df.join(done, domain, "left_anti")


def brand_domains(df: DataFrame, host: str, brands: tuple[str, ...], extra: tuple[str, ...]) -> DataFrame:
    """Hosts that are a brand's own domain."""
    return df.filter(F.col(host).isin(*L.real_brand_domains(brands, extra))).select(host).distinct()
