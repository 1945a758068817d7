"""Scans over landed capture tables: DNS packets, TLS handshakes, flow packets and raw payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.hosts import strip


def query_type_name(qtype: Column) -> Column:
    """Text name of a DNS type code, ``TYPE_n`` for the others."""
    names = F.create_map(*[F.lit(x) for pair in L.QUERY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, qtype), F.concat(F.lit("TYPE_"), qtype.cast("string")))


def dns_queries_scan(packets: DataFrame) -> DataFrame:
    """DNS queries (not responses) with the name's trailing dots cut and the type named."""
    return (
        packets.filter(F.col("qr") == 0)
        .withColumn("query_domain", F.rtrim(F.col("query_domain"), F.lit(".")))
        .withColumn("query_type", query_type_name(F.col("qtype")))
        .drop("qr", "qtype")
    )


def tls_handshakes_scan(handshakes: DataFrame) -> DataFrame:
    """Rows with a server name or a TLS port."""
    return handshakes.filter(F.col("sni").isNotNull() | F.col("dst_port").isin(*L.HTTPS_PORTS))


def flow_packets_scan(packets: DataFrame) -> DataFrame:
    """Protocol name and ports by transport layer; ports are 0 where the layer has none."""
    layered = F.col("protocol").isin("TCP", "UDP")
    named = F.col("protocol").isin("TCP", "UDP", "ICMP")

    def port(name: str) -> Column:
        return F.when(layered, F.coalesce(F.col(name), F.lit(0))).otherwise(F.lit(0))

    return packets.withColumns({
        "protocol": F.when(named, F.col("protocol")).otherwise("Unknown"),
        "src_port": port("src_port"),
        "dst_port": port("dst_port"),
    })


def hello_server_name(payload: Column) -> Column:
    """Server name of a TLS ClientHello payload, NULL when the payload is no ClientHello or names none.

    The name is looked for at the first offset from 43 whose two bytes are zero and whose announced name fits. The gaps
    between zero pairs, found in one scan and disjoint, add up to their offsets. An announced length has two bytes, so
    any pair more than 64 KB before the end fits: only the last 64 KB are ever gone through pair by pair.
    """
    size = F.octet_length(payload)

    def announced(offset: Column) -> Column:
        return F.conv(F.hex(F.substring(payload, offset + 8, F.lit(2))), 16, 10).cast("int")

    def fits(offset: Column) -> Column:
        return (offset + 10 <= size) & (offset + 9 + announced(offset) <= size)

    def named(offset: Column) -> Column:
        raw = F.substring(payload, offset + 10, announced(offset))
        return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))

    # offsets count from 0, positions in strings from 1; one character stands for one byte
    body = F.decode(F.substring(payload, F.lit(44), size), "ISO-8859-1")
    opening = F.instr(body, "\x00\x00") + 42
    rest = F.decode(F.substring(payload, opening + 1, size), "ISO-8859-1")
    gaps = F.regexp_extract_all(rest, F.lit(r"(?s)(.*?)\x00(?=\x00)"), F.lit(1))
    start = F.struct((opening - 1).alias("at"), F.lit(None).cast("int").alias("found"))

    def step(state: Column, gap: Column) -> Column:
        at = state["at"] + 1 + F.length(gap)
        return F.struct(at.alias("at"), F.when(state["found"].isNull() & fits(at), at).otherwise(state["found"]).alias("found"))

    walked = F.aggregate(gaps, start, step, lambda state: state["found"])
    # the first pair nearly always fits; only otherwise the rest is decoded and walked
    offset = F.when(opening < 43, F.lit(None)).when((size - opening > 65_553) | fits(opening), opening).otherwise(walked)
    hello = F.substring(payload, 6, 1) == F.lit(b"\x01")
    return F.when(hello, named(offset))


def sni_inventory(payloads: DataFrame, payload: str = "payload", ts: str = "ts") -> DataFrame:
    """Server names seen in raw payloads with count and first and last sight."""
    names = F.array_compact(F.array(hello_server_name(F.col(payload))))
    return (
        payloads.select(F.explode(names).alias("sni"), F.col(ts).alias("ts"))
        .groupBy("sni")
        .agg(F.count(F.lit(1)).alias("handshakes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    )


def http_host_inventory(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Distinct values of the first ``Host:`` header in plain-text payloads."""
    text = F.make_valid_utf8(F.col(payload).cast("string"))
    return (
        payloads.select(strip(F.regexp_extract(text, "(?s)Host: ([^\r]*)\r\n", 1)).alias("host"))
        .filter(F.col("host") != "")
        .distinct()
    )
