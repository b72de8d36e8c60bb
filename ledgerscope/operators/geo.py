"""Offline location of IP addresses from a table of address ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.text import ipv4_number

# A range enters every block of this many leading bits that it touches, a lookup only its own block.
BLOCK_BITS = 16
BROADCAST_RANGES = 2_000_000


def locate(network: DataFrame, ranges: DataFrame) -> DataFrame:
    """Fills geo_country (and asn with it) of observations that have a source IP but no country.

    ``ranges`` is (start, end, country, asn) of non-overlapping IPv4 ranges as longs. Both sides meet on
    the address block, so the lookup is an equi-join; each distinct address is looked up once. An address
    outside every range keeps its nulls.
    """
    size = 1 << (32 - BLOCK_BITS)
    blocks = ranges.select(
        F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("block"),
        "start", "end", F.col("country").alias("found_country"), F.col("asn").alias("found_asn"),
    )
    if blocks.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        blocks = F.broadcast(blocks)
    open_ = F.coalesce("geo_country", F.lit("")) == ""
    ips = (
        network.where(open_ & F.col("src_ip").isNotNull()).select("src_ip").distinct()
        .withColumn("ip", ipv4_number(F.col("src_ip"))).where("ip is not null")
        .withColumn("block", F.floor(F.col("ip") / size))
    )
    found = ips.join(blocks, "block").where("ip between start and end").select("src_ip", "found_country", "found_asn")
    joined = network.join(found, "src_ip", "left")
    return joined.withColumns(
        {
            "geo_country": F.when(open_, F.coalesce("found_country", "geo_country")).otherwise(F.col("geo_country")),
            "asn": F.when(open_, F.coalesce("found_asn", "asn")).otherwise(F.col("asn")),
        }
    ).select(*network.columns)
