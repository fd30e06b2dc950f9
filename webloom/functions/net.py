"""Private networks: is an address in one of a list of CIDR blocks?"""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bind import let

# Blocks that count as private.
PRIVATE = ("127.0.0.0/8", "::1/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "fe80::/10", "0.0.0.0/8", "255.255.255.255/32", "fc00::/7")

_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_BYTE}(\.{_BYTE}){{3}}$"
# An address without its zone, and the IPv4 address at its end.
_ZONED = r"^([^%/]*)(%[^%/]+)?\z"
_TAIL = rf":({_BYTE}(\.{_BYTE}){{3}})\z"
_GROUPS = r"^([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?\z"
# The first 24 of the 32 digits of an IPv4 address mapped to IPv6.
_MAPPED = "0" * 20 + "ffff"


def ipv4(address: Column) -> Column:
    """The number of a dotted IPv4 address, or null."""

    def number(a: Column) -> Column:
        parts = F.transform(F.split(a, r"\."), lambda x: x.cast("long"))
        return F.when(a.rlike(_V4), F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x))

    return let(address, number)


def ipv6(address: Column) -> Column:
    """The 32 lower-case hexadecimal digits of an IPv6 address, or null; a zone (``%eth0``) is left out."""

    def ended(x: Column) -> Column:
        tail = ipv4(F.nullif(F.regexp_extract(x, _TAIL, 1), F.lit("")))
        four = F.lpad(F.hex(tail), 8, "0")
        return F.coalesce(F.concat(F.regexp_replace(x, _TAIL, ":"), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4)), x)

    def digits(half: Column) -> Column:
        return F.array_join(F.transform(F.split(half, ":"), lambda g: F.when(g != "", F.lpad(g, 4, "0"))), "")

    def joined(halves: Column) -> Column:
        sides = F.transform(halves, digits)
        head, tail = F.element_at(sides, 1), F.when(F.size(sides) == 2, F.element_at(sides, 2)).otherwise("")
        left = 32 - F.length(head) - F.length(tail)
        # One :: stands for one group of zeros or more, none for none.
        return F.when((F.size(sides) == 2) & (left >= 4) | (F.size(sides) == 1) & (left == 0), F.lower(F.concat(head, F.repeat(F.lit("0"), left), tail)))

    def number(x: Column) -> Column:
        halves = F.split(let(x, ended), "::", -1)
        return let(halves, lambda h: F.when((F.size(h) <= 2) & F.forall(h, lambda half: half.rlike(_GROUPS)), let(h, joined)))

    return F.when(address.contains(":") & address.rlike(_ZONED), let(F.regexp_extract(address, _ZONED, 1), number))


def is_private(address: Column, blocks: Sequence[str] = PRIVATE) -> Column:
    """Whether a literal address is private; null for what is no address.  All in the JVM."""
    nets = [ipaddress.ip_network(b, strict=False) for b in blocks]
    four = [n for n in nets if n.version == 4]
    six = [n for n in nets if n.version == 6]

    def inside(number: Column) -> Column:
        found = F.lit(False)
        for n in four:
            found = found | number.between(int(n.network_address), int(n.broadcast_address))
        return F.when(number.isNotNull(), found)

    def inside6(digits: Column) -> Column:
        found = F.lit(False)
        for n in six:
            found = found | digits.between(*(f"{int(a):032x}" for a in (n.network_address, n.broadcast_address)))
        mapped = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
        return F.when(digits.startswith(_MAPPED), let(mapped, inside)).when(digits.isNotNull(), found)

    return F.coalesce(let(ipv4(address), inside), let(ipv6(address), inside6))


def resolve_hosts(df: DataFrame, host: str, resolver: DataFrame | None, out: str = "private", blocks: Sequence[str] = PRIVATE) -> DataFrame:
    """Adds ``out``: whether ``host`` is private, by itself or by any of its addresses in ``resolver`` (host, ip).

    Null for hosts that are no address and that the resolver doesn't know.
    """
    own = is_private(F.col(host), blocks)
    if resolver is None:
        return df.withColumn(out, own)
    known = resolver.select(F.col("host").alias("__host"), is_private(F.col("ip"), blocks).alias("__p")).groupBy("__host").agg(F.bool_or("__p").alias("__p"))
    return df.join(known, F.col(host) == F.col("__host"), "left").withColumn(out, F.coalesce(own, F.col("__p"))).drop("__host", "__p")
