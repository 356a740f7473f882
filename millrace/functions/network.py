"""IPv4 addresses, address ranges and compact records."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reserved ranges
RESERVED = """
0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.0/29 192.0.0.8/32
192.0.0.9/32 192.0.0.10/32 192.0.0.170/32 192.0.0.171/32 192.0.2.0/24 192.31.196.0/24 192.52.193.0/24 192.88.99.0/24
192.168.0.0/16 192.175.48.0/24 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 255.255.255.255/32
""".split()


def range_of(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def ip_number(c: Column) -> Column:
    """Number of a dotted quad; null unless all four parts are 0-255."""
    part = F.split(c, r"\.")
    value = sum((F.try_element_at(part, F.lit(k + 1)).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0).cast("bigint"))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.when(c.rlike(rf"^{octet}(\.{octet}){{3}}$"), value)


def endpoint_number(ip: Column, port: Column) -> Column:
    """One number for address and port: the port has all of its 16 bits."""
    return F.shiftleft(ip.cast("bigint"), 16).bitwiseOR(port.cast("bigint"))


def is_public(ip: Column) -> Column:
    """Whether an address lies outside all reserved ranges: a constant predicate, so it can be pushed to the scan."""
    spans = sorted(map(range_of, RESERVED))
    joined: list[tuple[int, int]] = []
    for a, b in spans:
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    inside = F.lit(False)
    for a, b in joined:
        inside = inside | ip.between(a, b)
    return ~inside


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a range column."""
    width = F.pow(F.lit(2.0), 32 - F.split(cidr, "/")[1].cast("int")).cast("bigint")
    ip = ip_number(F.split(cidr, "/")[0])
    start = ip - F.pmod(ip, width)
    return start, start + width - 1


def _records(c: Column, size: int, of) -> Column:
    count = (F.length(c) - F.pmod(F.length(c), F.lit(size))) / size
    return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: of(F.substring(c, i * size + 1, F.lit(size))))).otherwise(F.array())


def _number(c: Column, start: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(c, start, length)), 16, 10).cast("bigint")


def compact_peers(c: Column) -> Column:
    """Array of (ip, port) from records of six bytes."""
    return _records(c, 6, lambda r: F.struct(_number(r, 1, 4).alias("ip"), _number(r, 5, 2).cast("int").alias("port")))


def compact_nodes(c: Column) -> Column:
    """Distinct (node_id, ip, port) from records of 26 bytes."""
    return F.array_distinct(_records(c, 26, lambda r: F.struct(F.substring(r, 1, 20).alias("node_id"), _number(r, 21, 4).alias("ip"), _number(r, 25, 2).cast("int").alias("port"))))


def to_compact(ip: Column, port: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(ip.cast("bigint")), 8, "0"), F.lpad(F.hex(port.cast("bigint")), 4, "0")))
