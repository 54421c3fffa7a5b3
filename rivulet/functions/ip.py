"""IP addresses as text. IPv4 by arithmetic on the JVM; IPv6 ranges by the address written out in full."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.plans.errors import QueryError

V4 = r"^(?:::[fF]{4}:)?((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})$"


def to_long(ip: Column) -> Column:
    """The number of an IPv4 address, or one mapped into IPv6; null for other text."""
    plain = F.regexp_extract(ip, V4, 1)
    parts = F.split(plain, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("long")
    return F.when(plain != "", number)


def full_v6(ip: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address; null for other text."""
    low = F.lower(ip)
    halves = F.split(low, "::")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    a, b = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    gap = F.greatest(F.lit(8) - F.size(a) - F.size(b), F.lit(0))
    all_groups = F.when(F.size(halves) == 2, F.concat(a, F.array_repeat(F.lit("0"), gap), b)).otherwise(a)
    padded = F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(low.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(all_groups) == 8) & (F.char_length(padded) == 32), padded)


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether ip is in the network; false for other text, null for null."""
    try:
        net = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        raise QueryError(f"not a network: {cidr}") from None
    if net.version == 4:
        n = to_long(ip)
        hit = n.between(int(net.network_address), int(net.broadcast_address))
    else:
        n = full_v6(ip)
        hit = n.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
    return F.when(ip.isNotNull(), F.coalesce(hit, F.lit(False)))


#: Networks that are not public.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
RESERVED = ("127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4")


def _any(ip: Column, nets) -> Column:
    out = in_cidr(ip, nets[0])
    for n in nets[1:]:
        out = out | in_cidr(ip, n)
    return out


def is_private(ip: Column) -> Column:
    return F.coalesce(_any(ip, PRIVATE), F.lit(False))


def is_loopback(ip: Column) -> Column:
    return F.coalesce(in_cidr(ip, "127.0.0.0/8") | (ip == "::1"), F.lit(False))


def is_public(ip: Column) -> Column:
    return F.coalesce(to_long(ip).isNotNull() & ~_any(ip, PRIVATE + RESERVED), F.lit(False))


def from_long(n: Column) -> Column:
    n = n.cast("long")
    return F.when(n.between(0, 4294967295), F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))
