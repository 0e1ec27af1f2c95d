"""Network addresses as Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|0*[0-9]{1,2})"
_V4 = rf"^(?i)\s*(?:::ffff:)?({_OCTET}(?:\.{_OCTET}){{3}})(?::[0-9]+)?\s*$"
# Scopes of addresses, the first net that holds the address wins.
SCOPES = (
    ("loopback", ("127.0.0.0/8", "::1/128")),
    ("link-local", ("169.254.0.0/16", "fe80::/10")),
    ("multicast", ("224.0.0.0/4", "ff00::/8")),
    ("privado", ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")),
    ("reservado", ("0.0.0.0/8", "240.0.0.0/4", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32")),
)


def ipv4_number(c: Column) -> Column:
    """An IPv4 address (or v4-mapped IPv6, or with a port) as an integer; null for anything else."""
    octets = F.split(F.nullif(F.regexp_extract(c, _V4, 1), F.lit("")), r"\.")
    return F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))


def ipv6_hex(c: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null for anything else."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"^\[|\](?::[0-9]+)?$", ""), r"%.*$", ""))
    halves = F.split(bare, "::")
    left = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda x: x != "")
    right = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda x: x != "")
    gap = 8 - F.size(left) - F.size(right)
    packed = F.size(halves) == 2
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    good = bare.rlike(r"^[0-9a-f:]+$") & bare.contains(":") & (F.size(halves) <= 2) & F.when(packed, gap >= 1).otherwise(gap == 0)
    good = good & F.forall(F.concat(left, right), lambda g: F.length(g) <= 4)
    return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def in_net(c: Column, net: str) -> Column:
    return in_nets(c, [net])


def _spans(nets) -> dict[int, list[tuple]]:
    """First and last address of nets by version, as ipv4_number and ipv6_hex write them."""
    out: dict[int, list[tuple]] = {4: [], 6: []}
    for text in nets:
        n = ipaddress.ip_network(text.strip(), strict=False)
        lo, hi = int(n.network_address), int(n.broadcast_address)
        out[n.version].append((lo, hi) if n.version == 4 else (f"{lo:032x}", f"{hi:032x}"))
    return out


def _within(address: Column, spans: list[tuple]) -> Column:
    out = F.lit(False)
    for lo, hi in spans:
        out = out | address.between(lo, hi)
    return F.coalesce(out, F.lit(False))


def in_nets(c: Column, nets) -> Column:
    """Whether an address lies in one of the nets, v4 or v6; null addresses and other texts don't.

    The address is read once: it is bound as the element of an array, whatever the number of nets.
    """
    spans, out = _spans(nets), F.lit(False)
    for version, read in ((4, ipv4_number), (6, ipv6_hex)):
        if spans[version]:
            out = out | F.exists(F.array(read(c)), (lambda s: lambda a: _within(a, s))(spans[version]))
    return out


def is_net(text: str) -> bool:
    try:
        ipaddress.ip_network(text, strict=False)
        return "/" in text
    except ValueError:
        return False


def ip_scope(c: Column) -> Column:
    """privado, público, loopback, link-local, multicast or reservado; null for no address."""

    def scope(a: Column) -> Column:
        out = F.when(a["v4"].isNull() & a["v6"].isNull(), None)
        for name, nets in SCOPES:
            spans = _spans(nets)
            out = out.when(_within(a["v4"], spans[4]) | _within(a["v6"], spans[6]), name)
        return out.otherwise("público")

    return F.transform(F.array(F.struct(ipv4_number(c).alias("v4"), ipv6_hex(c).alias("v6"))), scope)[0]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 12742.0176 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
