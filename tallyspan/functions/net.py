"""Client addresses behind trusted proxies."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def bucket_of(address: str | None) -> str | None:
    """The address as a rate-limit key: mapped v4 as v4, v6 by its /64; null if unreadable."""
    try:
        ip = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return str(ip) if ip.version == 4 else str(ipaddress.ip_network((ip, 64), strict=False))


def client_of(peer: str | None, forwarded: str | None, trusted: list[str]) -> str | None:
    """The first address from the right that isn't a trusted proxy; the peer if it isn't one itself."""
    nets = [ipaddress.ip_network(t) for t in trusted]

    def known(a: str) -> bool:
        try:
            ip = ipaddress.ip_address(a.strip())
        except ValueError:
            return False
        ip = ip.ipv4_mapped or ip if ip.version == 6 else ip
        return any(ip in n for n in nets if n.version == ip.version)

    if peer is None or not known(peer):
        return bucket_of(peer)
    for hop in reversed((forwarded or "").split(",")):
        if hop.strip() and not known(hop):
            return bucket_of(hop) or bucket_of(peer)
    return bucket_of(peer)


def client(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    @F.pandas_udf(StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([client_of(x, y, trusted) for x, y in zip(a, b, strict=True)], dtype="object")

    return run(peer, forwarded)
