"""Provider lookup of addresses and host names from user-supplied tables."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ipv4_long

_INFO = ("provider", "service", "type")
_INFO_SCHEMA = "provider string, service string, type string"


def v6_network_keys(lengths: Sequence[int]):
    """Pandas UDF: the enclosing IPv6 networks of an address at the given prefix lengths, as text."""
    wanted = list(lengths)

    @F.pandas_udf("array<string>")
    def keys(ips: pd.Series) -> pd.Series:
        def one(ip):
            try:
                n = int(ipaddress.IPv6Address(ip))
            except ValueError:
                return []
            return [f"6/{p}/{n >> (128 - p):x}" for p in wanted]
        return ips.map(one)

    return keys


@dataclass(frozen=True)
class Providers:
    """``static``: (ip, provider, service, type); ``cidrs``: (cidr, provider, service, type) in match order;
    ``patterns``: (regex, provider, service, type) in match order."""

    static: Sequence[tuple] = ()
    cidrs: Sequence[tuple] = ()
    patterns: Sequence[tuple] = ()

    def by_ip(self, ips: DataFrame) -> DataFrame:
        """Rows of ``ips`` (column ip) that match, with provider, service, type and rule_id.

        Each network becomes an exact key (prefix length, network number) and each address offers one key per
        prefix length in use, so a range lookup is an equality join that needs no broadcast."""
        spark = ips.sparkSession
        rows, v4, v6 = [], set(), set()
        for i, (ip, *info) in enumerate(self.static):
            rows.append((f"ip/{ip}", -1, "static", *info))
        for i, (cidr, *info) in enumerate(self.cidrs):
            net = ipaddress.ip_network(cidr)
            p = net.prefixlen
            (v4 if net.version == 4 else v6).add(p)
            rows.append((f"{net.version}/{p}/{int(net.network_address) >> (net.max_prefixlen - p):x}", i, "cidr", *info))
        table = spark.createDataFrame(rows, f"key string, ord int, rule_id string, {_INFO_SCHEMA}")
        n = ipv4_long(F.col("ip"))
        keys = [F.array(F.concat(F.lit("ip/"), F.col("ip")))]
        if v4:
            shifted = [F.concat(F.lit(f"4/{p}/"), F.lower(F.hex(F.shiftright(n, 32 - p)))) for p in sorted(v4)]
            keys.append(F.when(n.isNotNull(), F.array(*shifted)).otherwise(F.array().cast("array<string>")))
        if v6:
            keys.append(v6_network_keys(sorted(v6))(F.col("ip")))
        offers = ips.select("ip").distinct().select("ip", F.explode(F.concat(*keys)).alias("key"))
        best = offers.join(table, "key").groupBy("ip").agg(
            F.min_by(F.struct(*_INFO, "rule_id"), "ord").alias("m"))
        return best.select("ip", "m.*")

    def by_host(self, hosts: DataFrame) -> DataFrame:
        """Rows of ``hosts`` (column host) that match a pattern, first pattern first. A projection, no join."""
        if not self.patterns:
            return hosts.select("host", *[F.lit(None).cast("string").alias(c) for c in _INFO]).where(F.lit(False))
        branch = None
        for i, (pattern, *_) in enumerate(self.patterns):
            test = F.col("host").rlike(pattern)
            branch = F.when(test, i) if branch is None else branch.when(test, i)
        pick = lambda j: F.element_at(F.array(*[F.lit(p[1 + j]) for p in self.patterns]), F.col("_m") + 1)
        return (hosts.select("host").distinct().withColumn("_m", branch).where(F.col("_m").isNotNull())
                .select("host", *[pick(j).alias(c) for j, c in enumerate(_INFO)]))

    def classify(self, ips: DataFrame, hostnames: DataFrame | None = None) -> DataFrame:
        """Provider of every address: static entry, first network, first host pattern, else Unknown.
        ``hostnames`` (ip, host) is an optional table of reverse names."""
        out = ips.select("ip").distinct().join(self.by_ip(ips), "ip", "left").withColumn("rdns", F.lit(""))
        if hostnames is not None:
            names = self.by_host(hostnames.select("host")).withColumnsRenamed({c: f"h_{c}" for c in _INFO})
            named = hostnames.join(names, "host", "left")
            out = out.drop("rdns").join(named, "ip", "left")
            open_ = F.col("rule_id").isNull() & F.col("host").isNotNull()
            out = out.withColumns({
                "rdns": F.when(open_, F.col("host")).otherwise(""),
                "service": F.when(open_, F.coalesce("h_service", "host")).otherwise(F.col("service")),
                "type": F.when(open_, F.col("h_type")).otherwise(F.col("type")),
                "provider": F.when(open_, F.col("h_provider")).otherwise(F.col("provider")),
                "rule_id": F.when(open_, F.when(F.col("h_provider").isNotNull(), "rdns").otherwise("rdns-only"))
                .otherwise(F.col("rule_id")),
            }).drop("host", *[f"h_{c}" for c in _INFO])
        return out.withColumns({
            "provider": F.coalesce("provider", F.lit("Unknown")), "service": F.coalesce("service", F.lit("")),
            "type": F.coalesce("type", F.lit("Unclassified")), "rule_id": F.coalesce("rule_id", F.lit("none"))})
