"""Device and provider inventory: vendor, rules, fingerprints, behaviour class, threat score."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import device_name, is_private, is_random_mac, oui_prefix
from .common import any_of, first_per_group, top_per_group
from .features import (
    BY, arp_claims, client_queries_per_ip, dns_timeline, dominant_mac, dst_ports_per_ip, ip_mdns_names, ip_ports,
    nxdomain_stats,
)


@dataclass(frozen=True)
class DeviceRule:
    """User-supplied rule; a condition left as None is not tested."""

    id: str
    priority: int
    classification: tuple[str, str, str, str]  # category, subcategory, vendor, model
    vendor_match: str | None = None
    mdns_regex: str | None = None
    ports_any: tuple[int, ...] | None = None
    dns_regex: str | None = None
    mac_is_random: bool = False


@dataclass(frozen=True)
class DnsFingerprint:
    id: str
    signature_domains: tuple[str, ...]
    classification: tuple[str, str, str, str]  # type, subtype, vendor, model
    match_threshold: int = 1
    confidence: str = "medium"


@dataclass(frozen=True)
class DeviceConfig:
    rules: Sequence[DeviceRule] = field(default_factory=tuple)
    fingerprints: Sequence[DnsFingerprint] = field(default_factory=tuple)


CLASS_COLUMNS = ("category", "subcategory", "vendor", "model", "rule_id", "confidence")


def vendor_lookup(macs: DataFrame, oui: DataFrame, mac: str = "mac") -> DataFrame:
    """Vendor of the MAC prefix, '' if unknown. ``oui`` holds prefix6 and vendor; Spark picks the join by size."""
    table = oui.select(F.upper("prefix6").alias("_prefix"), F.col("vendor").alias("vendor_oui"))
    return (macs.withColumn("_prefix", oui_prefix(F.col(mac))).join(table, "_prefix", "left").drop("_prefix")
            .withColumn("vendor_oui", F.coalesce("vendor_oui", F.lit(""))))


# ---- names inside addresses -------------------------------------------------------------------

def name_devices(ips: DataFrame, names: DataFrame, *, by=BY) -> DataFrame:
    """Multicast device name whose base is part of the address text; the last name in order wins.

    A base that is part of an address consists of address characters, so the test is an equality join on the
    distinct pieces of each address."""
    matched = _names_in(ips, names, "ip", by)
    return matched.groupBy(*by, "ip").agg(F.max("name").alias("name"))


#: The longest text of an address.
ADDRESS_LENGTH = 45


def _names_in(ips: DataFrame, names: DataFrame, column: str, by) -> DataFrame:
    """(name, address) where the base of the name is part of the address. An address is cut into the pieces of those lengths that the
    bases of its session have, of which there are few; the pieces meet the bases by equality."""
    base = F.lower(F.replace(F.col("qname"), F.lit(".local"), F.lit("")))
    bases = names.select(*by, F.col("qname").alias("name"), base.alias("part")).where(
        F.col("part").rlike("^[0-9a-f.:]+$") & (F.length("part") <= ADDRESS_LENGTH)).distinct()
    lengths = bases.groupBy(*by).agg(F.collect_set(F.length("part")).alias("_lengths"))
    text = F.lower(F.col(column))
    fitting = F.filter("_lengths", lambda n: n <= F.length(text))
    pieces = F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, n)))))
    parts = ips.select(*by, column).distinct().join(lengths, list(by)).select(*by, column, F.explode(pieces).alias("part"))
    return parts.join(bases, [*by, "part"])


def named_device_bytes(totals: DataFrame, names: DataFrame, *, by=BY) -> DataFrame:
    """Bytes of the sources whose address contains the base of a device name; 0 for the other devices."""
    hit = _names_in(totals, names, "ip", by).join(totals, [*by, "ip"]).groupBy(*by, "name").agg(F.sum("bytes").alias("bytes"))
    return names.select(*by, F.col("qname").alias("name")).distinct().join(hit, [*by, "name"], "left").withColumn(
        "bytes", F.coalesce("bytes", F.lit(0)))


# ---- classification ---------------------------------------------------------------------------

def _flags(long: DataFrame, keys, tests: dict[str, Column]) -> DataFrame | None:
    """One row per device with one boolean per test over its ports or names; combined before the shuffle."""
    if not tests:
        return None
    return long.groupBy(*keys).agg(*[F.bool_or(t).alias(n) for n, t in tests.items()])


def device_rule_match(devices: DataFrame, ports: DataFrame, mdns: DataFrame, queries: DataFrame,
                      rules: Sequence[DeviceRule], *, by=BY) -> DataFrame:
    """First rule, by falling priority, all of whose conditions hold. Adds the class columns, NULL without one.

    ``devices`` has ip and vendor_oui; ``ports`` (ip, port), ``mdns`` (ip, name) and ``queries`` (ip, qname) are
    the long tables. Rules are configuration: they become columns, so there is no join of devices and rules."""
    out = _with_rule(devices, ports, mdns, queries, rules, by)
    return out.select(*devices.columns, "_rule.*")


def _with_rule(devices: DataFrame, ports: DataFrame, mdns: DataFrame, queries: DataFrame, rules, by) -> DataFrame:
    """``devices`` with the class struct ``_rule``, NULL where no rule holds."""
    keys = [*by, "ip"]
    live = [r for r in sorted(rules, key=lambda r: -r.priority) if not r.mac_is_random]
    numbered = list(enumerate(live))
    tables = (
        _flags(ports, keys, {f"_p{i}": F.col("port").isin(*r.ports_any) for i, r in numbered if r.ports_any is not None}),
        _flags(mdns, keys, {f"_m{i}": F.lower("name").rlike(f"(?i){r.mdns_regex}") for i, r in numbered if r.mdns_regex}),
        _flags(queries, keys, {f"_q{i}": F.lower("qname").rlike(f"(?i){r.dns_regex}") for i, r in numbered if r.dns_regex}),
    )
    out = devices
    for t in tables:
        if t is not None:
            out = out.join(t, keys, "left")
    branch = None
    for i, r in numbered:
        test = F.lit(True)
        if r.vendor_match is not None:
            test = test & F.lower("vendor_oui").contains(r.vendor_match.lower())
        if r.ports_any is not None:
            test = test & F.coalesce(F.col(f"_p{i}"), F.lit(False))
        for prefix, rx in (("_m", r.mdns_regex), ("_q", r.dns_regex)):
            if rx:
                test = test & F.coalesce(F.col(f"{prefix}{i}"), F.lit(bool(re.search(rx, "", re.I))))
        level = "high" if r.priority >= 800 else "medium" if r.priority >= 500 else "low" if r.priority >= 200 else "very-low"
        found = _class(*r.classification, r.id, level)
        branch = F.when(test, found) if branch is None else branch.when(test, found)
    picked = branch if branch is not None else F.when(F.lit(False), _class(*[None] * 6))
    return out.withColumn("_rule", picked).select(*devices.columns, "_rule")


def _class(*values) -> Column:
    """Class struct; text values become literals, columns stay."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(n)
                      for n, v in zip(CLASS_COLUMNS, values)])


def dns_fingerprint_match(queries: DataFrame, fingerprints: Sequence[DnsFingerprint], *, by=BY) -> DataFrame:
    """Fingerprint with the most signature domains found among the names a device asked for.

    A signature is found as a substring, or as a pattern when it has pattern characters."""
    keys = [*by, "ip"]
    if not fingerprints:
        return queries.select(*keys).limit(0).select("*", *[F.lit(None).cast("string").alias(c) for c in CLASS_COLUMNS])
    name = F.lower("qname")
    tests = []
    for i, fp in enumerate(fingerprints):
        for j, sig in enumerate(fp.signature_domains):
            low = sig.lower()
            test = name.contains(low)
            if set(low) & set("[](){}*+?|\\^$"):
                try:
                    re.compile(low)
                    test = test | name.rlike(f"(?i){low}")
                except re.error:
                    pass
            tests.append(F.when(test, F.struct(F.lit(i).alias("fp"), F.lit(j).alias("sig"))))
    found = queries.select(*keys, F.inline(F.array_compact(F.array(*tests)))).distinct()
    sizes = found.groupBy(*keys, "fp").agg(F.count(F.lit(1)).alias("matched"))
    limit = F.element_at(F.array(*[F.lit(f.match_threshold) for f in fingerprints]), F.col("fp") + 1)
    best = first_per_group(sizes.where(F.col("matched") >= limit), keys, [F.desc("matched"), F.asc("fp")])
    of = lambda fn: F.element_at(F.array(*[F.lit(fn(f)) for f in fingerprints]), F.col("fp") + 1)
    return best.select(
        *keys, of(lambda f: f.classification[0]).alias("category"), of(lambda f: f.classification[1]).alias("subcategory"),
        of(lambda f: f.classification[2]).alias("vendor"),
        F.concat(of(lambda f: f.classification[3]), F.lit(" (DNS-matched, "), F.col("matched").cast("string"),
                 F.lit(" signals)")).alias("model"),
        F.concat(F.lit("dns-fp:"), of(lambda f: f.id)).alias("rule_id"), of(lambda f: f.confidence).alias("confidence"))


# Ports that give a device away.
WEB_PORTS = (80, 443, 8080, 8443)
BASIC_PORTS = (80, 443, 53, 5353, 67, 68, 123, 5060, 5061)
PORT_MARKS = {"rtsp": (554,), "printer": (9100, 631, 515), "voip": (5060, 5061, 2000), "cast": (8008, 8009, 8443),
              "iphone": (62078,), "ssdp": (1900,), "mqtt": (1883, 8883), "web": WEB_PORTS}


def port_marks(ports: DataFrame, *, by=BY) -> DataFrame:
    """Per device: which telling ports it used, whether it used only basic ones, and how many ports in all."""
    return ports.groupBy(*by, "ip").agg(
        *[F.bool_or(F.col("port").isin(*p)).alias(f"has_{n}") for n, p in PORT_MARKS.items()],
        F.bool_and(F.col("port").isin(*BASIC_PORTS)).alias("only_basic"), F.count("port").alias("n_ports"))


def behavioural_class(vendor: Column, random_mac: Column) -> Column:
    """Class struct from the port marks of the row; never unknown."""
    known = vendor != ""
    name = F.when(known, vendor).otherwise("Generic")
    mark = lambda n: F.coalesce(F.col(f"has_{n}"), F.lit(False))
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    web_only = mark("web") & F.coalesce(F.col("only_basic"), F.lit(True))
    return (
        F.when(mark("rtsp"), _class("Security & Cameras", "IP Camera", name, text(name, " IP camera (RTSP-detected)"), "behav-rtsp", "low"))
        .when(mark("printer"), _class("Office", "Printer", name, text(name, " network printer (port-detected)"), "behav-printer", "low"))
        .when(mark("voip"), _class("Office", "VoIP Phone", name, text(name, " VoIP phone (SIP-detected)"), "behav-voip", "low"))
        .when(mark("cast") & vendor.contains("Google"), _class("Entertainment", "Chromecast", "Google", "Chromecast (port-detected)", "behav-cast", "low"))
        .when(mark("iphone"), _class("Mobile", "iPhone", "Apple", "iPhone (port 62078 detected)", "behav-iphone", "medium"))
        .when(mark("ssdp"), _class("Smart Home", "UPnP Device", name, text(name, " UPnP/SSDP device"), "behav-ssdp", "low"))
        .when(mark("mqtt"), _class("Smart Home", "IoT Hub", name, "MQTT IoT device", "behav-mqtt", "medium"))
        .when(web_only & (random_mac | ~known), _class("Mobile", "Generic phone/laptop", name, "Web client (likely phone or laptop)", "behav-web-mobile", "very-low"))
        .when(web_only, _class("Computers", "Laptop", name, text(name, " computer (web traffic only)"), "behav-web-computer", "very-low"))
        .when(known, _class("Generic Endpoint", F.substring_index(vendor, ",", 1), vendor, text(vendor, " device (unspecified type)"), "behav-vendor-only", "very-low"))
        .otherwise(_class("Generic Endpoint", "Network Endpoint", "Generic", "Network endpoint (no signals available)", "behav-default", "very-low")))


# Vendors by kind of the short category table.
ROUTER_VENDORS = ("cisco", "meraki", "juniper", "aruba", "mikrotik", "netgear", "tp-link", "asus", "linksys", "d-link")
IOT_VENDORS = ("raspberry", "espressif", "arduino")


def light_device_category(vendor: Column, ports: Column, names: Column) -> Column:
    """Small ordered table: telling ports, then vendor, then words in the names."""
    v = F.lower(F.coalesce(vendor, F.lit("")))
    text = F.lower(F.coalesce(F.array_join(names, " "), F.lit("")))
    has = lambda col, *words: _any([col.contains(w) for w in words])
    return (F.when(any_of(ports, (62078, 5228)), "Mobile")
            .when(any_of(ports, (9100, 631, 515)), "Printer")
            .when(any_of(ports, (5060, 5061, 2000)), "VoIP Phone")
            .when(any_of(ports, (554,)), "Camera")
            .when(any_of(ports, (8008, 8009, 8443)) & v.contains("google"), "Streaming")
            .when(v.contains("apple"), F.when(has(text, "iphone", "ipad"), "Mobile").otherwise("Desktop"))
            .when(v.contains("samsung"), F.when(text.contains("galaxy"), "Mobile").otherwise("Consumer"))
            .when(v.contains("google") & text.contains("nest"), "IoT")
            .when(has(v, *ROUTER_VENDORS), "Router")
            .when(has(v, *IOT_VENDORS), "IoT")
            .when(v.contains("roku") | (v.contains("amazon") & text.contains("fire")), "Streaming")
            .when(v.contains("microsoft") | text.contains("xbox"), "Desktop")
            .when(v.contains("sony") & text.contains("playstation"), "Streaming")
            .when(has(text, "iphone", "ipad", "-mobile"), "Mobile")
            .when(has(text, "macbook", "-pc", "-laptop", "-desktop"), "Desktop")
            .when(has(text, "printer", "hp-", "canon-"), "Printer")
            .otherwise("unknown"))


def _any(tests) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def light_device_context(packets: DataFrame, oui: DataFrame, *, by=BY, names: int = 20, ports: int = 10) -> DataFrame:
    """Vendor, host name and category per source from its main MAC, top names and top ports."""
    keys = [*by, "ip"]
    asked = top_per_group(client_queries_per_ip(packets, by=by), keys, [F.desc("n"), F.asc("qname")], names)
    host = F.col("qname").endswith(".local") & ~F.col("qname").startswith("_")
    asked = asked.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "qname"))), lambda s: s["qname"]).alias("_names"),
        F.min_by(F.when(host, F.col("qname")), F.when(host, F.col("rank"))).alias("hostname"))
    used = top_per_group(dst_ports_per_ip(packets, by=by), keys, [F.desc("n"), F.asc("port_proto")], ports).groupBy(*keys).agg(
        F.collect_list(F.substring_index("port_proto", "/", 1).cast("int")).alias("_ports"))
    sources = packets.where(F.col("ip_src").isNotNull()).select(*by, F.col("ip_src").alias("ip")).distinct()
    macs = vendor_lookup(dominant_mac(packets, by=by).select(*keys, "mac"), oui)
    out = sources.join(macs, keys, "left").join(asked, keys, "left").join(used, keys, "left")
    vendor = F.nullif(F.col("vendor_oui"), F.lit(""))
    return out.select(*keys, light_device_category(vendor, F.col("_ports"), F.col("_names")).alias("category"), "hostname",
                      vendor.alias("oui_vendor"))


# ---- threat score -----------------------------------------------------------------------------

def threat_score(hosts: DataFrame) -> DataFrame:
    """Adds threat_score, threat_tier and threat_reasons from syn_count, unique_dsts, rst_count, n_ports,
    arp_conflict, n_long_queries and nxdomain (NULL counts as nothing seen)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    syn, dst, rst, ports = n("syn_count"), n("unique_dsts"), n("rst_count"), n("n_ports")
    arp, long, nx = F.coalesce(F.col("arp_conflict"), F.lit(False)), n("n_long_queries"), n("nxdomain")
    div = lambda c, k: F.floor(c / k)
    say = lambda c, tail, head="": F.concat(F.lit(head), c.cast("string"), F.lit(tail))
    point = lambda p, text: F.struct(p.cast("bigint").alias("points"), text.alias("reason"))
    signals = F.array_compact(F.array(
        F.when(syn >= 1000, point(F.lit(30), say(syn, " packets", "Severe SYN burst - ")))
        .when(syn >= 200, point(15 + F.least(F.lit(15), div(syn - 200, 50)), say(syn, " packets", "TCP SYN burst - ")))
        .when(syn >= 50, point(F.least(F.lit(10), div(syn, 20)), say(syn, " packets", "Elevated SYN count - "))),
        F.when(dst >= 200, point(F.lit(20), say(dst, " unique destinations - heavy port scan")))
        .when(dst >= 100, point(10 + div(dst - 100, 20), say(dst, " unique destinations - scan-like")))
        .when(dst >= 50, point(F.lit(5), say(dst, " unique destinations"))),
        F.when(rst >= 100, point(F.least(F.lit(10), div(rst, 30)), say(rst, " packets", "TCP RST flood - "))),
        F.when(ports >= 100, point(F.lit(10), say(ports, " distinct ports - likely port-scan footprint")))
        .when(ports >= 30, point(F.lit(5), say(ports, " distinct ports - broad port usage"))),
        F.when(arp, point(F.lit(25), F.lit("ARP IP↔MAC inconsistency - possible spoofing"))),
        F.when(long > 0, point(F.least(F.lit(15), long * 3), say(long, " long DNS queries from this IP (tunneling-like)"))),
        F.when(nx >= 50, point(F.least(F.lit(10), div(nx, 50)), say(nx, " NXDOMAIN responses to this IP"))),
    ))
    out = hosts.withColumn("_s", signals)
    many = F.size("_s") >= 3
    total = F.least(F.lit(100), F.aggregate("_s", F.lit(0).cast("bigint"), lambda a, s: a + s["points"])
                    + F.when(many, 10).otherwise(0))
    reasons = F.concat(F.transform("_s", lambda s: s["reason"]), F.when(many, F.array(
        say(F.size("_s"), " independent signals", "Compound risk - "))).otherwise(F.array().cast("array<string>")))
    out = out.withColumns({"threat_score": total, "_r": reasons}).drop("_s")
    score = F.col("threat_score")
    return out.withColumns({
        "threat_tier": F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW"),
        "threat_reasons": F.when(F.size("_r") > 0, F.array_join("_r", "; ")).otherwise("-")}).drop("_r")


def host_signals(packets: DataFrame, features: DataFrame, *, by=BY, long_limit: int = 60) -> DataFrame:
    """Inputs of the threat score, one row per source address."""
    keys = [*by, "ip"]
    sources = packets.where(F.col("ip_src").isNotNull()).groupBy(*by, F.col("ip_src").alias("ip")).agg(
        F.count(F.lit(1)).alias("packets"))
    conflict = arp_claims(packets, by=by).where("side = 'ip'").select(
        *by, F.col("key").alias("ip"), F.lit(True).alias("arp_conflict")).distinct()
    long = (dns_timeline(packets, by=by).where(F.length("qname") > long_limit).select(*keys, "qname").distinct()
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_long_queries")))
    return (sources.join(features.select(*keys, "syn_count", "rst_count", "unique_dsts"), keys, "left")
            .join(port_marks(ip_ports(packets, by=by), by=by), keys, "left").join(conflict, keys, "left")
            .join(long, keys, "left").join(nxdomain_stats(packets, by=by).where("ip is not null"), keys, "left"))


def rank_threats(inventory: DataFrame) -> DataFrame:
    tier = F.when(F.col("threat_tier") == "CRITICAL", 0).when(F.col("threat_tier") == "HIGH", 1).when(
        F.col("threat_tier") == "MEDIUM", 2).otherwise(3)
    return inventory.orderBy(tier, F.desc("threat_score"), F.desc("bytes"), F.asc("ip"))


def address_bytes(packets: DataFrame, *, by=BY) -> DataFrame:
    """Bytes sent and received by every address, from one scan."""
    ends = F.array(F.struct(F.col("ip_src").alias("ip"), F.col("len").alias("sent"), F.lit(0).cast("bigint").alias("got")),
                   F.struct(F.col("ip_dst").alias("ip"), F.lit(0).cast("bigint").alias("sent"), F.col("len").alias("got")))
    return packets.select(*by, F.inline(ends)).where(F.col("ip").isNotNull()).groupBy(*by, "ip").agg(
        F.sum("sent").alias("bytes_src"), F.sum("got").alias("bytes_dst"),
        (F.sum("sent") + F.sum("got")).alias("bytes"))


def local_inventory(packets: DataFrame, features: DataFrame, oui: DataFrame, config: DeviceConfig, *, by=BY) -> DataFrame:
    """Every private source with its class, name, traffic and threat score."""
    keys = [*by, "ip"]
    queries = dns_timeline(packets, by=by).select(*keys, "qname").distinct()
    mdns = ip_mdns_names(packets, by=by)
    hosts = host_signals(packets, features, by=by).where(is_private(F.col("ip")))
    macs = vendor_lookup(dominant_mac(packets, by=by).select(*keys, "mac"), oui)
    hosts = hosts.join(macs, keys, "left").join(address_bytes(packets, by=by).select(*keys, "bytes"), keys, "left")
    hosts = hosts.withColumns({"vendor_oui": F.coalesce("vendor_oui", F.lit("")), "mac": F.coalesce("mac", F.lit("")),
                               "mac_privacy_random": is_random_mac(F.col("mac"))})
    ruled = _with_rule(hosts, ip_ports(packets, by=by), mdns, queries, config.rules, by)
    prints = dns_fingerprint_match(queries, config.fingerprints, by=by).select(*keys, F.struct(*CLASS_COLUMNS).alias("_print"))
    own = behavioural_class(F.col("vendor_oui"), F.col("mac_privacy_random"))
    out = ruled.join(prints, keys, "left").withColumn("_class", F.coalesce("_rule", "_print", own))
    out = out.drop("_rule", "_print").select("*", "_class.*")
    usable = device_name(F.lit(""), F.array("name"), F.lit(None).cast("string"))
    named = mdns.withColumn("clean", usable).where(F.col("clean").isNotNull()).groupBy(*keys).agg(
        F.min_by("clean", "name").alias("_name"))
    out = threat_score(out.join(named, keys, "left"))
    fallback = device_name(F.col("ip"), F.array().cast("array<string>"), F.col("model"))
    return out.select(
        *keys, F.coalesce("_name", fallback).alias("device_name"), "mac", *CLASS_COLUMNS, "mac_privacy_random", "threat_score",
        "threat_tier", "threat_reasons", "packets", "bytes", F.coalesce("n_ports", F.lit(0)).alias("ports"), "vendor_oui",
        F.col("confidence").isin("high", "medium").alias("identified"))


def external_inventory(packets: DataFrame, providers, *, by=BY, hostnames: DataFrame | None = None) -> DataFrame:
    """Every address outside the private ranges with its traffic and provider."""
    ext = address_bytes(packets, by=by).select(*by, "ip", "bytes").where(~is_private(F.col("ip")))
    known = providers.classify(ext.select("ip"), hostnames)
    return ext.join(known, "ip").withColumn("identified", F.col("provider") != "Unknown")


def provider_bytes(external: DataFrame, column: str = "provider", *, by=BY) -> DataFrame:
    return external.groupBy(*by, column).agg(F.sum("bytes").alias("bytes"))


def coverage(local: DataFrame, external: DataFrame, *, by=BY) -> DataFrame:
    """How much of each side is identified, by addresses and by bytes."""
    both = local.select(*by, F.lit("local").alias("side"), "identified", "bytes").unionByName(
        external.select(*by, F.lit("external").alias("side"), "identified", "bytes"))
    pct = lambda a, b: F.when(b > 0, a / b * 100).otherwise(0.0)
    got = F.when(F.col("identified"), F.col("bytes")).otherwise(0)
    return both.groupBy(*by, "side").agg(
        F.count(F.lit(1)).alias("total_ips"), F.count_if(F.col("identified")).alias("identified_ips"),
        F.sum("bytes").alias("total_bytes"), F.sum(got).alias("identified_bytes")).withColumns({
            "pct_ips": pct(F.col("identified_ips"), F.col("total_ips")),
            "pct_bytes": pct(F.col("identified_bytes"), F.col("total_bytes"))})
