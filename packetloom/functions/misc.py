"""TLS, radio, threat-intelligence, time and fingerprint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TLS version codes (RFC 8446), the weak ones, and weak cipher-suite codes.
TLS_VERSIONS = {"0x0300": "SSLv3", "0x0301": "TLS 1.0", "0x0302": "TLS 1.1", "0x0303": "TLS 1.2",
                "0x0304": "TLS 1.3"}
WEAK_TLS_LABELS = ("SSLv3", "TLS 1.0", "TLS 1.1")
WEAK_CIPHERS = ("0x0001", "0x0002", "0x0003", "0x0004", "0x0005", "0x0006", "0x0008", "0x0009", "0x000a")
# Reputation tags that count as hostile.
HOSTILE_TAGS = ("malware", "compromised", "botnet", "c2", "honeypot", "tor", "proxy", "vpn", "scanner",
                "self-signed")


def tls_version_label(code: Column) -> Column:
    branch = None
    for hex_code, label in TLS_VERSIONS.items():
        test = F.lower(code) == hex_code
        branch = F.when(test, label) if branch is None else branch.when(test, label)
    return branch.otherwise(code)


def weak_tls_version(code: Column) -> Column:
    return F.coalesce(tls_version_label(code).isin(*WEAK_TLS_LABELS), F.lit(False))


def weak_cipher(code: Column) -> Column:
    return F.coalesce(F.lower(code).isin(*WEAK_CIPHERS), F.lit(False))


def rssi_distance_m(rssi: Column, tx_dbm: float = 20.0, exponent: float = 2.5, loss_1m: float = 40.0) -> Column:
    """Log-distance path loss, never below 0.1 m; NULL stays NULL."""
    metres = F.pow(F.lit(10.0), (F.lit(tx_dbm - loss_1m) - rssi) / F.lit(10.0 * exponent))
    return F.when(rssi.isNotNull(), F.greatest(F.lit(0.1), metres))


def distance_bucket(metres: Column) -> Column:
    return (F.when(metres.isNull(), "Unknown")
            .when(metres < 2, "Same desk (< 2m)")
            .when(metres < 5, "Same room (2-5m)")
            .when(metres < 15, "Adjacent room (5-15m)")
            .otherwise("Far / different floor (> 15m)"))


def behaviour_tags(syn: Column, rst: Column, burst: Column, dominance: Column, anomaly: Column,
                   q95_burst: Column, q95_dominance: Column) -> Column:
    tags = F.concat_ws(
        ", ",
        F.when(syn > 100, "High SYN"),
        F.when(rst > 50, "High RST"),
        F.when(burst > q95_burst, "High Burst"),
        F.when(dominance > q95_dominance, "High Dominance"),
        F.when(anomaly, "ML-flagged"),
    )
    return F.when(tags == "", "Within normal range").otherwise(tags)


def content_hash(source: Column, text: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("|"), text), 256)


def canonical_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def verdict_cache_key(context_json: Column, prompt_version: Column, model: Column) -> Column:
    """Fingerprint of a canonical context text, the prompt version and the judging model."""
    return canonical_hash(context_json, prompt_version, model)


def _lowered(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)


def _size(values: Column) -> Column:
    return F.coalesce(F.array_size(values), F.lit(0))


def ti_score(vulns: Column, tags: Column, ports: Column, port_limit: int = 10) -> Column:
    hostile = F.arrays_overlap(_lowered(tags), F.array(*[F.lit(t) for t in HOSTILE_TAGS]))
    total = (F.least(_size(vulns) * 0.2, F.lit(0.6)) + F.when(hostile, 0.4).otherwise(0.0)
             + F.when(_size(ports) > port_limit, 0.15).otherwise(0.0))
    return F.round(F.least(total, F.lit(1.0)), 4)


def ti_reasons(vulns: Column, tags: Column, ports: Column, port_limit: int = 10) -> Column:
    hostile = F.sort_array(F.array_intersect(_lowered(tags), F.array(*[F.lit(t) for t in HOSTILE_TAGS])))
    return F.array_compact(F.array(
        F.when(_size(vulns) > 0, F.concat(_size(vulns).cast("string"), F.lit(" known CVE(s): "),
                                          F.array_join(F.slice(F.sort_array(vulns), 1, 5), ", "))),
        F.when(F.array_size(hostile) > 0, F.concat(F.lit("tags: "), F.array_join(hostile, ", "))),
        F.when(_size(ports) > port_limit, F.concat(_size(ports).cast("string"), F.lit(" exposed ports"))),
    ))


def time_context(epoch: Column) -> Column:
    """Struct of ISO second, hour of day and weekday abbreviation; NULL members without a time."""
    t = F.timestamp_seconds(F.floor(epoch))
    return F.struct(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso_timestamp"),
                    F.hour(t).alias("hour_of_day"),
                    F.date_format(t, "E").alias("day_of_week"))


def json_path_exists(document: Column, path: Column) -> Column:
    """Dotted path with [N] indices resolves to a value that is not null."""
    return F.try_variant_get(F.try_parse_json(document), F.concat(F.lit("$."), path), "string").isNotNull()


def upload_ratio(bytes_in: Column, bytes_out: Column) -> Column:
    total = bytes_in + bytes_out
    return F.when(total > 0, F.round(bytes_out / total, 3))
