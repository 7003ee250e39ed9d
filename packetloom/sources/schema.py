"""Column lists and types of the packet table and of the records derived from it."""

from __future__ import annotations

from pyspark.sql import types as T

# Field order of the exports. The base export has 22 fields, the wide one 28,
# the permanent index their union.
BASE_FIELDS = (
    "ts", "len", "eth_src", "eth_dst", "ip_src", "ip_dst", "ip6_src", "ip6_dst", "proto",
    "tcp_sport", "tcp_dport", "tcp_flags", "udp_sport", "udp_dport",
    "dns_qname", "dns_rcode", "dns_response", "arp_psrc", "arp_hwsrc", "arp_opcode",
    "http_host", "tls_sni",
)
WIDE_FIELDS = (
    "ts", "len", "eth_src", "eth_dst", "ip_src", "ip_dst", "ip6_src", "ip6_dst", "proto",
    "tcp_sport", "tcp_dport", "tcp_flags", "udp_sport", "udp_dport",
    "dns_qname", "dns_qtype", "dns_rcode", "dns_response",
    "arp_opcode", "arp_psrc", "arp_hwsrc", "arp_pdst",
    "tls_sni", "tls_ja3", "tls_ja4", "tls_version", "tls_cipher", "dhcp_sid",
)
# The order of a live feed; the IPv6 pair comes last and may be missing.
LIVE_FIELDS = (
    "ts", "len", "eth_src", "ip_src", "ip_dst", "proto", "tcp_sport", "tcp_dport", "tcp_flags", "udp_sport", "udp_dport",
    "dns_qname", "dns_rcode", "dns_response", "arp_psrc", "arp_hwsrc", "ip6_src", "ip6_dst",
)
WLAN_FIELDS = ("wlan_type", "wlan_subtype", "wlan_sa", "wlan_retry", "rssi_radiotap", "rssi_wlanradio",
               "wlan_bssid", "wlan_ssid")
EXTRA_FIELDS = ("payload",)
UNION_FIELDS = tuple(dict.fromkeys(BASE_FIELDS + WIDE_FIELDS))
PACKET_FIELDS = tuple(dict.fromkeys(UNION_FIELDS + WLAN_FIELDS + EXTRA_FIELDS))

PORT_FIELDS = ("tcp_sport", "tcp_dport", "udp_sport", "udp_dport")

SIGNAL_COLUMNS = ("device", "peer", "signal", "tactic", "technique", "score", "severity", "count",
                  "first_ts", "last_ts", "detail")

FEATURES_MODEL = ("mean_len", "std_len", "count", "burst_score", "unique_dsts", "syn_count", "rst_count",
                  "fin_count", "null_count", "xmas_count")
FEATURES_BASELINE = FEATURES_MODEL + ("bytes_src", "bytes_dst")
FEATURES_PROFILE = ("count", "total_bytes", "mean_len", "std_len", "unique_dsts", "burst_score",
                    "syn_count", "rst_count")
FEATURES_MAP = ("count", "total_bytes", "mean_len", "std_len", "unique_dsts", "syn_count", "rst_count")


def raw_schema(fields=BASE_FIELDS) -> T.StructType:
    """All-text schema of a field export."""
    return T.StructType([T.StructField(name, T.StringType()) for name in fields])
