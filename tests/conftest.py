import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packetloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PACKET = dict(session_id="S1", ts="0", len="60", eth_src="", eth_dst="", ip_src="", ip_dst="", ip6_src="", ip6_dst="", proto="",
              tcp_sport="", tcp_dport="", tcp_flags="", udp_sport="", udp_dport="", dns_qname="", dns_qtype="", dns_rcode="",
              dns_response="", arp_opcode="", arp_psrc="", arp_hwsrc="", arp_pdst="", http_host="", tls_sni="", tls_ja3="", tls_ja4="",
              tls_version="", tls_cipher="", dhcp_sid="", wlan_type="", wlan_subtype="", wlan_sa="", wlan_retry="", rssi_radiotap="",
              rssi_wlanradio="", wlan_bssid="", wlan_ssid="", payload="")


@pytest.fixture(scope="session")
def make(spark):
    """Normalised packet table from partial rows; missing fields are ''."""
    from packetloom.sources.packets import normalize_packets

    def build(rows):
        data = [tuple(str({**PACKET, **r}[c]) for c in PACKET) for r in rows]
        return normalize_packets(spark.createDataFrame(data, ", ".join(f"{c} string" for c in PACKET)))

    return build
