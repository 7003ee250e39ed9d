"""Column functions: every scalar of the library is a ``Column -> Column`` expression run in the JVM."""

from .addresses import (  # noqa: F401
    coalesce_ip, ipv4_long, is_local_scope, is_private, is_public, is_random_mac, oui_prefix, subnet24,
)
from .flags import FLAG_CLASSES, flag_class, is_tcp_start, tcp_flag_class, tcp_flag_int  # noqa: F401
from .names import (  # noqa: F401
    classify_domain, device_name, is_long_query, is_mdns_device_name, is_real_dns, leftmost_label,
    registrable_domain, registrable_simple, shannon_entropy, strip_trailing_dots, vowel_ratio,
)
from .misc import (  # noqa: F401
    behaviour_tags, canonical_hash, content_hash, distance_bucket, json_path_exists, rssi_distance_m,
    ti_reasons, ti_score, time_context, tls_version_label, upload_ratio, verdict_cache_key, weak_cipher,
    weak_tls_version,
)
