"""Host-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level suffixes under which a registrable name has three labels.
MULTI_SLD = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.il", "org.il", "ac.il", "net.il", "gov.il",
    "com.au", "net.au", "org.au", "co.jp", "com.br", "co.in", "com.cn", "co.kr", "co.za",
)
# Fixed value: first labels that are service or device chatter.
CHATTER_PATTERN = r"(?i)^_|^wpad$|^KMD|^BRW|^v1$|^server|^HP$"
MDNS_HEX_PATTERN = r"^[0-9a-f\-]{8,}"
# Browsing categories in match order.
DOMAIN_CATEGORIES = (
    ("Streaming", ("netflix", "youtube", "spotify", "twitch", "hulu", "disneyplus", "vimeo", "soundcloud",
                   "tidal")),
    ("Work/Enterprise", ("service-now", r"sas\.com", "salesforce", "slack", "zoom", r"teams\.microsoft",
                         "office365", "sharepoint", "confluence", "jira", "workday", "okta")),
    ("Google/Cloud", ("google", "gmail", "gstatic", "googleapis", "googleusercontent", "gvt[12]", "ggpht")),
    ("Cloud Infra", ("amazonaws", "azure", "cloudfront", "akamai", "fastly", "cloudflare", "digitalocean",
                     "heroku")),
    ("Social", ("facebook", "instagram", "twitter", "tiktok", "linkedin", "pinterest", "reddit", "snapchat")),
    ("Security/Update", ("ocsp", "crl", "certificate", "update", "telemetry", "safebrowsing", "malware",
                         "avast", "norton", "windowsupdate", r"microsoft\.com")),
    ("News/Media", ("bbc", "cnn", "nytimes", "reuters", "apnews", "theguardian", "ynet", "haaretz", "maariv",
                    "walla", "n12", r"kan\.org")),
    ("CDN/Infra", ("cdn", "static", "edge", "cache", r"d[0-9a-z]+\.net", "doubleclick", "2mdn", "chartbeat")),
)


def strip_trailing_dots(name: Column) -> Column:
    return F.regexp_replace(name, r"\.+$", "")


def _strip_dots(name: Column) -> Column:
    return F.regexp_replace(name, r"^\.+|\.+$", "")


def registrable_domain(name: Column) -> Column:
    """Last two labels, or three under a multi-label suffix; lower case, outer dots removed."""
    clean = F.lower(_strip_dots(F.coalesce(name, F.lit(""))))
    two = F.substring_index(clean, ".", -2)
    three = F.substring_index(clean, ".", -3)
    return F.when(two.isin(*MULTI_SLD), three).otherwise(two)


def registrable_simple(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def leftmost_label(name: Column) -> Column:
    return F.substring_index(_strip_dots(F.coalesce(name, F.lit(""))), ".", 1)


def shannon_entropy(text: Column) -> Column:
    """Bits per character. The characters are counted by how much the text shrinks without each of them."""
    size = F.length(text).cast("double")
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    bits = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(bits)


def vowel_ratio(text: Column) -> Column:
    low = F.lower(text)
    size = F.length(low)
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        (size - F.length(F.translate(low, "aeiou", ""))) / size)


def is_long_query(name: Column, limit: int = 60) -> Column:
    return F.length(strip_trailing_dots(name)) > limit


def is_real_dns(name: Column) -> Column:
    """Has a dot, is not multicast DNS and its first label is not service chatter."""
    return (name.contains(".") & ~name.endswith(".local")
            & ~F.substring_index(name, ".", 1).rlike(CHATTER_PATTERN))


def is_mdns_device_name(name: Column) -> Column:
    return (name.endswith(".local") & ~name.startswith("_") & ~name.rlike(MDNS_HEX_PATTERN)
            & (F.length(name) > 8))


def classify_domain(name: Column) -> Column:
    low = F.lower(name)
    branch = None
    for label, patterns in DOMAIN_CATEGORIES:
        test = low.rlike("|".join(patterns))
        branch = F.when(test, label) if branch is None else branch.when(test, label)
    return branch.otherwise("Other")


def device_name(ip: Column, mdns_names: Column, model: Column) -> Column:
    """First usable multicast name, else the model with the last octet of the address."""
    def tidy(n):
        head = F.regexp_replace(F.substring_index(n, "._", 1), r"\.+$", "")
        return F.regexp_replace(F.regexp_replace(head, r"\.local$", ""), r"\.+$", "")

    named = F.filter(F.transform(mdns_names, tidy),
                     lambda n: F.length(n).between(3, 40) & ~n.startswith("_"))
    dots = F.length(ip) - F.length(F.translate(ip, ".", ""))
    last = F.when(dots == 3, F.substring_index(ip, ".", -1)).otherwise("?")
    base = F.replace(F.trim(F.substring_index(model, "(", 1)), F.lit(" "), F.lit("-"))
    return F.coalesce(F.get(named, F.lit(0)), F.concat(base, F.lit("-"), last))
