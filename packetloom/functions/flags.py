"""TCP flag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six classic flag bits and the exact combinations of each scan class.
CLASSIC_BITS = 0x3F
RST_BIT = 0x04
FLAG_CLASSES = {"syn": 0x02, "fin": 0x01, "null": 0x00, "xmas": 0x29}
TCP_START_TEXTS = ("0x02", "0x0002", "0x00000002", "2")


def tcp_flag_int(text: Column) -> Column:
    """Hex text (with or without 0x) to BIGINT; anything else is 0."""
    digits = F.replace(F.lower(F.trim(text)), F.lit("0x"), F.lit(""))
    is_hex = F.length(digits).between(1, 8) & (F.translate(digits, "0123456789abcdef", "") == "")
    return F.when(is_hex, F.conv(digits, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def flag_class(value: Column, name: str) -> Column:
    """Boolean column over a flag number: syn, fin, null, xmas match exactly under the mask, rst is a bit test."""
    if name == "rst":
        return value.bitwiseAND(F.lit(RST_BIT).cast("bigint")) != 0
    return value.bitwiseAND(F.lit(CLASSIC_BITS).cast("bigint")) == FLAG_CLASSES[name]


def tcp_flag_class(text: Column, name: str) -> Column:
    """:func:`flag_class` of the exported text."""
    return flag_class(tcp_flag_int(text), name)


def is_tcp_start(proto: Column, flags: Column) -> Column:
    """Plain SYN as exported text; SYNs carrying ECN bits are not starts here."""
    return F.coalesce((proto == "TCP") & flags.isin(*TCP_START_TEXTS), F.lit(False))
