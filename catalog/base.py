"""Shared pieces of the registered queries: input tables, SQL prefixes and output tidying."""

from __future__ import annotations

import uuid

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.session import ensure_checkpoint_dir
from packetloom.sources.adapters import PACKET_EXPRESSIONS, flows_from_lineitem, packets_from_events
from packetloom.sources.tables import read_results, write_results

_INT = (T.ByteType, T.ShortType, T.IntegerType)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """BIGINT for integers, rounded DOUBLE for floats; other types as they are."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _INT):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


@dataclass
class Catalog:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None, digits: int = 6):
        def wrap(fn):
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
            if sql is not None:
                self.sql[name] = sql
            return fn
        return wrap


def packets(spark, sf_dir) -> DataFrame:
    return packets_from_events(spark, sf_dir)


def flows(spark, sf_dir) -> DataFrame:
    return flows_from_lineitem(spark, sf_dir)


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark, sf_dir, name, build) -> DataFrame:
    """A result table as the history store keeps it: written once per application, read by what follows."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        write_results({name: build()}, path)
        _stored[key] = path
    return read_results(spark, _stored[key], name)


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL text for the check engine -------------------------------------------------------------

def rd(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


def rdd(expr: str, digits: int) -> str:
    """Half-up on the decimal text, for roundings to few digits where exact ties occur."""
    return f"cast(round(cast({expr} as decimal(38, 12)), {digits}) as double)"


_RAW = ", ".join(f"{e} as {n}" for n, e in PACKET_EXPRESSIONS.items())
_PLAIN = [n for n in PACKET_EXPRESSIONS
          if n not in ("session_id", "packet_id", "ts_us", "len", "ip_src", "ip_dst", "dns_response",
                       "tcp_sport", "tcp_dport", "udp_sport", "udp_dport")]

RAW_SQL = f"""ev as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, epoch_us(ts) as epoch_us
  from events), raw as (select {_RAW} from ev)"""

PACKETS_SQL = RAW_SQL + """, packets as (select session_id, packet_id, ts_us / 1000000.0::double as ts,
  coalesce(try_cast(try_cast(len as double) as bigint), 0) as len,
  case when ip_src <> '' then ip_src else nullif(ip6_src, '') end as ip_src,
  case when ip_dst <> '' then ip_dst else nullif(ip6_dst, '') end as ip_dst,
  case when dns_response in ('1', 'True', 'true') then '1' else '0' end as dns_response,
  try_cast(nullif(tcp_sport, '') as bigint) as tcp_sport, try_cast(nullif(tcp_dport, '') as bigint) as tcp_dport,
  try_cast(nullif(udp_sport, '') as bigint) as udp_sport, try_cast(nullif(udp_dport, '') as bigint) as udp_dport,
  """ + ", ".join(f"nullif({c}, '') as {c}" for c in _PLAIN) + " from raw)"

_FLAG_INT = ("case when regexp_matches(coalesce({0}, ''), '^(0x)?[0-9a-fA-F]+$') "
             "then cast('0x' || replace({0}, '0x', '') as bigint) else 0 end")
FLAGGED_SQL = PACKETS_SQL + f""", flagged as (select *, {_FLAG_INT.format('tcp_flags')} as fi from packets)"""

FEATURES_SQL = FLAGGED_SQL + """, core as (select session_id, ip_src as ip, count(*) as "count", cast(sum(len) as bigint) as total_bytes,
  avg(len) as mean_len, coalesce(stddev_samp(len), 0.0) as std_len, count(distinct ip_dst) as unique_dsts
  from packets where ip_src is not null and ip_dst is not null group by all),
flagcnt as (select session_id, ip_src as ip, count(*) filter (fi & 63 = 2) as syn_count, count(*) filter (fi & 4 <> 0) as rst_count,
  count(*) filter (fi & 63 = 1) as fin_count, count(*) filter (fi & 63 = 0) as null_count, count(*) filter (fi & 63 = 41) as xmas_count
  from flagged where tcp_flags is not null and ip_src is not null group by all),
features as (select c.*, "count" / (std_len + 1) as burst_score, "count" + total_bytes / 1000.0::double as dominance,
  coalesce(syn_count, 0) as syn_count, coalesce(rst_count, 0) as rst_count, coalesce(fin_count, 0) as fin_count,
  coalesce(null_count, 0) as null_count, coalesce(xmas_count, 0) as xmas_count
  from core c left join flagcnt f using (session_id, ip))"""

FLOWS_SQL = """flows as (select case when l_returnflag = 'N' then 'S2' else 'S1' end as session_id,
  epoch_us(l_shipdate) / 1000000.0::double as ts, cast(floor(l_extendedprice) as bigint) as len,
  '10.1.' || cast(l_suppkey // 250 as varchar) || '.' || cast(l_suppkey % 250 as varchar) as ip_src,
  '52.2.' || cast(l_partkey // 250 as varchar) || '.' || cast(l_partkey % 250 as varchar) as ip_dst,
  case l_linenumber % 6 when 0 then '0x0010' when 1 then '0x0002' when 2 then '0x0018' when 3 then '0x0001'
    when 4 then '0x0014' else '0x00c2' end as tcp_flags from lineitem),
flow_features as (select session_id, ip_src as ip, count(*) as "count", cast(sum(len) as bigint) as total_bytes, avg(len) as mean_len,
  coalesce(stddev_samp(len), 0.0) as std_len, count(distinct ip_dst) as unique_dsts,
  count(*) / (coalesce(stddev_samp(len), 0.0) + 1) as burst_score, count(*) + sum(len) / 1000.0::double as dominance,
  count(*) filter (tcp_flags in ('0x0002', '0x00c2')) as syn_count, count(*) filter (tcp_flags = '0x0014') as rst_count,
  count(*) filter (tcp_flags = '0x0001') as fin_count, 0::bigint as null_count, 0::bigint as xmas_count
  from flows group by all)"""

# Independent statement of the private registry for IPv4 and the IPv6 prefixes used in the tests.
_N = ("(cast(split_part({0}, '.', 1) as bigint) * 16777216 + cast(split_part({0}, '.', 2) as bigint) * 65536 "
      "+ cast(split_part({0}, '.', 3) as bigint) * 256 + cast(split_part({0}, '.', 4) as bigint))")


def ipnum_sql(col: str) -> str:
    return f"case when regexp_full_match({col}, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') then {_N.format(col)} end"


def private_sql(col: str) -> str:
    n = _N.format(col)
    v4 = (f"({n} >> 24 in (0, 10, 127) or {n} >> 24 >= 240 or {n} >> 16 in (43518, 49320) "
          f"or {n} >> 20 = 2753 or {n} >> 17 = 25353 or {n} >> 8 in (12582914, 12989284, 13303921) "
          f"or ({n} >> 8 = 12582912 and {n} not in (3221225481, 3221225482)))")
    return (f"coalesce(case when regexp_full_match({col}, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') then {v4} "
            f"else regexp_matches({col}, '^(f[cd]..:|fe[89ab].:|::1?$)') end, false)")


def local_scope_sql(col: str) -> str:
    n = _N.format(col)
    return (f"({private_sql(col)} or coalesce(case when regexp_full_match({col}, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') "
            f"then {n} >> 28 = 14 else starts_with({col}, 'ff') end, false))")
