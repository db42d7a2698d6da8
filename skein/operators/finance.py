"""Financial operators: traces, fans, structuring, shared attributes, flows, delays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def trace(edges: DataFrame, seeds: DataFrame, max_gap_s: int, max_hops: int = 5, terminal: DataFrame | None = None) -> DataFrame:
    """origin, holder, hop, path, last_ts, evidence of walks from seed transfers, each hop strictly later and within the gap.

    edges and seeds have src, dst, ts, event_id. A join a hop, bounded by max_hops; no account comes twice. terminal
    (id) keeps the walks that end there. Counts of walks are not amounts.
    """
    ok = lambda d: d.where("src is not null and dst is not null and src <> dst")
    e = ok(edges).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("ts").alias("_t"), F.col("event_id").alias("_e"))
    at = ok(seeds).select(F.col("src").alias("origin"), F.col("dst").alias("holder"), F.lit(1).alias("hop"), F.array("src", "dst").alias("path"), F.col("ts").alias("last_ts"), F.array("event_id").alias("evidence"))
    out = at
    for hop in range(2, max_hops + 1):
        later = (F.col("_t") > F.col("last_ts")) & (F.unix_micros("_t") <= F.unix_micros("last_ts") + max_gap_s * 1_000_000)
        at = at.join(e, (F.col("holder") == F.col("_s")) & later & ~F.array_contains("path", F.col("_d")))
        at = at.select("origin", F.col("_d").alias("holder"), F.lit(hop).alias("hop"), F.concat("path", F.array("_d")).alias("path"), F.col("_t").alias("last_ts"), F.concat("evidence", F.array("_e")).alias("evidence"))
        out = out.unionByName(at)
    if terminal is not None:
        out = out.join(terminal.select(F.col("id").alias("holder")), "holder", "left_semi")
    return out.withColumn("tier", F.lit("DERIVED"))


def _rolling(key: str, hours: float):
    return Window.partitionBy(key).orderBy(F.unix_micros("ts")).rangeBetween(-int(hours * 3_600_000_000), 0)


def fan(df: DataFrame, account: str, party: str, hours: float, min_parties: int) -> DataFrame:
    """Transfers at which the account has dealt with at least min_parties distinct parties in the rolling window."""
    n = F.size(F.array_distinct(F.collect_list(party).over(_rolling(account, hours))))
    return df.withColumn("n_parties", n).where(F.col("n_parties") >= min_parties)


def structuring(df: DataFrame, account: str, limit: float, hours: float = 24, min_n: int = 4, multiple: float = 2) -> DataFrame:
    """Transfers below the limit whose rolling window holds min_n such and sums to multiple * limit or more."""
    w = _rolling(account, hours)
    small = df.where((F.col("value") < limit) & F.col("value").isNotNull())
    d = small.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum(F.col("value").cast("decimal(18,2)")).over(w))
    return d.where((F.col("n") >= min_n) & (F.col("total") >= multiple * limit)).withColumn("tier", F.lit("INFERRED"))


def shared_attributes(df: DataFrame, account: str, attribute: str, hub_cap: int, min_shared: int = 1) -> DataFrame:
    """a, b, shared of accounts with common attribute values; values of more than hub_cap accounts say nothing and are left out."""
    d = df.where(F.col(attribute).isNotNull()).select(F.col(account).alias("a"), F.col(attribute).alias("v")).distinct()
    few = d.groupBy("v").agg(F.count("*").alias("n")).where((F.col("n") <= hub_cap) & (F.col("n") > 1)).select("v")
    d = d.join(few, "v", "left_semi")
    return d.join(d.select(F.col("a").alias("b"), F.col("v").alias("v2")), (F.col("v") == F.col("v2")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def handler_clusters(df: DataFrame, account: str, attribute: str, hub_cap: int, min_shared: int = 1) -> DataFrame:
    """id, component (its least account) of accounts that hang together by shared attribute values."""
    return components(shared_attributes(df, account, attribute, hub_cap, min_shared))


def flow_matrix(df: DataFrame, source: str | list[str], layer: str, layers: list, value: str) -> DataFrame:
    """Totals by source (bank, or paying and receiving bank), a column a layer."""
    return df.groupBy(*([source] if isinstance(source, str) else source)).pivot(layer, layers).agg(F.sum(F.col(value).cast("decimal(18,2)")))


def delay_stats(df: DataFrame, start: str, end: str, by: str) -> DataFrame:
    """n, median and 90th percentile of the seconds from start to end."""
    s = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return df.groupBy(by).agg(F.count("*").alias("n"), F.percentile(s, F.lit(0.5)).alias("median_s"), F.percentile(s, F.lit(0.9)).alias("p90_s"))
