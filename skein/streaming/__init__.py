"""Live forms of the burner and structuring operators, with watermarks for late records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sims_per_device(events: DataFrame, device: str, sim: str, min_sims: int, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Devices by window with at least about min_sims SIMs; counts are approximate, as exact ones would hold every SIM."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), device)
    return w.agg(F.approx_count_distinct(sim, 0.02).alias("n_sims")).where(F.col("n_sims") >= min_sims).select(device, F.col("window.start").alias("start"), "n_sims")


def live_structuring(events: DataFrame, account: str, limit: float, hours: int = 24, slide: str = "1 hour", min_n: int = 4, multiple: float = 2, late: str = "1 hour") -> DataFrame:
    """Accounts by sliding window with min_n transfers below the limit that sum to multiple * limit or more."""
    w = events.where(F.col("value") < limit).withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", slide), account)
    g = w.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return g.where((F.col("n") >= min_n) & (F.col("total") >= multiple * limit)).select(account, F.col("window.start").alias("start"), "n", "total")


def live_sessions(events: DataFrame, account: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity by account."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), account)
    return g.agg(F.count("*").alias("n")).select(account, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
