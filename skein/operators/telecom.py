"""Telecom and geo-temporal operators. A pair or score is a lead to check; counts and evidence come with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import haversine
from .graph import components


def sims_per_device(df: DataFrame, device: str, sim: str, min_sims: int = 10, bucket: str | None = None) -> DataFrame:
    """Devices (by bucket, if given) with at least min_sims distinct SIMs."""
    keys = [device] + ([bucket] if bucket else [])
    return df.where(F.col(device).isNotNull()).groupBy(*keys).agg(F.countDistinct(sim).alias("n_sims"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where(F.col("n_sims") >= min_sims)


def identity_clusters(df: DataFrame, device: str, sim: str, min_numbers: int = 5) -> DataFrame:
    """cluster, member, kind, n_numbers: devices and SIMs that belong together; invalid devices must be null."""
    pairs = df.where(F.col(device).isNotNull() & F.col(sim).isNotNull()).select(F.concat(F.lit("d:"), device).alias("a"), F.concat(F.lit("s:"), sim).alias("b")).distinct()
    c = components(pairs).withColumn("kind", F.when(F.col("id").startswith("d:"), "device").otherwise("sim"))
    n = c.where("kind = 'sim'").groupBy("component").agg(F.count("*").alias("n_numbers")).where(F.col("n_numbers") >= min_numbers)
    return c.join(n, "component").select(F.col("component").alias("cluster"), F.substring("id", 3, 1 << 30).alias("member"), "kind", "n_numbers")


def tower_intersection(df: DataFrame, scenes: DataFrame, phone: str, cell: str, k: int | None = None) -> DataFrame:
    """phone, scenes_hit: phones seen in at least k scenes (all, if k is None); scenes: scene, cell, start, end.

    Scenes are hand-written, a row a cell: they are counted and refused beyond a million before they are broadcast.
    """
    n = scenes.agg(F.countDistinct("scene").alias("s"), F.count("*").alias("rows")).first()
    if n["rows"] > 1_000_000:
        raise ValueError("too many scene rows to broadcast")
    s = F.broadcast(scenes.withColumnRenamed("cell", "scene_cell"))
    hits = df.join(s, (F.col(cell) == F.col("scene_cell")) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    return hits.groupBy(phone).agg(F.countDistinct("scene").alias("scenes_hit")).where(F.col("scenes_hit") >= (n["s"] if k is None else k))


def residents(df: DataFrame, phone: str, min_days: int) -> DataFrame:
    """Phones seen on at least min_days distinct days."""
    return df.groupBy(phone).agg(F.countDistinct(F.to_date("ts")).alias("days_seen")).where(F.col("days_seen") >= min_days)


def drop_residents(df: DataFrame, baseline: DataFrame, phone: str, min_days: int) -> DataFrame:
    return df.join(residents(baseline, phone, min_days).select(phone), phone, "left_anti")


def shortlist(df: DataFrame, phone: str, top: int = 3, *, by: str = "scenes_hit", rarity: str | None = None) -> DataFrame:
    """The top survivors: most scenes, then the rarest, then the least id."""
    order = [F.desc(by), *([F.asc(rarity)] if rarity else []), F.asc(phone)]
    return df.orderBy(*order).limit(top)


def within_fence(df: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows (lat, lon) within a circle; a box of degrees comes first, so most rows never reach the trigonometry."""
    dlat = metres / 111_000
    box = F.abs(F.col("lat") - lat) <= dlat
    return df.where(box).withColumn("metres", haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).where(F.col("metres") <= metres)


def near_in_time(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Pairs of the same key at most `seconds` apart: an equi join on time buckets, not a nested loop.

    Both sides have id, who, ts and the key; the columns of the right side get the suffix 2.
    """
    micros = seconds * 1_000_000
    a = left.withColumn("us", F.unix_micros("ts")).withColumn("bucket", F.floor(F.col("us") / micros))
    b = right.select(*(F.col(c).alias(f"{c}2") for c in right.columns)).withColumn("us2", F.unix_micros("ts2"))
    b = b.withColumn("bucket2", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("us2") / micros) + d)))
    return a.join(b, (F.col(key) == F.col(f"{key}2")) & (F.col("bucket") == F.col("bucket2")) & (F.abs(F.col("us") - F.col("us2")) <= micros)).drop("bucket", "bucket2", "us", "us2")


def colocated(df: DataFrame, key: str, seconds: int = 900, min_meets: int = 1) -> DataFrame:
    """a, b, n_meets, first_ts, last_ts of unordered pairs at the same key in time; df has id, who, ts and the key."""
    p = near_in_time(df, df, key, seconds).where("who < who2")
    g = p.groupBy(F.col("who").alias("a"), F.col("who2").alias("b")).agg(F.count("*").alias("n_meets"), F.min(F.least("ts", "ts2")).alias("first_ts"), F.max(F.greatest("ts", "ts2")).alias("last_ts"))
    return g.where(F.col("n_meets") >= min_meets)


def seen_together(left: DataFrame, right: DataFrame, key: str, seconds: int = 900, min_meets: int = 1) -> DataFrame:
    """a, b, n_meets, first_ts, last_ts of a vehicle of the left and a phone of the right table at the same key in time.

    Both have id, who, ts and the key; a meeting is a pair of records.
    """
    g = near_in_time(left, right, key, seconds).groupBy(F.col("who").alias("a"), F.col("who2").alias("b"))
    return g.agg(F.count("*").alias("n_meets"), F.min(F.least("ts", "ts2")).alias("first_ts"), F.max(F.greatest("ts", "ts2")).alias("last_ts")).where(F.col("n_meets") >= min_meets)


def intermediaries(edges: DataFrame) -> DataFrame:
    """a, b, via of pairs that share a neighbour and are not neighbours; edges have a < b and are distinct."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    x, y = both.select(F.col("a").alias("via"), F.col("b").alias("p")), both.select(F.col("a").alias("via2"), F.col("b").alias("q"))
    pairs = x.join(y, (F.col("via") == F.col("via2")) & (F.col("p") < F.col("q"))).select(F.col("p").alias("a"), F.col("q").alias("b"), "via")
    return pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti")


def asof(left: DataFrame, right: DataFrame, by: str, carried: list[str], seconds: int | None = None, after: bool = False, prefix: str = "match") -> DataFrame:
    """Each left row (id, ts) with the last right row at or before it (after: the first one after it): one union and one window, no range join.

    At equal times the right row with the lesser or equal id counts. Keys with a very large history can be split by
    period beforehand.
    """
    row = F.struct("ts", *carried)
    u = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(row).schema[0].dataType)).unionByName(right.withColumn("_l", F.lit(0)).withColumn("_r", row), allowMissingColumns=True)
    order = [F.desc("ts"), F.desc("id"), F.desc("_l")] if after else ["ts", "id", "_l"]
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = u.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l = 1")
    if seconds is not None:
        out = out.withColumn("_m", F.when(F.abs(F.unix_micros("ts") - F.unix_micros("_m.ts")) <= seconds * 1_000_000, F.col("_m")))
    return out.select(*left.columns, F.col("_m.ts").alias(f"{prefix}_ts"), *(F.col(f"_m.{c}").alias(f"{prefix}_{c}") for c in carried))


def sat_ground_match(sat: DataFrame, ground: DataFrame, by: str, seconds: int, metres: float) -> DataFrame:
    """Satellite fixes (id, ts, lat, lon, by) with the ground fix that is nearest in time, if within the time and distance.

    Of two as near the earlier one counts.
    """
    got = ["id", "lat", "lon"]
    m = asof(asof(sat, ground, by, got, seconds), ground, by, got, seconds, after=True, prefix="next")
    gap = lambda x: F.abs(F.unix_micros("ts") - F.unix_micros(f"{x}_ts"))
    later = F.coalesce(gap("next") < gap("match"), F.col("match_ts").isNull())
    m = m.select(*sat.columns, *(F.when(later, F.col(f"next_{c}")).otherwise(F.col(f"match_{c}")).alias(f"match_{c}") for c in ("ts", *got)))
    return m.withColumn("metres", haversine("lat", "lon", "match_lat", "match_lon")).where(F.col("metres") <= metres)


def flag_prefix(df: DataFrame, number: str, prefixes: list[str]) -> DataFrame:
    """A weak signal by number prefix, tier INFERRED; plus signs and zeros in front do not count."""
    digits = F.regexp_replace(F.col(number), r"^[+0]+", "")
    hit = F.coalesce(*(F.when(digits.startswith(p.lstrip("+")), F.lit(p)) for p in prefixes))
    return df.withColumn("prefix", hit).where("prefix is not null").withColumn("tier", F.lit("INFERRED"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_s: int = 3600) -> DataFrame:
    """Pairs of intervals [start, end] of equal key that overlap, once each, by buckets of time; right columns get suffix 2."""
    slot = lambda c: F.floor(F.unix_seconds(c) / bucket_s)
    a = left.withColumn("_b", F.explode(F.sequence(slot("start"), slot("end"))))
    b = right.select(*(F.col(c).alias(f"{c}2") for c in right.columns)).withColumn("_b2", F.explode(F.sequence(slot("start2"), slot("end2"))))
    once = F.col("_b") == F.greatest(slot("start"), slot("start2"))
    return a.join(b, (F.col(key) == F.col(f"{key}2")) & (F.col("_b") == F.col("_b2")) & once & (F.col("start") <= F.col("end2")) & (F.col("start2") <= F.col("end"))).drop("_b", "_b2")


def reconcile(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """id, id2, status of two record sets (id, who, ts, key): matched in time, only left or only right."""
    p = near_in_time(left, right, key, seconds).select("id", "id2").distinct()
    l = left.select("id").join(p, "id", "left")
    r = right.select(F.col("id").alias("id2")).join(p.select("id2").distinct(), "id2", "left_anti").withColumn("id", F.lit(None).cast(dict(left.dtypes)["id"]))
    return l.unionByName(r.select("id", "id2")).withColumn("status", F.when(F.col("id").isNull(), "only_right").when(F.col("id2").isNull(), "only_left").otherwise("matched"))


def timeline(df: DataFrame, case: str) -> DataFrame:
    """Events of each case in order (ts, id) with the seconds since the one before."""
    w = Window.partitionBy(case).orderBy("ts", "id")
    return df.withColumn("gap_s", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6).withColumn("seq", F.row_number().over(w))


def shared_documents(df: DataFrame, document: str, holder: str, min_n: int = 2) -> DataFrame:
    """Identity documents behind at least min_n holders."""
    return df.groupBy(document).agg(F.countDistinct(holder).alias("n_holders")).where(F.col("n_holders") >= min_n)
