"""Readers that keep what they reject, unification of headers and zones, graph tables, and stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import TIERS, device_key, instant, msisdn

#: Headers of call records by operator (fixed values of this engine; real headers vary by circle).
CDR_HEADERS = {
    "generic": {"call_id": "call_id", "a_party": "a_party", "b_party": "b_party", "start": "start", "duration": "duration_s", "imei": "imei", "imsi": "imsi", "cell": "cell_id"},
    "short": {"id": "call_id", "calling": "a_party", "called": "b_party", "time": "start", "secs": "duration_s", "imei_no": "imei", "imsi_no": "imsi", "cgi": "cell_id"},
}
CDR = ("call_id", "a_party", "b_party", "start", "duration_s", "imei", "imsi", "cell_id")


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and with their raw lines (_reject) those that don't; nothing is inferred and nothing is lost."""
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    raw = spark.read.schema(f"{schema}, _reject string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_reject").csv(path)
    return raw.where("_reject is null").drop("_reject"), raw.where("_reject is not null")


def unify(df: DataFrame, headers: dict[str, str], wanted: tuple[str, ...]) -> DataFrame:
    """Rename by the map; columns that are missing become null strings, others are dropped."""
    known = {headers[c]: c for c in df.columns if c in headers}
    return df.select(*((F.col(known[w]) if w in known else F.lit(None).cast("string")).alias(w) for w in wanted))


def read_cdr(spark: SparkSession, path: str, operator: str = "generic", zone: str = "Asia/Kolkata") -> tuple[DataFrame, DataFrame]:
    """Call records of one operator in the common schema (UTC times, cleaned numbers, device keys, tier OBSERVED), and the lines that don't fit."""
    headers = CDR_HEADERS[operator]
    rows, rejects = read_csv(spark, path, {c: "string" for c in headers})
    d = unify(rows, headers, CDR).withColumn("src_zone", F.lit(zone)).withColumn("operator", F.lit(operator))
    d = d.withColumn("start_ts", instant("start", F.col("src_zone"))).withColumn("duration_s", F.expr("try_cast(duration_s as int)"))
    d = d.withColumn("a_party", msisdn("a_party")).withColumn("b_party", msisdn("b_party")).withColumn("device", device_key("imei"))
    d = d.drop("start").withColumn("luhn_ok", F.expr("luhn_check(imei)")).withColumn("tier", F.lit("OBSERVED")).withColumn("evidence", F.array("call_id"))
    return d, rejects


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices (id, label, props) and edges (src, dst, type, ts, weight, tier, evidence), by label and type; tiers are checked."""
    checked = edges.withColumn("tier", F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise(F.raise_error(F.lit("an edge without a tier"))))
    vertices.write.mode("overwrite").partitionBy("label").parquet(f"{path}/vertices")
    checked.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def fuse(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type): how many, when, all evidence in order, and the weakest tier."""
    code = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    g = edges.groupBy("src", "dst", "type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.col("weight").cast("decimal(18,2)")).alias("weight"), F.max(code).cast("int").alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return g.withColumn("tier", F.element_at(F.array(*map(F.lit, TIERS)), F.col("c"))).drop("c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k, the stand-in for a device, tower or shared attribute; user_id stands for a SIM, phone or account."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def hand(e: DataFrame) -> DataFrame:
    """Directed, timed transfers: within each k, an event's user to the next event's user."""
    nxt = F.lead("user_id").over(Window.partitionBy("k").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("src"), nxt.alias("dst"), "ts", "value", "k", "event_id").where("dst is not null")
