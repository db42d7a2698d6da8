"""Every query of the engine by name, and the SQL that gives the same rows.

The tables are a retail schema; `ev` and `hand` let the operators run on them: k plays device, tower or shared
attribute, user_id plays SIM, phone or account, value plays amount.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .operators import evidence, finance, graph, telecom, text
from .sources import ev, fuse, hand, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
HAND = EV + ", hand AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY k ORDER BY ts, event_id) AS dst, ts, value, k, event_id FROM ev) WHERE dst IS NOT NULL)"
BACKBONE = HAND + ", e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM hand WHERE value >= 150 AND src <> dst), n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _meets(s, d):
    return ev(s, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), "ts", "k")


def _backbone(s, d):
    return graph.undirected(hand(ev(s, d)).where("value >= 150"))


@query(
    f"""WITH RECURSIVE {HAND}, t AS (
      SELECT src AS origin, dst AS holder, 1 AS hop, [src, dst] AS path, ts AS last_ts, [event_id] AS evidence FROM hand WHERE value >= 150 AND src <> dst
      UNION ALL SELECT t.origin, h.dst, t.hop + 1, list_append(t.path, h.dst), h.ts, list_append(t.evidence, h.event_id)
      FROM t JOIN hand h ON h.src = t.holder AND h.ts > t.last_ts AND h.ts <= t.last_ts + INTERVAL 120 MINUTE AND NOT list_contains(t.path, h.dst) AND h.src <> h.dst WHERE t.hop < 3)
    SELECT origin, holder, hop, array_to_string(path, '>') AS path, epoch_us(last_ts) AS last_us, 'DERIVED' AS tier, array_to_string(evidence, ',') AS evidence FROM t"""
)
def layering_trace(s, d):
    h = hand(ev(s, d))
    t = finance.trace(h, h.where("value >= 150"), 7200, 3)
    return t.select("origin", "holder", "hop", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.unix_micros("last_ts").alias("last_us"), "tier", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query(f"WITH {EV} SELECT k, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n_sims, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM ev GROUP BY ALL HAVING count(DISTINCT user_id) >= 8")
def burner_devices(s, d):
    e = ev(s, d).withColumn("day", F.to_date("ts"))
    return telecom.sims_per_device(e, "k", "user_id", 8, "day").select("k", "day", "n_sims", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


SCENES = [(1, range(0, 10), 3), (2, range(20, 30), 10), (3, range(40, 50), 17)]
IN_SCENE = " UNION ALL ".join(f"SELECT user_id, {n} AS scene FROM ev WHERE k BETWEEN {r[0]} AND {r[-1]} AND ts >= DATE '2024-01-01' + {day - 1} AND ts < DATE '2024-01-01' + {day + 2}" for n, r, day in SCENES)


def _scenes(s):
    rows = [(n, c, f"2024-01-{day:02} 00:00:00", f"2024-01-{day + 3:02} 00:00:00") for n, r, day in SCENES for c in r]
    return s.createDataFrame(rows, "scene int, cell int, start string, end string").withColumn("start", F.to_timestamp("start")).withColumn("end", F.to_timestamp("end"))


@query(f"WITH {EV}, x AS ({IN_SCENE}) SELECT user_id, count(DISTINCT scene) AS scenes_hit FROM x GROUP BY user_id HAVING count(DISTINCT scene) = 3")
def tower_intersection(s, d):
    return telecom.tower_intersection(ev(s, d), _scenes(s), "user_id", "k")


@query(f"WITH {EV}, x AS ({IN_SCENE}) SELECT user_id, count(DISTINCT scene) AS scenes_hit FROM x GROUP BY user_id HAVING count(DISTINCT scene) >= 2")
def tower_two_of_three(s, d):
    return telecom.tower_intersection(ev(s, d), _scenes(s), "user_id", "k", 2)


@query(f"WITH {EV} SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days_seen FROM ev WHERE k < 10 GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) >= 10")
def resident_baseline(s, d):
    return telecom.residents(ev(s, d).where("k < 10"), "user_id", 10)


@query(f"""WITH {EV}, x AS ({IN_SCENE}), h AS (SELECT user_id, count(DISTINCT scene) AS scenes_hit FROM x GROUP BY user_id HAVING count(DISTINCT scene) >= 2),
    r AS (SELECT user_id FROM ev WHERE k < 10 GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) >= 8) SELECT user_id, scenes_hit FROM h WHERE user_id NOT IN (SELECT user_id FROM r) ORDER BY scenes_hit DESC, user_id LIMIT 3""")
def suspect_shortlist(s, d):
    e = ev(s, d)
    return telecom.shortlist(telecom.drop_residents(telecom.tower_intersection(e, _scenes(s), "user_id", "k", 2), e.where("k < 10"), "user_id", 8), "user_id", 3)


@query(f"""WITH {EV} SELECT x.user_id AS a, y.user_id AS b, count(*) AS n_meets, epoch_us(min(least(x.ts, y.ts))) AS first_us, epoch_us(max(greatest(x.ts, y.ts))) AS last_us
    FROM ev x JOIN ev y ON x.k = y.k AND x.user_id < y.user_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 900000000 GROUP BY ALL""")
def colocation_pairs(s, d):
    return telecom.colocated(_meets(s, d), "k").select("a", "b", "n_meets", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query(f"WITH {BACKBONE} SELECT x.b AS a, y.b AS b, x.a AS via FROM n x JOIN n y ON x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = x.b AND e.b = y.b)")
def common_intermediaries(s, d):
    return telecom.intermediaries(_backbone(s, d))


@query(f"""WITH {EV}, p AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'purchase'), v AS (SELECT event_id AS match_id, user_id AS u, ts AS mts FROM ev WHERE event_type = 'view'),
    j AS (SELECT p.*, v.match_id, v.mts, row_number() OVER (PARTITION BY p.event_id ORDER BY v.mts DESC, v.match_id DESC) AS r FROM p JOIN v ON p.user_id = v.u AND (v.mts < p.ts OR (v.mts = p.ts AND v.match_id <= p.event_id)))
    SELECT event_id, user_id, match_id, epoch_us(ts) - epoch_us(mts) AS gap_us FROM j WHERE r = 1""")
def asof_view_before_purchase(s, d):
    e = ev(s, d).select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    l, r = e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")
    m = telecom.asof(l, r, "user_id", ["id"]).where("match_id is not null")
    return m.select(F.col("id").alias("event_id"), "user_id", "match_id", (F.unix_micros("ts") - F.unix_micros("match_ts")).alias("gap_us"))


@query(f"""WITH {EV}, a AS (SELECT event_id AS id, ts, k FROM ev WHERE event_type = 'click'), b AS (SELECT event_id AS id, ts, k FROM ev WHERE event_type = 'view'),
    p AS (SELECT a.id AS i, b.id AS j FROM a JOIN b ON a.k = b.k AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000)
    SELECT id, coalesce(j, -1) AS id2, CASE WHEN j IS NULL THEN 'only_left' ELSE 'matched' END AS status FROM a LEFT JOIN p ON a.id = p.i UNION ALL SELECT -1, id, 'only_right' FROM b WHERE id NOT IN (SELECT j FROM p)""")
def extraction_reconciliation(s, d):
    e = ev(s, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), "ts", "k", "event_type")
    r = telecom.reconcile(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), "k", 600)
    return r.select(F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("id2", F.lit(-1)).alias("id2"), "status")


@query(f"""WITH {EV}, w AS (SELECT event_id AS id, user_id, ts AS s, ts + INTERVAL 90 MINUTE AS e, event_type FROM ev) SELECT a.id AS id, b.id AS id2 FROM w a JOIN w b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def session_overlaps(s, d):
    w = ev(s, d).select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 90 minutes")).alias("end"), "event_type")
    return telecom.overlap_join(w.where("event_type = 'click'"), w.where("event_type = 'purchase'"), "user_id").select("id", "id2")


@query(f"WITH {EV} SELECT user_id, event_id AS id, row_number() OVER w AS seq, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0 AS gap_s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def case_timeline(s, d):
    return telecom.timeline(ev(s, d).select("user_id", F.col("event_id").alias("id"), "ts"), "user_id").select("user_id", "id", F.col("seq").cast("bigint").alias("seq"), "gap_s")


@query(f"WITH {EV} SELECT k, count(DISTINCT user_id) AS n_holders FROM ev GROUP BY k HAVING count(DISTINCT user_id) >= 60")
def shared_identity_documents(s, d):
    return telecom.shared_documents(ev(s, d), "k", "user_id", 60)


@query("SELECT c_custkey, substr(ltrim(regexp_extract(c_name, '\\d+$'), '0'), 1, 1) AS prefix, 'INFERRED' AS tier FROM customer WHERE substr(ltrim(regexp_extract(c_name, '\\d+$'), '0'), 1, 1) IN ('1', '7')")
def virtual_number_prefixes(s, d):
    c = table(s, d, "customer").withColumn("number", F.regexp_extract("c_name", r"\d+$", 0))
    return telecom.flag_prefix(c, "number", ["1", "7"]).select("c_custkey", "prefix", "tier")


FENCE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(20.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * pow(sin((radians(77.0) - radians(lon)) / 2), 2))))"


@query(f"WITH f AS (SELECT event_id, 19.5 + (event_id % 997) / 997.0 AS lat, 76.5 + (event_id % 1009) / 1009.0 AS lon FROM events) SELECT event_id, CAST(round({FENCE}) AS BIGINT) AS metres FROM f WHERE {FENCE} <= 20000")
def geofence(s, d):
    e = ev(s, d).select("event_id", (F.lit(19.5) + F.col("event_id") % 997 / F.lit(997.0)).alias("lat"), (F.lit(76.5) + F.col("event_id") % 1009 / F.lit(1009.0)).alias("lon"))
    return telecom.within_fence(e, 20.0, 77.0, 20_000).select("event_id", F.round("metres").cast("bigint").alias("metres"))


@query(f"""WITH {EV} SELECT * FROM (SELECT event_id, user_id, count(*) OVER w AS n, sum(CAST(value AS DECIMAL(18,2))) OVER w AS total, 'INFERRED' AS tier FROM ev WHERE value < 49
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)) WHERE n >= 4 AND total >= 98""")
def smurfing_24h(s, d):
    return finance.structuring(ev(s, d), "user_id", 49).select("event_id", "user_id", "n", "total", "tier")


@query(f"""WITH {HAND}, t AS (SELECT * FROM hand WHERE value >= 150 AND src <> dst) SELECT x.event_id, x.src, count(DISTINCT y.dst) AS n_parties FROM t x JOIN t y ON x.src = y.src AND y.ts <= x.ts AND y.ts >= x.ts - INTERVAL 72 HOUR GROUP BY ALL HAVING count(DISTINCT y.dst) >= 4""")
def fan_out_72h(s, d):
    t = hand(ev(s, d)).where("value >= 150 and src <> dst")
    return finance.fan(t, "src", "dst", 72, 4).select("event_id", "src", F.col("n_parties").cast("bigint").alias("n_parties"))


@query(f"WITH {EV}, x AS (SELECT DISTINCT user_id, k FROM ev WHERE value >= 150), few AS (SELECT k FROM x GROUP BY k HAVING count(*) BETWEEN 2 AND 40) SELECT x.user_id AS a, y.user_id AS b, count(*) AS shared FROM x JOIN x y ON x.k = y.k AND x.user_id < y.user_id WHERE x.k IN (SELECT k FROM few) GROUP BY ALL HAVING count(*) >= 2")
def shared_attributes(s, d):
    return finance.shared_attributes(ev(s, d).where("value >= 150"), "user_id", "k", 40, 2)


@query("""SELECT n_name, sum(CAST(CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice END AS DECIMAL(18,2))) AS "1995", sum(CAST(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END AS DECIMAL(18,2))) AS "1996"
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def flow_matrix(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return finance.flow_matrix(o.withColumn("y", F.year("o_orderdate")), "n_name", "y", [1995, 1996], "o_totalprice")


@query("SELECT l_returnflag, count(*) AS n, round(quantile_cont(epoch_us(l_shipdate) / 1e6 - epoch_us(o_orderdate) / 1e6, 0.5), 3) AS median_s, round(quantile_cont(epoch_us(l_shipdate) / 1e6 - epoch_us(o_orderdate) / 1e6, 0.9), 3) AS p90_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def freeze_delay(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("a", F.col("o_orderdate").cast("timestamp")).withColumn("b", F.col("l_shipdate").cast("timestamp"))
    return finance.delay_stats(j, "a", "b", "l_returnflag").select("l_returnflag", "n", F.round("median_s", 3).alias("median_s"), F.round("p90_s", 3).alias("p90_s"))


@query(f"""WITH RECURSIVE {HAND}, w AS (SELECT src AS id FROM hand GROUP BY src ORDER BY src LIMIT 10), t AS (
      SELECT src AS origin, dst AS holder, 1 AS hop, [src, dst] AS path, ts AS last_ts FROM hand WHERE value >= 200 AND src <> dst
      UNION ALL SELECT t.origin, h.dst, t.hop + 1, list_append(t.path, h.dst), h.ts FROM t JOIN hand h ON h.src = t.holder AND h.ts > t.last_ts AND h.ts <= t.last_ts + INTERVAL 120 MINUTE AND NOT list_contains(t.path, h.dst) AND h.src <> h.dst WHERE t.hop < 3)
    SELECT origin, holder, hop, array_to_string(path, '>') AS path FROM t WHERE holder IN (SELECT id FROM w)""")
def crypto_off_ramp(s, d):
    h = hand(ev(s, d))
    wallets = h.select(F.col("src").alias("id")).distinct().orderBy("id").limit(10)
    return finance.trace(h, h.where("value >= 200"), 7200, 3, wallets).select("origin", "holder", "hop", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH {BACKBONE} SELECT a AS id, count(*) AS degree FROM n GROUP BY a")
def degree(s, d):
    return graph.degree(_backbone(s, d))


def _rank_sql(rounds: int) -> str:
    steps = [f"r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS rank FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS (SELECT coalesce(sum(rank), 0) AS m FROM r{i - 1} WHERE id NOT IN (SELECT src FROM g)), r{i} AS (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(x.s, 0) + (SELECT m FROM d{i}) / (SELECT count(*) FROM v)) AS rank FROM v LEFT JOIN (SELECT dst, sum(p * rank) AS s FROM g JOIN r{i - 1} ON src = id GROUP BY dst) x ON x.dst = v.id)")
    return ", ".join(steps)


@query(f"""WITH {HAND}, g0 AS (SELECT src, dst, sum(1.0) AS w FROM hand WHERE value >= 150 GROUP BY ALL), g AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM g0), v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), {_rank_sql(10)} SELECT id, round(rank, 6) AS rank FROM r10""")
def pagerank_k(s, d):
    e = hand(ev(s, d)).where("value >= 150").select("src", "dst", F.lit(1.0).alias("weight"))
    return graph.pagerank(e, rounds=10).select("id", F.round("rank", 6).alias("rank"))


BIPARTITE = EV + ", e AS (SELECT DISTINCT least(user_id, k + 1000000) AS a, greatest(user_id, k + 1000000) AS b FROM ev)"


@query(f"WITH RECURSIVE {BIPARTITE}, n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS id, a AS c FROM n UNION SELECT r.id, n.b FROM r JOIN n ON r.c = n.a) SELECT id, min(c) AS component FROM r GROUP BY id")
def components(s, d):
    e = ev(s, d).select(F.col("user_id").alias("a"), (F.col("k") + 1_000_000).cast("bigint").alias("b"))
    return graph.components(e)


@query(f"WITH RECURSIVE {BIPARTITE}, n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS id, a AS c FROM n UNION SELECT r.id, n.b FROM r JOIN n ON r.c = n.a), x AS (SELECT id, min(c) AS c FROM r GROUP BY id), z AS (SELECT id, c, count(CASE WHEN id < 1000000 THEN 1 END) OVER (PARTITION BY c) AS n_numbers FROM x) SELECT CASE WHEN id < 1000000 THEN 'sim' ELSE 'device' END AS kind, CAST(CASE WHEN id < 1000000 THEN id ELSE id - 1000000 END AS VARCHAR) AS member, n_numbers FROM z WHERE n_numbers >= 2")
def identity_clusters(s, d):
    return telecom.identity_clusters(ev(s, d), "k", "user_id", 2).select("kind", "member", "n_numbers")


@query(f"""WITH {BACKBONE}, deg AS (SELECT a, count(*) AS d FROM n GROUP BY a), w2 AS (SELECT x.b AS p, y.b AS q, count(*) AS c FROM n x JOIN n y ON x.a = y.a GROUP BY ALL), w3 AS (SELECT w2.p, n.b AS q, sum(c) AS c FROM w2 JOIN n ON w2.q = n.a GROUP BY ALL),
    two AS (SELECT x.b AS p, y.b AS q, count(*) AS cn, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS aa FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN deg ON deg.a = x.a GROUP BY ALL)
    SELECT two.p AS a, two.q AS b, cn, round(cn / (dp.d + dq.d - cn), 6) AS jaccard, round(aa, 6) AS adamic_adar, round(0.0025 * cn + 0.000125 * coalesce(w3.c, 0), 6) AS katz FROM two JOIN deg dp ON dp.a = two.p JOIN deg dq ON dq.a = two.q LEFT JOIN w3 ON w3.p = two.p AND w3.q = two.q WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = two.p AND e.b = two.q)""")
def link_prediction(s, d):
    return graph.link_scores(_backbone(s, d)).select("a", "b", "cn", *(F.round(c, 6).alias(c) for c in ("jaccard", "adamic_adar", "katz")))


@query(f"""WITH RECURSIVE {BACKBONE}, r AS (SELECT 1::BIGINT AS id, 0 AS hops, [1::BIGINT] AS path UNION ALL SELECT n.b, r.hops + 1, list_append(path, n.b) FROM r JOIN n ON r.id = n.a WHERE r.hops < 3 AND NOT list_contains(path, n.b)),
    x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops, path) AS i FROM r WHERE EXISTS (SELECT 1 FROM n WHERE n.a = 1)) SELECT id, hops, array_to_string(path, '>') AS path FROM x WHERE i = 1""")
def k_hop_paths(s, d):
    return graph.shortest_paths(_backbone(s, d), 1, 3).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(f"WITH RECURSIVE {BACKBONE}, r AS (SELECT DISTINCT a AS root, a AS id, 0 AS hops FROM n WHERE a % 50 = 0 UNION SELECT r.root, n.b, r.hops + 1 FROM r JOIN n ON r.id = n.a WHERE r.hops < 4) SELECT root, id, min(hops) AS hops FROM r GROUP BY ALL")
def hierarchy_depth(s, d):
    b = _backbone(s, d)
    return graph.depth(b, graph.both_ways(b).select(F.col("a").alias("id")).distinct().where("id % 50 = 0"), 4)


@query(f"WITH {HAND}, e AS (SELECT src, dst, CAST(value AS DECIMAL(18,2)) AS w FROM hand), x AS (SELECT src AS id, w FROM e UNION ALL SELECT dst, w FROM e WHERE src <> dst) SELECT id, count(*) AS degree, sum(w) AS weight FROM x GROUP BY id")
def weighted_degree(s, d):
    return graph.weighted_degree(hand(ev(s, d)).withColumnRenamed("value", "weight"))


@query(f"WITH {HAND}, x AS (SELECT h.*, event_type AS type FROM hand h JOIN ev USING (event_id) WHERE h.value >= 150 AND src <> dst) SELECT p.src AS n0, p.dst AS n1, q.dst AS n2 FROM x p JOIN x q ON p.dst = q.src WHERE p.type = 'click' AND q.type = 'purchase'")
def pattern_match(s, d):
    e = ev(s, d)
    x = hand(e).where("value >= 150 and src <> dst").join(e.select("event_id", F.col("event_type").alias("type")), "event_id")
    return graph.match(x, ["click", "purchase"])


def _between_sql(levels: int) -> str:
    """b: betweenness of all nodes of n, from the numbers of shortest paths of up to so many steps."""
    out = "p0 AS (SELECT DISTINCT a AS s, a AS t, 0 AS d, 1.0::DOUBLE AS c FROM n)"
    for k in range(1, levels + 1):
        out += f", p{k} AS MATERIALIZED (SELECT x.s, n.b AS t, {k} AS d, sum(x.c) AS c FROM (SELECT * FROM p{k - 1} WHERE d = {k - 1}) x JOIN n ON x.t = n.a WHERE NOT EXISTS (SELECT 1 FROM p{k - 1} y WHERE y.s = x.s AND y.t = n.b) GROUP BY ALL UNION ALL SELECT * FROM p{k - 1})"
    p = f"p{levels}"
    return out + f", b AS (SELECT v.id, coalesce(x.b, 0) AS b FROM (SELECT DISTINCT a AS id FROM n) v LEFT JOIN (SELECT x.t AS id, sum(x.c * y.c / z.c) / 2 AS b FROM {p} x JOIN {p} y ON x.t = y.s JOIN {p} z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY x.t) x USING (id))"


@query(f"WITH {BACKBONE}, {_between_sql(6)} SELECT id, round(b, 6) AS betweenness, (SELECT count(*) FROM b)::INT AS n_sources FROM b")
def betweenness_scores(s, d):
    return graph.betweenness(_backbone(s, d)).withColumn("betweenness", F.round("betweenness", 6))


@query()
def louvain_communities(s, d):
    return graph.louvain(_backbone(s, d))


@query(f"WITH {BACKBONE}, {_between_sql(6)}, x AS (SELECT id, round(b, 6) AS betweenness FROM b WHERE id NOT IN (SELECT a FROM n WHERE b % 25 = 0) AND id % 25 <> 0) SELECT id, betweenness, row_number() OVER (ORDER BY betweenness DESC, id)::INT AS rank FROM x QUALIFY rank <= 100")
def insulated_handlers(s, d):
    b = graph.cut_lineage(_backbone(s, d))
    victims = graph.both_ways(b).select(F.col("a").alias("id")).distinct().where("id % 25 = 0")
    scores = graph.betweenness(b).select("id", F.round("betweenness", 6).alias("betweenness"))
    return graph.ranked(graph.insulated(scores, b, victims), "betweenness", 100)


@query(f"WITH {EV}, x AS (SELECT DISTINCT user_id AS key, k % 3 AS dist FROM ev) SELECT p.key, p.dist AS district_a, q.dist AS district_b FROM x p JOIN x q ON p.key = q.key AND p.dist < q.dist")
def cross_jurisdiction(s, d):
    e = ev(s, d).withColumn("dist", F.col("k") % 3)
    return graph.cross_district(e, "user_id", "dist").select("key", "district_a", "district_b")


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def evidence_digests(s, d):
    return evidence.hash_log(table(s, d, "documents"), "doc_id", "text")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_evidence(s, d):
    return table(s, d, "documents").groupBy(fn.sha256("text").alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, sha256(text) = lower(CASE WHEN doc_id % 3 = 0 THEN sha256(text || 'x') ELSE upper(sha256(text)) END) AS ok FROM documents")
def integrity_check(s, d):
    t = table(s, d, "documents").withColumn("expected", F.when(F.col("doc_id") % 3 == 0, fn.sha256(F.concat("text", F.lit("x")))).otherwise(F.upper(fn.sha256("text"))))
    return t.select("doc_id", fn.verified("text", "expected").alias("ok"))


@query("""WITH s AS (SELECT doc_id AS evidence_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT doc_id AS evidence_id, CASE WHEN doc_id % 11 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 13 <> 0)
    SELECT evidence_id, CASE WHEN c.h IS NULL THEN 'MISSING' WHEN s.h IS NULL THEN 'UNKNOWN' WHEN s.h = c.h THEN 'OK' ELSE 'MISMATCH' END AS status FROM s FULL JOIN c USING (evidence_id)""")
def tamper_alerts(s, d):
    t = table(s, d, "documents").withColumnRenamed("doc_id", "evidence_id")
    stored = t.where("evidence_id % 7 <> 0").select("evidence_id", fn.sha256("text").alias("sha256"))
    now = t.where("evidence_id % 13 <> 0").select("evidence_id", F.when(F.col("evidence_id") % 11 == 0, fn.sha256(F.concat("text", F.lit("!")))).otherwise(fn.sha256("text")).alias("sha256"))
    return evidence.verify(stored, now)


MERKLE = "l0 AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, sha256(text) AS h FROM benchmark)" + "".join(f", l{k} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(unhex(max(CASE WHEN i % 2 = 0 THEN h END)) || unhex(max(CASE WHEN i % 2 = 1 THEN h END))) END AS h FROM l{k - 1} GROUP BY i // 2)" for k in range(1, 9))


@query(f"WITH {MERKLE} SELECT h AS root, (SELECT count(*) FROM benchmark) AS n FROM l8")
def merkle_root(s, d):
    return evidence.merkle_root(table(s, d, "benchmark").select("item_id", fn.sha256("text").alias("leaf")), "item_id", "leaf")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, CAST(event_id AS VARCHAR) || ':' || event_type AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    c AS (SELECT user_id, event_id, r, repeat('0', 64) AS prev, sha256(repeat('0', 64) || rec) AS hash FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.r, c.hash, sha256(c.hash || o.rec) FROM c JOIN o ON o.user_id = c.user_id AND o.r = c.r + 1) SELECT user_id, event_id, prev, hash FROM c""")
def audit_chain(s, d):
    e = ev(s, d).withColumn("rec", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    return evidence.chain(e, "user_id", "event_id", "rec").select("user_id", "event_id", "prev", "hash")


@query(f"WITH {MERKLE} SELECT item_id AS evidence_id, sha256(text) AS sha256, (SELECT h FROM l8) AS merkle_root, (SELECT count(*) FROM benchmark) AS n_items, 'BSA 2023 s.63' AS legal_basis FROM benchmark")
def certificate_rows(s, d):
    return evidence.certificate_rows(table(s, d, "benchmark").select(F.col("item_id").alias("evidence_id"), fn.sha256("text").alias("sha256")), "BSA 2023 s.63")


@query("SELECT doc_id FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def digest_lookup(s, d):
    t = table(s, d, "documents").select("doc_id", fn.sha256("text").alias("sha256"))
    wanted = t.where("doc_id = 5").select(F.col("sha256").alias("w")).distinct()
    return t.join(wanted, F.col("sha256") == F.col("w"), "left_semi").select("doc_id")


@query("SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def audit_statistics(s, d):
    return evidence.audit_stats(ev(s, d), "user_id", "event_type")


@query()
def keccak_digests(s, d):
    return table(s, d, "benchmark").select("item_id", fn.keccak256(F.col("text").cast("binary")).alias("keccak256"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS value FROM documents" for k, p in text.PATTERNS.items()))
def extract_contacts(s, d):
    return text.extract(table(s, d, "documents"), "doc_id", "text")


@query("""WITH x AS (SELECT doc_id, len(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin, len(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) AS devanagari, len(regexp_replace(text, '[^஀-௿]', '', 'g')) AS tamil, len(regexp_replace(text, '[^ఀ-౿]', '', 'g')) AS telugu FROM documents)
    SELECT doc_id, CASE greatest(latin, devanagari, tamil, telugu) WHEN 0 THEN 'none' WHEN telugu THEN 'telugu' WHEN tamil THEN 'tamil' WHEN latin THEN 'latin' ELSE 'devanagari' END AS script FROM x""")
def language_routing(s, d):
    return table(s, d, "documents").select("doc_id", text.script_of(F.col("text")).alias("script"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN ('the', 'and', 'for')))), ',') AS hits FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN ('the', 'and', 'for'))) > 0")
def vocabulary_hits(s, d):
    return text.vocabulary_hits(table(s, d, "documents"), "doc_id", "text", ("the", "and", "for")).select("doc_id", F.array_join("hits", ",").alias("hits"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS id, v.vec_id AS neighbour, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank FROM p) SELECT id, neighbour, rank, score FROM r WHERE rank <= 10""")
def mo_topk(s, d):
    v = table(s, d, "embeddings")
    return text.nearest(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM t WHERE w IN ('anon', 'ble', 'reth') GROUP BY ALL), df AS (SELECT w, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY w) SELECT doc_id, count(*) AS n_terms, round(sum(tf * idf), 6) AS score FROM tf JOIN df USING (w) GROUP BY doc_id""")
def lexical_search(s, d):
    return text.lexical_search(table(s, d, "documents"), "doc_id", "text", ["anon", "ble", "reth"])


@query("WITH x AS (SELECT doc_id, md5(text) AS wallet FROM documents) SELECT DISTINCT a.doc_id AS handle, b.doc_id AS person, 'wallet' AS via, 'INFERRED' AS tier FROM x a JOIN x b ON a.wallet = b.wallet WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def link_handles(s, d):
    x = table(s, d, "documents").select("doc_id", F.md5("text").alias("wallet"))
    return text.link_handles(x.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "handle"), x.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "person"), ["wallet"])


@query()
def name_aliases(s, d):
    return text.aliases(table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")), "name", 2)


@query()
def near_duplicate_reports(s, d):
    return text.near_reports(table(s, d, "documents"), "doc_id", "text")


@query(f"WITH {HAND} SELECT src, dst, event_type AS type, count(*) AS n, epoch_us(min(h.ts)) AS first_us, epoch_us(max(h.ts)) AS last_us, sum(CAST(h.value AS DECIMAL(18,2))) AS weight, CASE WHEN max(CASE WHEN h.k % 2 = 0 THEN 1 ELSE 3 END) = 3 THEN 'INFERRED' ELSE 'OBSERVED' END AS tier, array_to_string(list_sort(list(h.event_id)), ',') AS evidence FROM hand h JOIN ev USING (event_id) GROUP BY ALL")
def evidence_fusion(s, d):
    e = ev(s, d)
    x = hand(e).join(e.select("event_id", F.col("event_type").alias("type")), "event_id").withColumnRenamed("value", "weight")
    f = fuse(x.withColumn("tier", F.when(F.col("k") % 2 == 0, "OBSERVED").otherwise("INFERRED")).withColumn("evidence", F.array("event_id")))
    return f.select("src", "dst", "type", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), F.col("weight"), "tier", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query(f"WITH {EV}, x AS (SELECT k, count(DISTINCT user_id) AS n, min(event_id) AS e FROM ev GROUP BY k) SELECT 'device ' || k || ' was used by ' || n || ' numbers' AS reason, e AS evidence, 'GENERATED' AS tier FROM x")
def plain_reasons(s, d):
    x = ev(s, d).groupBy("k").agg(F.countDistinct("user_id").alias("n"), F.min("event_id").alias("evidence"))
    return evidence.explain(x, "device %d was used by %d numbers", "k", "n")


# Generic relational categories.
@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def rel_aggregate(s, d):
    m = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return table(s, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(m("l_quantity").alias("sum_qty"), m("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


@query("SELECT n_name, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def rel_joins(s, d):
    t = lambda n: table(s, d, n)
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))).alias("revenue"))


@query("SELECT coalesce(n_name, 'none') AS n_name, count(c_custkey) AS customers, count(s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey GROUP BY ALL")
def rel_outer_joins(s, d):
    n, c, p = table(s, d, "nation"), table(s, d, "customer").where("c_acctbal > 9000"), table(s, d, "supplier").where("s_acctbal > 9000")
    j = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(p, F.col("s_nationkey") == F.col("n_nationkey"), "full_outer")
    return j.groupBy(F.coalesce("n_name", F.lit("none")).alias("n_name")).agg(F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def rel_semi_anti(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    have = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    big = o.where("o_totalprice > 200000")
    return have.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", F.lit(True).alias("big")).unionByName(have.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit(False).alias("big")))


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def rel_self_join(s, d):
    n = table(s, d, "nation")
    b = n.select(F.col("n_name").alias("n2"), F.col("n_regionkey").alias("r2"), F.col("n_nationkey").alias("k2"))
    return n.join(b, (F.col("n_regionkey") == F.col("r2")) & (F.col("n_nationkey") < F.col("k2"))).select(F.col("n_name").alias("n1"), "n2")


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(s, d):
    return table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("SELECT c_custkey, c_nationkey, rank() OVER w AS r, dense_rank() OVER w AS dr, first_value(c_custkey) OVER w AS top, sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)")
def rel_windows(s, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(s, d, "customer").select("c_custkey", "c_nationkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.first("c_custkey").over(w).alias("top"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).over(w.rowsBetween(-2, 0)).alias("last3"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def rel_set_operations(s, d):
    c = table(s, d, "customer")
    k = lambda x: x.select(F.col("c_custkey").alias("k"))
    return table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(k(c.where("c_acctbal > 0"))).exceptAll(k(c.where("c_mktsegment = 'BUILDING'")))


@query("SELECT p_partkey, upper(trim(p_name)) AS name, length(p_name) AS len, split_part(p_type, ' ', 1) AS first_word, regexp_replace(p_brand, '[0-9]+', '#') AS brand FROM part")
def rel_strings(s, d):
    return table(s, d, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.length("p_name").cast("bigint").alias("len"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"), F.regexp_replace("p_brand", "[0-9]+", "#").alias("brand"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days_to_2000 FROM orders")
def rel_dates(s, d):
    return table(s, d, "orders").select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")).cast("bigint").alias("days_to_2000"))


@query("SELECT o_custkey, len(list(o_orderkey)) AS n, list_max(list(o_orderkey)) AS last_order, list_sum(list_transform(list(o_orderkey), lambda x: x % 10)) AS s FROM orders GROUP BY o_custkey")
def rel_arrays(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("o"))
    return g.select("o_custkey", F.size("o").cast("bigint").alias("n"), F.array_max("o").alias("last_order"), F.aggregate("o", F.lit(0).cast("bigint"), lambda a, x: a + x % 10).alias("s"))


@query(f"""WITH {EV}, f AS (SELECT event_id AS id, ts, k, event_type, 19.5 + (event_id % 97) / 97.0 AS lat, 76.5 + (event_id % 101) / 101.0 AS lon FROM ev), p AS (SELECT x.id, y.id AS match_id, {{m}} AS metres,
    row_number() OVER (PARTITION BY x.id ORDER BY abs(epoch_us(x.ts) - epoch_us(y.ts)), (y.ts, y.id) > (x.ts, x.id), CASE WHEN (y.ts, y.id) > (x.ts, x.id) THEN y.id ELSE -y.id END) AS r FROM f x JOIN f y ON x.k = y.k AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 7200000000 WHERE x.event_type = 'purchase' AND y.event_type = 'view') SELECT id, match_id, CAST(round(metres) AS BIGINT) AS metres FROM p WHERE r = 1 AND metres <= 60000""".format(
    m="2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(y.lat) - radians(x.lat)) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin((radians(y.lon) - radians(x.lon)) / 2), 2))))"
))
def satellite_ground(s, d):
    e = ev(s, d).select(F.col("event_id").alias("id"), "ts", "k", "event_type", (F.lit(19.5) + F.col("event_id") % 97 / F.lit(97.0)).alias("lat"), (F.lit(76.5) + F.col("event_id") % 101 / F.lit(101.0)).alias("lon"))
    m = telecom.sat_ground_match(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), "k", 7200, 60_000)
    return m.select("id", "match_id", F.round("metres").cast("bigint").alias("metres"))


@query(f"WITH {EV} SELECT x.user_id AS a, y.user_id AS b, count(*) AS n_meets, epoch_us(min(least(x.ts, y.ts))) AS first_us, epoch_us(max(greatest(x.ts, y.ts))) AS last_us FROM ev x JOIN ev y ON x.k = y.k AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 900000000 WHERE x.event_type = 'purchase' AND y.event_type = 'view' GROUP BY ALL HAVING count(*) >= 1")
def plate_phone_paths(s, d):
    e = ev(s, d)
    who = lambda kind: e.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), "ts", "k")
    m = telecom.seen_together(who("purchase"), who("view"), "k", 900)
    return m.select("a", "b", "n_meets", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query(f"WITH RECURSIVE {EV}, x AS (SELECT DISTINCT user_id, k FROM ev WHERE value >= 150), few AS (SELECT k FROM x GROUP BY k HAVING count(*) BETWEEN 2 AND 40), p AS (SELECT x.user_id AS a, y.user_id AS b FROM x JOIN x y ON x.k = y.k AND x.user_id < y.user_id WHERE x.k IN (SELECT k FROM few) GROUP BY ALL HAVING count(*) >= 3), n AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS c FROM n UNION SELECT r.id, n.b FROM r JOIN n ON r.c = n.a) SELECT id, min(c) AS component FROM r GROUP BY id")
def handler_clusters(s, d):
    return finance.handler_clusters(ev(s, d).where("value >= 150"), "user_id", "k", 40, 3)


@query(f"""WITH {HAND} SELECT src % 5 AS payer, dst % 5 AS payee, sum(CAST(CASE WHEN k % 3 = 0 THEN value END AS DECIMAL(18,2))) AS "0", sum(CAST(CASE WHEN k % 3 = 1 THEN value END AS DECIMAL(18,2))) AS "1", sum(CAST(CASE WHEN k % 3 = 2 THEN value END AS DECIMAL(18,2))) AS "2" FROM hand GROUP BY ALL""")
def bank_flows(s, d):
    h = hand(ev(s, d)).select((F.col("src") % 5).alias("payer"), (F.col("dst") % 5).alias("payee"), (F.col("k") % 3).alias("layer"), "value")
    return finance.flow_matrix(h, ["payer", "payee"], "layer", [0, 1, 2], "value")


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rel_rollup(s, d):
    return table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def rel_grouping_sets(s, d):
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(s, d, "orders").groupingSets([[a], [b]], a, b).agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("SELECT a.r_name AS r1, b.n_name AS n2 FROM region a CROSS JOIN nation b")
def rel_cross_join(s, d):
    return table(s, d, "region").select(F.col("r_name").alias("r1")).crossJoin(table(s, d, "nation").select(F.col("n_name").alias("n2")))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM orders GROUP BY o_custkey")
def rel_maps(s, d):
    g = table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return g.select("o_custkey", F.size(F.map_keys("m")).cast("bigint").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("F")), F.lit(0)).cast("bigint").alias("f"))


@query("SELECT event_id, epoch_us(strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S') - INTERVAL 330 MINUTE) AS utc_us FROM events")
def rel_zones(s, d):
    e = ev(s, d).select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("t"))
    return e.select("event_id", F.unix_micros(fn.instant(F.col("t"), F.lit("Asia/Kolkata"))).alias("utc_us"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
