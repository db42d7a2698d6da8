import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import functions as fn
from skein import plans, sources
from skein.operators import evidence, finance, graph, telecom, text
from skein.session import Settings

T0 = datetime(2024, 1, 1, 12)
at = lambda s: T0 + timedelta(seconds=s)


def one(df, *exprs):
    return df.select(*exprs).first()


def test_digests_and_verification(spark):
    d = spark.createDataFrame([("abc", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("abc", " ba78"), ("abc", None), (None, "x"), ("", hashlib.sha256(b"").hexdigest()), ("é", hashlib.sha256("é".encode()).hexdigest())], "t string, h string")
    assert [r[0] for r in d.select(fn.verified("t", "h")).collect()] == [True, False, False, False, True, True]
    assert fn.keccak(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert fn.keccak(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    long = bytes(range(256)) * 2
    assert one(spark.createDataFrame([(long,)], "b binary"), fn.keccak256("b"))[0] == fn.keccak(long).hex()


def test_identifiers_tiers_and_zones(spark):
    d = spark.createDataFrame([("35-6938035643809", "0 98765 43210", "2024-01-01 05:30:00")], "imei string, n string, t string")
    r = one(d, fn.device_key(F.col("imei")), fn.msisdn(F.col("n")), fn.instant(F.col("t"), F.lit("Asia/Kolkata")))
    assert r[0] == "35693803564380" and r[1] == "919876543210" and r[2] == datetime(2024, 1, 1)
    bad = spark.createDataFrame([("000000000000000",), ("1234",)], "imei string")
    assert [x[0] for x in bad.select(fn.device_key(F.col("imei"))).collect()] == [None, None]
    t = spark.createDataFrame([("OBSERVED", "INFERRED"), ("DERIVED", "OBSERVED")], "a string, b string")
    assert [x[0] for x in t.select(fn.combine_tiers(F.col("a"), F.col("b"))).collect()] == ["INFERRED", "DERIVED"]


def test_sources_keep_rejects_and_unify(spark, tmp_path):
    (tmp_path / "a.csv").write_text("call_id,a_party,b_party,start,duration,imei,imsi,cell\n1,9876543210,9876543211,2024-01-01 05:30:00,60,356938035643809,404,c1\n2,short line\n")
    (tmp_path / "b.csv").write_text("id,n\n1,2\nx,3\n")
    got, rejects = sources.read_cdr(spark, str(tmp_path / "a.csv"))
    r = got.first()
    assert len(rejects.cache().collect()) == 1
    assert r["start_ts"] == datetime(2024, 1, 1) and r["duration_s"] == 60 and r["tier"] == "OBSERVED" and r["evidence"] == ["1"]
    good, bad = sources.read_csv(spark, str(tmp_path / "b.csv"), {"id": "int", "n": "int"})
    assert good.collect()[0][0] == 1 and bad.cache().count() == 1
    e = spark.createDataFrame([("a", "b", "CALLED", T0, 1.0, "OBSERVED", ["e2"]), ("a", "b", "CALLED", at(5), 2.0, "INFERRED", ["e1"])], "src string, dst string, type string, ts timestamp, weight double, tier string, evidence array<string>")
    f = sources.fuse(e).first()
    assert f["n"] == 2 and f["tier"] == "INFERRED" and f["evidence"] == ["e1", "e2"]
    v = spark.createDataFrame([("a", "Phone", {"x": "1"})], "id string, label string, props map<string,string>")
    sources.write_graph(v, e, str(tmp_path / "g"))
    assert sources.read_graph(spark, str(tmp_path / "g"))[1].count() == 2


def test_burner_threshold_edges(spark):
    rows = [(f"d{n}", f"s{i}", T0) for n in (9, 10, 11) for i in range(n)]
    d = spark.createDataFrame(rows, "imei string, imsi string, ts timestamp")
    assert {r["imei"]: r["n_sims"] for r in telecom.sims_per_device(d, "imei", "imsi").collect()} == {"d10": 10, "d11": 11}


def test_cloned_device_does_not_merge(spark):
    d = spark.createDataFrame([(None, f"s{i}") for i in range(6)] + [("d1", "s1"), ("d1", "s2"), ("d2", "s2")], "imei string, imsi string")
    got = {(r["kind"], r["member"]) for r in telecom.identity_clusters(d, "imei", "imsi", 2).collect()}
    assert got == {("device", "d1"), ("device", "d2"), ("sim", "s1"), ("sim", "s2")}


def test_colocation_window_edges(spark):
    d = spark.createDataFrame([(1, "a", T0, "c"), (2, "b", at(900), "c"), (3, "z", at(901), "c"), (4, "y", at(1), "other")], "id int, who string, ts timestamp, cell string")
    assert {(r["a"], r["b"]) for r in telecom.colocated(d, "cell").collect()} == {("a", "b"), ("b", "z")}


def test_overlap_once_and_asof(spark):
    a = spark.createDataFrame([("k", 1, T0, at(8000))], "k string, id int, start timestamp, end timestamp")
    b = spark.createDataFrame([("k", 2, at(10), at(9000)), ("k", 3, at(8001), at(8002))], "k string, id int, start timestamp, end timestamp")
    assert [r["id2"] for r in telecom.overlap_join(a, b, "k").collect()] == [2]
    l = spark.createDataFrame([(10, "u", at(5)), (11, "u", at(100))], "id int, u string, ts timestamp")
    r = spark.createDataFrame([(1, "u", T0), (2, "u", at(5)), (3, "u", at(50))], "id int, u string, ts timestamp")
    assert {x["id"]: x["match_id"] for x in telecom.asof(l, r, "u", ["id"]).collect()} == {10: 2, 11: 3}
    assert {x["id"]: x["match_id"] for x in telecom.asof(l, r, "u", ["id"], 20).collect()} == {10: 2, 11: None}


def test_trace_is_strict_and_ends(spark):
    rows = [("A", "B", 0, 1), ("B", "C", 10, 2), ("C", "A", 20, 3), ("B", "D", -5, 4), ("B", "E", 0, 5), ("C", "F", 9999, 6)]
    e = spark.createDataFrame([(s, d, at(t), i) for s, d, t, i in rows], "src string, dst string, ts timestamp, event_id int")
    got = {tuple(r["path"]) for r in finance.trace(e, e.where("event_id = 1"), 600, 5).collect()}
    assert got == {("A", "B"), ("A", "B", "C")}


def test_structuring_limit_edges(spark):
    rows = [("x", at(i), v) for i, v in enumerate((48999.99, 48999.99, 48999.99, 49000.0, 49000.01, 48999.99))]
    d = spark.createDataFrame(rows, "acc string, ts timestamp, value double")
    got = finance.structuring(d, "acc", 49000).collect()
    assert len(got) == 1 and got[0]["n"] == 4


def test_shared_attributes_cap(spark):
    d = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "hub"), ("b", "hub"), ("c", "hub")], "acc string, v string")
    assert [tuple(r) for r in finance.shared_attributes(d, "acc", "v", 2).collect()] == [("a", "b", 1)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_graph_known_answers(spark):
    path = edges(spark, [(1, 2), (2, 3)])
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(path).collect()} == {1: 0, 2: 1, 3: 0}
    star = edges(spark, [(0, i) for i in range(1, 6)])
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(star).collect()}[0] == 10
    chain = edges(spark, [(i, i + 1) for i in range(40)] + [(100, 101)])
    got = {r["id"]: r["component"] for r in graph.components(chain).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    clique = lambda o: [(o + i, o + j) for i in range(5) for j in range(i + 1, 5)]
    two = clique(0) + clique(10) + [(4, 10)]
    a = {r["id"]: r["community"] for r in graph.louvain(edges(spark, two)).collect()}
    b = {r["id"]: r["community"] for r in graph.louvain(edges(spark, two[::-1])).collect()}
    assert a == b and {a[i] for i in range(5)} == {0} and {a[i] for i in range(10, 15)} == {10}
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 3, 1.0)], "src long, dst long, weight double")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(e).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] == max(ranks.values())
    assert {r["id"]: r["hops"] for r in graph.k_hop(path, 1, 5).collect()} == {1: 0, 2: 1, 3: 2}
    s = {(r["a"], r["b"]): r for r in graph.link_scores(edges(spark, [(1, 2), (2, 3), (3, 4)])).collect()}
    assert s[1, 3]["cn"] == 1 and s[1, 3]["jaccard"] == 0.5 and (1, 2) not in s


def test_betweenness_by_pairs(spark):
    """Of all pairs, the share of shortest paths through a node; a dense part, trees, a path and components, however sources are batched."""
    import itertools
    import random

    r = random.Random(5)
    e = {(a, b) for a, b in itertools.combinations(range(14), 2) if r.random() < 0.5} | {(i, i + 1) for i in range(13, 30)} | {(r.randrange(10), i) for i in range(31, 40)} | {(50, 51), (51, 52)}
    ids = sorted({v for p in e for v in p})
    near = {v: [a + b - v for a, b in e if v in (a, b)] for v in ids}
    far, paths = {}, {}
    for s in ids:
        far[s, s], paths[s, s], level = 0, 1, [s]
        while level:
            new: dict = {}
            for v, w in ((v, w) for v in level for w in near[v] if (s, w) not in far):
                new[w] = new.get(w, 0) + paths[s, v]
            for w, n in new.items():
                far[s, w], paths[s, w] = far[s, level[0]] + 1, n
            level = list(new)
    want = {v: sum(paths[s, v] * paths[v, t] / paths[s, t] for s, t in far if s < t and v not in (s, t) and (s, v) in far and far[s, v] + far[v, t] == far[s, t]) for v in ids}
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(edges(spark, sorted(e))).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in ids)
    at = {v: i for i, v in enumerate(ids)}
    a, b = (np.array([at[p[i]] for p in sorted(e)]) for i in (0, 1))
    for states in (1, 3 * len(ids), 10_000):
        sums = graph.Dependencies(a, b, len(ids), states).sums(np.arange(len(ids)))
        assert np.allclose(sums / 2, [want[v] for v in ids])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_merkle_shapes(spark, n):
    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n)]

    def root(level):
        while len(level) > 1:
            level = [hashlib.sha256(bytes.fromhex(level[i]) + bytes.fromhex(level[i + 1])).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    d = lambda x: spark.createDataFrame(list(enumerate(x))[::-1], "i int, h string")
    assert evidence.merkle_root(d(leaves), "i", "h").first()["root"] == root(leaves)
    assert evidence.merkle_root(d(leaves[:-1] + ["0" * 64]), "i", "h").first()["root"] != root(leaves)


def test_chain_and_tamper(spark):
    d = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a")], "case string, seq int, rec string")
    got = evidence.chain(d, "case", "seq", "rec").orderBy("seq").collect()
    assert got[0]["hash"] == hashlib.sha256(("0" * 64 + "a").encode()).hexdigest() and got[1]["prev"] == got[0]["hash"]
    s = spark.createDataFrame([(1, "AA"), (2, "bb"), (3, "cc"), (5, None)], "evidence_id int, sha256 string")
    c = spark.createDataFrame([(1, "aa"), (2, "xx"), (4, "dd"), (5, "ee")], "evidence_id int, sha256 string")
    assert {r[0]: r[1] for r in evidence.verify(s, c).collect()} == {1: "OK", 2: "MISMATCH", 3: "MISSING", 4: "UNKNOWN", 5: "MISMATCH"}


def test_text_rules(spark):
    d = spark.createDataFrame([(1, "Call +91 98765 43210 or a@b.co, plate MH 12 AB 1234, section 302"), (2, "कोई नहीं"), (3, "123")], "id int, t string")
    got = {(r["kind"], r["value"]) for r in text.extract(d, "id", "t").collect()}
    assert ("email", "a@b.co") in got and ("plate", "MH 12 AB 1234") in got
    assert [r[0] for r in d.orderBy("id").select(text.script_of(F.col("t"))).collect()] == ["latin", "devanagari", "none"]
    assert text.aliases(spark.createDataFrame([("Robert",), ("Rupert",), ("Zed",)], "n string"), "n").first()["distance"] == 2


def test_tasks_questions_settings(spark):
    done = plans.run_tasks({"b": (["a"], lambda a: a.where("id > 1")), "a": ([], lambda: spark.range(4)), "c": (["a", "b"], lambda a, b: a.join(b, "id"))})
    assert list(done) == ["a", "b", "c"] and done["c"].count() == 2
    with pytest.raises(LookupError):
        plans.ask("who is guilty")
    assert Settings.from_env({"SKEIN_MOCK_LEDGER": "false"}).mock_ledger is False


def test_live_structuring(spark, tmp_path):
    from skein.streaming import live_structuring

    src = tmp_path / "in"
    spark.createDataFrame([("x", at(i), 40.0) for i in range(5)] + [("y", at(900_000), 1.0)], "acc string, ts timestamp, value double").write.parquet(str(src))
    s = spark.readStream.schema("acc string, ts timestamp, value double").parquet(str(src))
    q = live_structuring(s, "acc", 49).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["acc"] for r in spark.sql("select acc from live").collect()} == {"x"}


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 38


def test_empty_and_odd_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert graph.pagerank(none).collect() == [] and graph.weighted_degree(none).collect() == []
    e = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 2, 3.0), (None, 2, 1.0)], "src long, dst long, weight double")
    assert sorted(map(tuple, graph.weighted_degree(e).collect())) == [(1, 3, 8), (2, 2, 6)]
    p = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
    assert {r["id"]: r["path"] for r in graph.shortest_paths(p, 1, 5).collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 2, 4], 5: [1, 2, 4, 5]}
    assert {(r["root"], r["id"]): r["hops"] for r in graph.depth(p, edges(spark, [(5, 0), (77, 0)]).select(F.col("a").alias("id")), 2).collect()} == {(5, 5): 0, (5, 4): 1, (5, 2): 2, (5, 3): 2}


def test_satellite_takes_the_nearer_ground_fix(spark):
    kind = "id int, who string, ts timestamp, lat double, lon double"
    sat = spark.createDataFrame([(1, "u", at(0), 1.0, 1.0), (2, "u", at(100), 1.0, 1.0), (3, "u", at(500), 1.0, 1.0)], kind)
    ground = spark.createDataFrame([(7, "u", at(4), 1.0, 1.0), (8, "u", at(90), 1.0, 1.0), (9, "u", at(108), 1.0, 1.0), (10, "u", at(501), 9.0, 9.0)], kind)
    assert {r["id"]: r["match_id"] for r in telecom.sat_ground_match(sat, ground, "who", 60, 500).collect()} == {1: 7, 2: 9}


def test_nearest_takes_queries_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0 + i % 3]) for i in range(60)], "id long, v array<float>")
    q = v.where("id % 4 = 0")
    few, many = text.nearest(v, q, "id", "v", 5), text.nearest(v, q, "id", "v", 5, block=4)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() == 15 * 5
    assert "CartesianProduct" in many._jdf.queryExecution().toString()
