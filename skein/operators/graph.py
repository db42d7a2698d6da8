"""Graph operators over edge tables. Loops cut their lineage with tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to, and read from, the folder in spark.checkpoint.dir; a temporary one is set where there is none."""
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", root)
    path, schema = f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """a < b, each pair once, no loops, no nulls."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degree(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """id, degree (edges at it, repeated ones counted), weight (their sum) of every node of src, dst, weight; loops count once."""
    loop = F.col("src") == F.col("dst")
    e = edges.where("src is not null and dst is not null")
    ends = e.select(F.col("src").alias("id"), "weight").unionByName(e.where(~loop).select(F.col("dst").alias("id"), "weight"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum(F.col("weight").cast("decimal(18,2)")).alias("weight"))


def pagerank(edges: DataFrame, d: float = 0.85, rounds: int = 20, cut_every: int = 5) -> DataFrame:
    """id, rank after a fixed number of rounds; edges src, dst, weight. Dangling mass goes to all; ranks sum to 1."""
    e = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = e.groupBy(F.col("src").alias("s")).agg(F.sum("w").alias("sum_w"))
    e = cut_lineage(e.join(out, F.col("src") == F.col("s")).select("src", "dst", (F.col("w") / F.col("sum_w")).alias("p")))
    nodes = cut_lineage(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct().join(e.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(1)), "id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    r = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        dangling = r.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d"))
        into = e.join(r.select("id", "rank"), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("into"))
        r = nodes.join(into, F.col("id") == F.col("dst"), "left").join(F.broadcast(dangling))  # one row
        r = r.select("id", "out", ((1 - d) / n + d * (F.coalesce("into", F.lit(0.0)) + F.col("d") / n)).alias("rank"))
        if k % cut_every == 0:
            r = cut_lineage(r)
    return r.select("id", "rank")


def components(e: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the least id) of an edge table a, b: every round ties nodes to the least node two steps away."""
    e = cut_lineage(undirected(e, "a", "b"))
    before = None
    for _ in range(most_rounds):
        pairs = both_ways(e)
        least = pairs.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = pairs.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = up.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        tied = up.join(low, F.col("b") == F.col("u"))
        e = cut_lineage(tied.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(tied.select(F.col("m").alias("a"), "b")).where("a < b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def link_scores(e: DataFrame, beta: float = 0.05) -> DataFrame:
    """a, b, cn, jaccard, adamic_adar, katz (paths of two and three steps) of pairs that are not neighbours."""
    n = both_ways(e)
    deg = n.groupBy(F.col("a").alias("x")).agg(F.count("*").alias("deg"))
    first = n.select(F.col("a").alias("via"), F.col("b").alias("p"))
    second = n.select(F.col("a").alias("via2"), F.col("b").alias("q"))
    two = first.join(second, (F.col("via") == F.col("via2")) & (F.col("p") != F.col("q"))).join(deg, F.col("via") == F.col("x"))
    two = two.groupBy("p", "q").agg(F.count("*").alias("cn"), F.sum(F.when(F.col("deg") > 1, 1 / F.log("deg")).otherwise(0.0)).alias("adamic_adar"))
    # A walk of three steps: two to r and one on; p = r walks are there too, as in the matrix power.
    steps = first.join(second, F.col("via") == F.col("via2")).groupBy("p", "q").agg(F.count("*").alias("w2"))
    three = steps.join(n.select(F.col("a").alias("r"), F.col("b").alias("z")), F.col("q") == F.col("r")).groupBy(F.col("p").alias("p3"), F.col("z").alias("q3")).agg(F.sum("w2").alias("w3"))
    j = two.where("p < q").join(e.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"], "left_anti")
    j = j.join(three, (F.col("p") == F.col("p3")) & (F.col("q") == F.col("q3")), "left")
    j = j.join(deg.select(F.col("x").alias("p"), F.col("deg").alias("dp")), "p").join(deg.select(F.col("x").alias("q"), F.col("deg").alias("dq")), "q")
    katz = beta**2 * F.col("cn") + beta**3 * F.coalesce("w3", F.lit(0))
    return j.select(F.col("p").alias("a"), F.col("q").alias("b"), "cn", (F.col("cn") / (F.col("dp") + F.col("dq") - F.col("cn"))).alias("jaccard"), "adamic_adar", katz.alias("katz"))


def k_hop(e: DataFrame, src, k: int) -> DataFrame:
    """id, hops: the least number of steps from src to every node within k, by frontier."""
    n = cut_lineage(both_ways(e))
    seen = n.where(F.col("a") == F.lit(src)).select(F.col("a").alias("id")).distinct().withColumn("hops", F.lit(0))
    for hop in range(1, k + 1):
        new = seen.where(F.col("hops") == hop - 1).join(n, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        seen = cut_lineage(seen.unionByName(new.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))))
    return seen


def shortest_paths(e: DataFrame, src, k: int) -> DataFrame:
    """id, hops, path of every node within k steps of src: the least of its shortest paths, by frontier."""
    n = cut_lineage(both_ways(e))
    seen = n.where(F.col("a") == F.lit(src)).select(F.col("a").alias("id")).distinct().select("id", F.lit(0).alias("hops"), F.array("id").alias("path"))
    for hop in range(1, k + 1):
        new = seen.where(F.col("hops") == hop - 1).join(n, F.col("id") == F.col("a")).groupBy("b").agg(F.min("path").alias("path")).select(F.col("b").alias("id"), F.lit(hop).alias("hops"), F.concat("path", F.array("b")).alias("path"))
        seen = cut_lineage(seen.unionByName(new.join(seen.select("id"), "id", "left_anti")))
    return seen


def depth(e: DataFrame, roots: DataFrame, most: int = 10) -> DataFrame:
    """root, id, hops from each root (id), all roots at once; layers between a handler and the ground are hops - 1."""
    n = cut_lineage(both_ways(e))
    seen = n.select(F.col("a").alias("id")).join(roots.select("id"), "id", "left_semi").distinct().select(F.col("id").alias("root"), "id", F.lit(0).alias("hops"))
    for hop in range(1, most + 1):
        new = seen.where(F.col("hops") == hop - 1).join(n, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hops", F.lit(hop))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def match(edges: DataFrame, types: list[str]) -> DataFrame:
    """n0, n1, ...: chains of edges (src, dst, type) of the given types in a row; a join a hop."""
    out = edges.where(F.col("type") == types[0]).select(F.col("src").alias("n0"), F.col("dst").alias("n1"))
    for i, t in enumerate(types[1:], 1):
        step = edges.where(F.col("type") == t).select(F.col("src").alias("_s"), F.col("dst").alias(f"n{i + 1}"))
        out = out.join(step, F.col(f"n{i}") == F.col("_s")).drop("_s")
    return out


class Dependencies:
    """Brandes' accumulation over arrays: many sources at once, a level of all of them in one step.

    near[start[v] : start[v] + many[v]] are the neighbours of node v. A state is a node plus n times its source's number
    in the batch; a level keeps its states, their nodes, their numbers of shortest paths, and by places in their levels
    the steps into it.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int, states: int = 500_000):
        self.n, self.batch = n, max(1, states // max(n, 1))
        self.near = np.concatenate([b, a])[np.argsort(np.concatenate([a, b]), kind="stable")].astype(np.int64)
        self.many = np.bincount(np.concatenate([a, b]), minlength=n)
        self.start = np.cumsum(self.many) - self.many
        self.open = np.empty(self.batch * n, np.int8)  # 1: not reached yet, 2: in the last level, 0: before
        self.place = np.empty(self.batch * n, np.int64)  # of a state in its level

    def steps(self, states: np.ndarray, nodes: np.ndarray):
        """All edges of these states: the place of the one and the state of the other end."""
        many = self.many.take(nodes)
        ends = np.cumsum(many)
        at = np.repeat(np.arange(len(states)), many)
        edge = (self.start.take(nodes) - ends + many).take(at)
        edge += np.arange(len(at))
        other = self.near.take(edge)
        other += (states - nodes).take(at)
        return at, other

    def forward(self, old: np.ndarray, nodes: np.ndarray, paths: np.ndarray, left: int):
        """The next level's states, nodes and paths, and the places that its steps lead from and to."""
        if left < self.many.take(nodes).sum():  # fewer edges at what is not reached yet
            new = np.flatnonzero(self.open == 1)
            to, back = self.steps(new, new % self.n)
            hit = np.flatnonzero(self.open.take(back) == 2)
            to, came = to.take(hit), self.place.take(back.take(hit))
            first = np.flatnonzero(np.diff(to, prepend=-1))  # to is in order
            new, to = new.take(to.take(first)), np.repeat(np.arange(len(first)), np.diff(first, append=len(to)))
        else:
            came, found = self.steps(old, nodes)
            fresh = np.flatnonzero(self.open.take(found) == 1)
            came, found = came.take(fresh), found.take(fresh)
            order = np.arange(len(found))
            self.place[found] = order
            new = found[self.place.take(found) == order]  # each once
            self.place[new] = order[: len(new)]
            to = self.place.take(found)
        self.open[old], self.open[new], self.place[new] = 0, 2, np.arange(len(new))
        return new, new % self.n, np.bincount(to, paths.take(came), len(new)), came, to

    def sums(self, sources: np.ndarray) -> np.ndarray:
        """Of every node, the sum of what these sources depend on it."""
        total = np.zeros(self.n)
        for i in range(0, len(sources), self.batch):
            some = sources[i : i + self.batch]
            self.open[:] = np.arange(len(self.open)) < len(some) * self.n
            states = np.arange(len(some)) * self.n + some
            self.open[states], self.place[states] = 2, np.arange(len(some))
            levels, left = [(states, some, np.ones(len(some)), None, None)], len(some) * len(self.near)
            while len(levels[-1][0]):
                left -= self.many.take(levels[-1][1]).sum()
                levels.append(self.forward(*levels[-1][:3], left))
            share = np.zeros(0)
            while len(levels) > 1:
                _, nodes, paths, came, to = levels.pop()
                np.add.at(total, nodes, share)
                share = levels[-1][2] * np.bincount(came, ((1 + share) / paths).take(to), len(levels[-1][0]))
        return total


def betweenness(e: DataFrame, sources: DataFrame | None = None, most_edges: int = 2_000_000) -> DataFrame:
    """id, betweenness, n_sources: unweighted, undirected, end points left out, each pair once.

    Brandes' accumulation from every source (or the given sample, scaled up) in Arrow batches of sources; the edges
    go to every worker, so more than most_edges are refused.
    """
    pairs = cut_lineage(e.select("a", "b"))
    if pairs.count() > most_edges:
        raise ValueError("too many edges for exact betweenness; take a backbone first")
    met = pairs.toArrow()
    codes = pa.chunked_array(met["a"].chunks + met["b"].chunks, met.schema.field("a").type).combine_chunks().dictionary_encode()
    ends = codes.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
    known = e.sparkSession.sparkContext.broadcast((codes.dictionary.to_pandas(), ends[0], ends[1]))
    nodes = both_ways(pairs).select(F.col("a").alias("id")).distinct()
    chosen = nodes if sources is None else nodes.join(sources.select("id").distinct(), "id", "left_semi")

    def run(batches):
        names, a, b = known.value
        index, graph, total = pd.Index(names), Dependencies(a, b, len(names)), np.zeros(len(names))
        for batch in batches:
            total += graph.sums(index.get_indexer(batch["id"]))
        some = total > 0
        yield pd.DataFrame({"id": names[some], "b": total[some]})

    n, m = len(codes.dictionary), chosen.count()
    parts = chosen.repartition(min(200, max(1, m // 16))).mapInPandas(run, f"id {dict(nodes.dtypes)['id']}, b double")
    sums = parts.groupBy("id").agg(F.sum("b").alias("b"))
    scale = n / m / 2 if m else 0.0
    return nodes.join(sums, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"), F.lit(m).alias("n_sources"))


def louvain(e: DataFrame, most_nodes: int = 100_000) -> DataFrame:
    """id, community (its least id): deterministic local moving and merging, in one task a connected component."""
    c = components(e)
    largest = c.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest and largest > most_nodes:
        raise ValueError("a component is too large for one task; take a backbone first")
    kind = dict(c.dtypes)["id"]
    edges = e.join(c.withColumnRenamed("id", "a"), "a").select("component", "a", "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in sorted(zip(pdf["a"], pdf["b"])):
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1.0
        group = {v: v for v in near}
        level, total = {v: dict(x) for v, x in near.items()}, 2.0 * len(pdf)
        while True:
            at, weight = {v: v for v in level}, {v: sum(x.values()) for v, x in level.items()}
            sums, moved, any_move = dict(weight), True, False
            while moved:
                moved = False
                for v in sorted(level):
                    links: dict = {}
                    for w, x in level[v].items():
                        if w != v:
                            links[at[w]] = links.get(at[w], 0.0) + x
                    here = at[v]
                    sums[here] -= weight[v]
                    gain = lambda g: links.get(g, 0.0) - sums.get(g, 0.0) * weight[v] / total
                    best = min([here, *sorted(links)], key=lambda g: (-round(gain(g), 12), g != here, g))
                    sums[best] = sums.get(best, 0.0) + weight[v]
                    if best != here:
                        at[v], moved, any_move = best, True, True
            if not any_move:
                break
            group = {v: at[g] for v, g in group.items()}
            merged: dict = {}
            for v, x in level.items():
                for w, y in x.items():
                    row = merged.setdefault(at[v], {})
                    row[at[w]] = row.get(at[w], 0.0) + y
            level = merged
        name: dict = {}
        for v in sorted(group):
            name.setdefault(group[v], v)
        return pd.DataFrame({"id": list(group), "community": [name[g] for g in group.values()]})

    return edges.groupBy("component").applyInPandas(run, f"id {kind}, community {kind}")


def ranked(scores: DataFrame, by: str, top: int) -> DataFrame:
    """The first `top` of scores with their rank: most of `by`, then the least id. Only these rows meet in one task."""
    few = scores.orderBy(F.desc(by), "id").limit(top)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")))


def insulated(scores: DataFrame, edges: DataFrame, victims: DataFrame) -> DataFrame:
    """Scores of nodes that are no victim (id) and have no edge to one."""
    touched = both_ways(edges).join(victims.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
    return scores.join(touched, "id", "left_anti").join(victims.select("id"), "id", "left_anti")


def cross_district(df: DataFrame, identifier: str, district: str) -> DataFrame:
    """district_a, district_b, key: the same normalised identifier in two districts."""
    d = df.where(F.col(identifier).isNotNull()).select(F.col(identifier).alias("key"), F.col(district).alias("district_a")).distinct()
    return d.join(d.select("key", F.col("district_a").alias("district_b")), "key").where("district_a < district_b")
