"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Each source is cut by a seeded hash into at most `blocks` blocks, put in a seeded order. A target of k whole sources
and a rest takes every block k times and then, in that order, the blocks that fit in the rest; of the first that doesn't
documents are taken in their own seeded order as long as they fit in what is left, going on to smaller ones. The numbers of blocks that the sources give (their quotas) are then
split between the two halves of the output shards, again and again, each split a draw without replacement from all
blocks at the node, so that every shard gets a multivariate-hypergeometric mix and no block goes to two shards. Within
a shard documents are shuffled by a seeded hash: their places in it are the order of mix_place.

Only sums by block and by source are ever gathered by a key: a source that holds a third of all rows has as many
blocks as any other of its size, and no window runs over documents but in the one block that is cut, over sizes alone.
What is taken of that block is told by ranges of the seeded order, so the texts meet a table of blocks only.

Edge cases: a null text has size 0; the null source is a source, ordered last; rows of equal doc_id
stand in the same block, ordered by their texts' hashes; a source of size
0 has target 0 and gives nothing; an empty table gives an empty mix. Other
columns are kept, whatever their names; only columns mix_size, mix_pass, mix_shard and mix_place of the input give way
to the operator's in mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_saved, saved, table

FEW = 1 << 20  # blocks that are broadcast at most


def n_words(text: str) -> F.Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    blanks = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    starts = F.concat(F.lit(" "), blanks)
    return F.coalesce(F.regexp_count(starts, F.lit(r" [^ ]")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target of a table of sources: `share` of all sizes by weight, none above most x its size.

    With caps c = most * size, the least ratios c / weight are capped first. Going through them in order, the level at
    which the rest is shared rises as long as the next source is to be capped and falls after it, so it is the maximum.
    One row a source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_code = everything.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    by_ratio = everything.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_code) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _unit(*cols) -> F.Column:
    """A number in [0, 1) from a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, shard, first, last: the places in each source's order of draws that go to each shard.

    A node holds the quota of every source. Its left child gets half of all draws; walking through the draws of one
    source after another, each goes left with the chance of the places left over the draws left (selection sampling),
    which makes the numbers multivariate hypergeometric. The array has an entry a source.
    """
    nodes = quotas.where("quota > 0").groupBy(F.lit(1).alias("node")).agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota"))).alias("q"))
    level = 1
    while level < shards:
        total = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x["quota"])
        nodes = nodes.withColumn("total", total).withColumn("half", F.floor((F.col("total") + 1) / 2).cast("bigint"))

        def source_draws(acc, x):
            def one(a, i):
                left = _unit(F.lit(seed), F.col("node"), x["source"], i) * a["total"] < a["half"]
                return F.struct((a["total"] - 1).alias("total"), (a["half"] - left.cast("bigint")).alias("half"), (a["got"] + left.cast("bigint")).alias("got"))

            start = F.struct(acc["total"].alias("total"), acc["half"].alias("half"), F.lit(0).cast("bigint").alias("got"))
            places = F.when(x["quota"] > 0, F.sequence(F.lit(1).cast("bigint"), x["quota"])).otherwise(F.array().cast("array<bigint>"))
            end = F.aggregate(places, start, one)
            return F.struct(end["total"].alias("total"), end["half"].alias("half"), F.concat(acc["gets"], F.array(end["got"])).alias("gets"))

        start = F.struct("total", "half", F.array().cast("array<bigint>").alias("gets"))
        nodes = nodes.withColumn("gets", F.aggregate("q", start, source_draws)["gets"])
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("q", "gets", lambda x, g: x.withField("quota", g)).alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "gets", lambda x, g: x.withField("quota", x["quota"] - g)).alias("q")),
        )
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.node", "h.q")
        level *= 2
    leaves = nodes.select((F.col("node") - level).cast("int").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", "x.quota")
    to_here = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    return leaves.select("source", "shard", (to_here - F.col("quota")).alias("first"), to_here.alias("last")).where("last > first")


def marked(docs: DataFrame, blocks: int = 512, seed: int = 20240) -> DataFrame:
    """docs with _own (its place in its source's order), _block and _tie (a hash of the text)."""
    own = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    return docs.withColumn("_own", own).withColumn("_block", F.pmod("_own", F.lit(blocks)).cast("int")).withColumn("_tie", F.xxhash64("text"))


def measured(docs: DataFrame, blocks: int = 512, seed: int = 20240) -> DataFrame:
    """doc_id, source, _size and marks of every document, without its text: words are counted once."""
    return saved(marked(docs.select("doc_id", "source", "text"), blocks, seed).select("doc_id", "source", n_words("text").alias("_size"), "_own", "_block", "_tie"), "mix-sizes")


def block_draws(d: DataFrame, weights: tuple[float, ...], share: float, most: float, shards: int, seed: int) -> DataFrame:
    """A row for each block (s, b): words, source_size, target and draws (pass, need, shard); d is from measured().

    A draw with need below the words of its block takes a part of it.
    """
    by_block = d.groupBy("source", "_block").agg(F.sum("_size").alias("words"))
    goals = targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), list(weights), share, most)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # In their seeded order blocks go to the last, partial pass as long as they fit in the rest; the first that doesn't is cut to what is left.
    b = by_block.select(F.col("source").alias("s"), "_block", "words").join(goals, F.col("s").eqNullSafe(F.col("source")))
    order = F.struct(F.xxhash64(F.lit(seed + 1), "s", "_block").alias("at"), "_block", "words")
    g = b.groupBy("s", "source_size", "target", "whole", "rest").agg(F.sort_array(F.collect_list(order)).alias("x"))
    fits = lambda a, y: F.when(y["words"] <= a["left"], y["words"].cast("double")).otherwise(F.lit(0.0))
    start = F.struct(F.col("rest").cast("double").alias("left"), F.array().cast("array<double>").alias("needs"))
    g = g.withColumn("f", F.aggregate("x", start, lambda a, y: F.struct((a["left"] - fits(a, y)).alias("left"), F.concat(a["needs"], F.array(fits(a, y))).alias("needs"))))
    g = g.withColumn("cut", F.array_position(F.zip_with("x", "f.needs", lambda y, n: (n == 0) & (y["words"] > 0)), True) - 1)
    b = g.select("s", "source_size", "target", "whole", F.posexplode(F.zip_with("x", "f.needs", lambda y, n: F.struct(y["at"].alias("at"), y["_block"].alias("_block"), y["words"].alias("words"), n.alias("n")))).alias("i", "y"), "cut", "f.left")
    b = b.select("s", "source_size", "target", "whole", "y.at", "y._block", "y.words", F.when(F.col("i") == F.col("cut"), F.col("left")).otherwise(F.col("y.n")).alias("need"))
    b = b.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy(F.col("need") <= 0, "at", "_block"))).withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("s")))
    passes = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda p: F.struct(p.alias("pass"), F.when(p < F.col("whole"), F.col("words").cast("double")).otherwise(F.col("need")).alias("need"), (p * F.col("n_blocks") + F.col("rank") - 1).alias("draw")))
    b = saved(b.select("s", F.col("_block").alias("b"), "words", "source_size", "target", F.filter(passes, lambda x: (F.col("source_size") > 0) & (x["need"] > 0)).alias("x")), "mix-blocks")
    draws = b.select("s", "b", F.explode("x").alias("x")).select("s", "b", "x.*")
    quotas = draws.groupBy(F.col("s").alias("source")).agg((F.max("draw") + 1).cast("bigint").alias("quota"))
    parts = split_tree(quotas, shards, seed + 2).groupBy(F.col("source").alias("ps")).agg(F.collect_list(F.struct("shard", "first", "last")).alias("parts"))
    out = b.join(parts, F.col("s").eqNullSafe(F.col("ps")), "left")
    shard = lambda x: F.filter("parts", lambda p: (x["draw"] >= p["first"]) & (x["draw"] < p["last"]))[0]["shard"]
    out = out.select("s", "b", "words", "source_size", "target", F.transform("x", lambda x: F.struct(x["pass"].alias("pass"), x["need"].alias("need"), shard(x).alias("shard"))).alias("draws"))
    cut = fitting(d, draws.join(b.select(F.col("s").alias("bs"), F.col("b").alias("bb"), "words"), F.col("s").eqNullSafe(F.col("bs")) & (F.col("b") == F.col("bb"))).where("need < words").select("s", "b", "need"))
    return saved(out.join(cut, F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb")), "left").drop("cs", "cb"), "mix-draws")


def fitting(d: DataFrame, cuts: DataFrame, levels: int = 5) -> DataFrame:
    """cs, cb, fits: of each block that is cut (s, b, need) ranges of its documents' order and the largest size taken in them.

    Documents that fit are taken as far as their sizes add up to the need; then, of those after them, such as fit in
    what is left of it, and so on; last the first one of less than twice what is left.
    """
    key = F.struct("_own", "_tie")
    left = cuts.select(F.col("s").alias("cs"), F.col("b").alias("cb"), "need")
    rows = saved(d.join(left, F.col("source").eqNullSafe(F.col("cs")) & (F.col("_block") == F.col("cb"))).select("cs", "cb", "need", "_size", key.alias("key")), "mix-cut")
    out, spent = None, [rows]
    for level in range(levels + 1):
        if level < levels:
            fit = rows.where("_size <= need").withColumn("sum", F.sum("_size").over(Window.partitionBy("cs", "cb").orderBy("key"))).where("sum <= need")
            got = fit.groupBy("cs", "cb").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max("need").alias("most"), F.sum("_size").alias("got"))
        else:
            got = rows.where("_size < 2 * need").groupBy("cs", "cb").agg(F.min("key").alias("first")).withColumn("last", F.col("first")).withColumn("most", F.lit(float("inf"))).withColumn("got", F.lit(0).cast("bigint"))
        got = saved(got, "mix-level")
        spent.append(got)
        out = got if out is None else out.unionByName(got)
        g = got.select(F.col("cs").alias("gs"), F.col("cb").alias("gb"), "last", "got")
        on = F.col("cs").eqNullSafe(F.col("gs")) & (F.col("cb") == F.col("gb"))
        if level < levels:
            rows = rows.join(g, on, "left").where("last is null or key > last").select("cs", "cb", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), "_size", "key")
    fits = saved(out.groupBy("cs", "cb").agg(F.collect_list(F.struct("first", "last", "most")).alias("fits")), "mix-fits")
    drop_saved(*spent)
    return fits


def taken(d: DataFrame, draws: DataFrame, size: F.Column, *more: str, seed: int = 20240) -> DataFrame:
    """Every row of d (source, _own, _block, _tie, and the columns `more`) with source_size, target and its copies (pass, shard,
    place in the shard's shuffled order); size is looked at in blocks that are cut only.
    """
    few = F.broadcast(draws) if draws.count() <= FEW else draws.hint("merge")
    j = d.join(few, F.col("source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")))
    key = F.struct("_own", "_tie")
    fits = F.when(F.col("fits").isNotNull(), F.exists(F.transform("fits", lambda x: (key >= x["first"]) & (key <= x["last"]) & (size <= x["most"])), lambda x: x)).otherwise(F.lit(False))
    copies = F.filter("draws", lambda x: (x["need"] >= F.col("words")) | F.col("_fits"))
    place = lambda x: F.xxhash64(F.lit(seed + 3), x["pass"], "_own", "_tie")
    return j.withColumn("_fits", fits).select(*more, "source_size", "target", F.transform(copies, lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), place(x).alias("place"))).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, blocks: int = 512, shards: int = 8, seed: int = 20240) -> DataFrame:
    """The mix: row (a struct of the columns of docs) with mix_size, mix_pass, mix_shard and mix_place (the order in a shard).

    A document stands as often as it is taken. `shards` is a power of two.
    """
    sizes = measured(docs, blocks, seed)
    draws = block_draws(sizes, weights, share, most, shards, seed)
    drop_saved(sizes)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text")
    d = marked(whole, blocks, seed).select("row", "source", "text", "_own", "_block", "_tie")
    out = taken(d, draws, n_words("text"), "row", "text", seed=seed).select("row", "text", F.explode("copies").alias("c"))
    return out.select("row", n_words("text").alias("mix_size"), F.col("c.pass").alias("mix_pass"), F.col("c.shard").alias("mix_shard"), F.col("c.place").alias("mix_place"))


def in_order(mix: DataFrame) -> DataFrame:
    """The rows of mixed() dealt to partitions by shard and place, and sorted so: written, they stand in the mix's order."""
    order = ("mix_shard", "mix_place")
    return mix.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, **how) -> DataFrame:
    """mixed() with every column of docs by itself."""
    marks = ["mix_size", "mix_pass", "mix_shard", "mix_place"]
    return mixed(docs, **how).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in marks), *marks)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = measured(table(spark, sf_dir, "documents"))
    out = taken(d, block_draws(d, (3.0, 1.0, 2.0), 1.5, 2.0, 8, 20240), F.col("_size"), "doc_id", "_size")
    part = lambda c: F.transform("copies", lambda x: x[c])
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size("copies")).cast("bigint").alias("taken"), part("shard").alias("shards"), part("place").alias("places"))
