"""Near-duplicates by bottom-k sketches from one hash function.

A document is the set of its distinct five-word shingles (A-Z lower-cased), each hashed to 64 bits; a text of fewer
words is one shingle, one without words none. The `keep` least values are its sketch.

1. Documents of equal sets are one class, by a 128-bit digest of the set; classes are numbered.
2. Inverted lists hold the retained values: a class posts those of its `post` least values with the shortest lists.
   Two sets of similarity s share about s * post of them, so if a sharing of less than `share` of them is ruled out
   (for post = 32, s = 0.85 and share = 0.44, or s = 0.8 and share = 0.4, its chance is under 1e-6), leaving out so many of the longest lists, less
   one, loses no pair. Values in many documents (a common passage) are thus hardly ever posted.
3. In each list all classes meet the one whose values are the most common: of a group of copies, the form they come from. The union sketch of a pair (the least values of both) estimates its
   similarity; estimates more than six standard deviations too low are dropped, the others are decided on full sets.
4. The links give components. Within a list, classes that are in different components still have to meet. Their full
   sets are joined exactly by their rarest shingles: only pairs in different components that share one early enough,
   by its places in both sets, and whose sets' parities differ in few enough bits, are made and decided. Pairs within a component change nothing, so a large group of
   copies costs its size.

Full sets are made again from the text, for the documents in undecided pairs only.

Edge cases: null text or no words: n_shingles 0, linked with nothing, its component_id is its doc_id and it is kept; equal
texts are one class; rows of equal doc_id are one node, with the links of all their texts; a row of null doc_id links
with nothing, its component_id is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, saved, slices, spare, table
from .components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = np.array([(0x9E3779B97F4A7C15 * (2 * j + 3) ** 5 | 1) & (1 << 64) - 1 for j in range(64)], np.uint64)
HELD = 200_000


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def shingle_set(text: str | None, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(width, len(w))
    total = np.full(len(w) - n + 1, 1 + n, np.uint64)
    for j in range(n):
        total += _mixed(h[j : len(w) - n + 1 + j] * ODD[j])
    return np.unique(_mixed(total).view(np.int64))


def _per_text(docs: DataFrame, schema: str, row) -> DataFrame:
    """(doc_id, th, text) through row(text) -> values, in slices of Arrow batches."""
    names = ["doc_id", "th", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 500_000):
                if len(words) > HELD:
                    words.clear()
                cols = zip(*(row(t, words) for t in texts[a:b]))
                arrays = [pa.array(c, t) for c, t in zip(cols, row.types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *arrays], names=names)
        words.clear()
        spare()

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id bigint, th bigint, {schema}")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def sketches(docs: DataFrame, width: int = 5, keep: int = 64) -> DataFrame:
    """doc_id, th, n_shingles, digest and sketch of every document."""

    def row(text, words):
        s = shingle_set(text, width, words)
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:keep].tolist()

    row.types = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return _per_text(marked(docs), "n_shingles bigint, digest binary, sketch array<bigint>", row)


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    def row(text, words):
        s = shingle_set(text, width, words)
        return s.tolist(), parities(s)

    row.types = (pa.list_(pa.int64()), pa.list_(pa.int64()))
    return _per_text(docs, "shingles array<bigint>, parities array<bigint>", row)


def parities(s: np.ndarray) -> list[int]:
    """256 bits, each whether an odd number of shingles falls on it: two sets differ in as many shingles as bits, at least."""
    return np.packbits((np.bincount(s & 255, minlength=256) & 1).astype(np.uint8)).view(np.int64).tolist()


def estimated(pairs: DataFrame, signed: DataFrame, percent: int, keep: int) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule them out."""
    of = lambda x: signed.select(F.col("doc_id").alias(f"{x}_id"), F.col("sketch").alias(f"{x}_sketch"))
    with_a = pairs.select("a", "b").join(of("a"), F.col("a") == F.col("a_id")).drop("a_id")
    both = with_a.join(of("b"), F.col("b") == F.col("b_id")).drop("b_id")
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, keep)
    shared = F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), union))
    s = percent / 100
    least = s - 6 * (s * (1 - s) / keep) ** 0.5
    return both.where(shared >= F.lit(least) * F.size(union)).select("a", "b")


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id (here the number of a class), shingles and parities of the classes in ids (doc_id), written to the shared folder."""
    wanted = classes.join(ids.distinct(), "doc_id", "left_semi").select("doc_id", "rep.*").withColumnsRenamed({"doc_id": "class", "id": "wid", "th": "wth"})
    d = marked(docs).join(wanted.hint("merge"), (F.col("doc_id") == F.col("wid")) & (F.col("th") == F.col("wth"))).select(F.col("class").alias("doc_id"), "th", "text").dropDuplicates(["doc_id"])
    return saved(full_sets(d, width).drop("th"), "sets")


def decide(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of = lambda x: sets.select(F.col("doc_id").alias(f"{x}_id"), F.col("shingles").alias(f"{x}_set"))
    full = pairs.join(of("a"), F.col("a") == F.col("a_id")).drop("a_id").join(of("b"), F.col("b") == F.col("b_id"))
    inter = F.size(F.array_intersect("a_set", "b_set"))
    return full.where(100 * inter >= percent * (F.size("a_set") + F.size("b_set") - inter)).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """value, doc_id, n, at, short: the places of each set's rarest shingles that it must share with a similar set.

    Shingles are ordered by how many sets of the table hold them, then by value. Two sets with 100 * intersection >=
    percent * union share one of the first n - ceil(percent * n / 100) + 1 of each, and of the smaller one of the
    first n - ceil(2 * percent * n / (100 + percent)) + 1 (short). Shingles of one set keep their place unposted.
    """
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    held = each.groupBy("value").agg(F.count("*").alias("length")).where("length > 1").withColumnRenamed("value", "hv")
    found = each.join(held, F.col("value") == F.col("hv")).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("found"))
    lone = F.col("n") - F.size("found")
    most = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - lone).cast("int")
    short = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    listed = found.where(most > 0).select("doc_id", "n", short.alias("most"), lone.alias("lone"), F.posexplode(F.slice("found", F.lit(1), most)).alias("k", "f"))
    at = F.col("lone") + F.col("k") + 1
    return listed.select("f.value", "doc_id", "n", at.alias("at"), (at <= F.col("most")).alias("short"))


def crossing(listed: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components (c) that may be similar, from the rows of prefixes() with c and parities.

    The join keeps a pair only if so many shingles can be shared after the places of the one they meet at, and if no
    more shingles than similar sets may differ in are known by their parities to be in one set only.
    """
    x = listed.select("value", "doc_id", "n", "c", "at", "short", *(F.col("parities")[k].alias(f"p{k}") for k in range(4)))
    y = x.select(F.col("value").alias("v2"), F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("c").alias("bc"), F.col("at").alias("bat"), *(F.col(f"p{k}").alias(f"q{k}") for k in range(4)))
    both = F.col("n") + F.col("bn")
    smaller = (F.col("n") < F.col("bn")) | ((F.col("n") == F.col("bn")) & (F.col("doc_id") < F.col("b")))
    able = (1 + F.least(F.col("n") - F.col("at"), F.col("bn") - F.col("bat"))) * (100 + percent) >= both * percent
    odd = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(4)), F.lit(0))
    able = able & ((both - odd) * (100 + percent) >= 2 * percent * both)
    return x.where("short").join(y, (F.col("value") == F.col("v2")) & smaller & (F.col("c") != F.col("bc")) & _near("n", "bn", percent) & able).select(F.col("doc_id").alias("a"), "b")


def _near(x: str, y: str, percent: int) -> Column:
    """Whether sets of x and y shingles can be similar."""
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, keep: int = 64, post: int = 32, share: float = 0.44) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = saved(sketches(docs, width, keep), "sketches")
    named = signed.where("doc_id is not null and n_shingles > 0")
    # From here to the end doc_id is the number of a class; rep has a document of it, the least one.
    rep = F.min(F.struct(F.col("doc_id").alias("id"), F.col("th").alias("th"), F.col("n_shingles").alias("n_shingles"), F.col("sketch").alias("sketch"))).alias("rep")
    classes = saved(named.groupBy("digest").agg(rep).select(F.monotonically_increasing_id().alias("doc_id"), "digest", F.struct("rep.id", "rep.th").alias("rep"), "rep.n_shingles", "rep.sketch"), "classes")
    posted = saved(_posted(classes, post, share), "posted")
    middle = posted.groupBy("value").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"), "n")).alias("p")).select(F.col("value").alias("pv"), (-F.col("p.id")).alias("a"), F.col("p.n").alias("an"))
    first = posted.join(middle, (F.col("value") == F.col("pv")) & (F.col("doc_id") != F.col("a")) & _near("n", "an", percent)).select("a", F.col("doc_id").alias("b")).distinct()
    likely = saved(estimated(first, classes, percent, keep), "likely")
    sets = sets_of(ends(likely), classes, docs, width)
    links = saved(decide(likely, sets, percent).unionByName(same_document(named, classes)), "links")
    drop_saved(sets, likely)
    group = components(links)
    # Classes of a list that are in different components still have to meet.
    x = posted.join(group, F.col("doc_id") == F.col("node"), "left").select("value", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    apart = x.groupBy("value").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select(F.col("value").alias("mv"))
    x = saved(x.join(apart, F.col("value") == F.col("mv"), "left_semi").select("doc_id", "c").distinct(), "apart")
    sets = sets_of(x.select("doc_id"), classes, docs, width)
    x = x.select(F.col("doc_id").alias("id"), "c").join(sets.select("doc_id", "parities"), F.col("id") == F.col("doc_id")).select("id", "c", "parities")
    x = saved(prefixes(sets, percent).join(x, F.col("doc_id") == F.col("id")).drop("id"), "prefixes")
    rest = saved(crossing(x, percent).distinct(), "crossing")
    more = saved(decide(rest, sets, percent), "links")
    drop_saved(sets, x, posted, rest)
    if not more.isEmpty():
        group = components(links.unionByName(more))
    grouped = classes.select("doc_id", "digest", "rep.id").join(group, F.col("doc_id") == F.col("node"), "left").select("digest", "id", F.coalesce("component", "doc_id").alias("c"))
    least = grouped.groupBy(F.col("c").alias("lc")).agg(F.min("id").alias("component_id"))
    by_digest = grouped.join(least, F.col("c") == F.col("lc")).select(F.col("digest").alias("d"), "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(by_digest, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def same_document(named: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: for every doc_id with several sets the class of one and that of each other."""
    h = F.xxhash64("digest")
    several = named.groupBy(F.col("doc_id").alias("sid")).agg(F.min(h).alias("h0"), F.max(h).alias("h1")).where("h0 <> h1").select("sid")
    of = named.join(several, F.col("doc_id") == F.col("sid"), "left_semi").select(F.col("doc_id").alias("sid"), F.col("digest").alias("d"))
    each = saved(of.join(classes.select("doc_id", "digest"), F.col("d") == F.col("digest")).select("sid", "doc_id"), "same-id")
    return each.join(each.groupBy(F.col("sid").alias("mid")).agg(F.min("doc_id").alias("a")), F.col("sid") == F.col("mid")).select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()


def _posted(reps: DataFrame, post: int, share: float) -> DataFrame:
    """value, doc_id, n, weight: the retained values that each class posts, from lists of two or more.

    weight sums the lengths of the lists of a class's values: in a group of copies it is largest for the common form.
    """
    held = F.least(F.size("sketch"), F.lit(post))
    values = reps.select("doc_id", F.col("n_shingles").alias("n"), held.alias("held"), F.explode(F.slice("sketch", 1, post)).alias("value"))
    length = values.groupBy("value").agg(F.count("*").alias("length")).where("length > 1").withColumnRenamed("value", "lv")
    found = values.join(length, F.col("value") == F.col("lv")).groupBy("doc_id", "n", "held").agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("found"))
    alone = F.col("held") - F.size("found")  # lists of one come first in the order and need no posting
    most = F.col("held") - F.ceil(F.col("held") * share) + 1 - alone
    weight = F.aggregate("found", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    return found.where(most > 0).select("doc_id", "n", weight.alias("weight"), F.explode(F.slice("found", F.lit(1), most.cast("int"))).alias("f")).select("f.value", "doc_id", "n", "weight")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
