"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is a part of a text between line feeds; one without a word is never touched. A line goes if it equals an
earlier one and has `exact` characters or more, or if its edit distance (insert, delete, substitute a character) to an
earlier one is at most `edits` and both have `least` characters or more; earlier means by (doc_id, hash of the text,
place in the text) of the first line of the same form. The operator and the pipeline take copies of any length
(exact = 1).

1. Every line gets, where it stands, the hashes that it may be found by, so that its text need not be moved: of two
   lines within the distance the longer has one of the shorter's edits + 1 even segments, at few possible places
   (multi-match-aware selection). A hash is of (length, segment number, segment).
2. Lines are aggregated to distinct forms, by hashes of 128 bits, so copies are never paired. The hashes of the forms'
   own segments are joined with each other and with those of the substrings at all other places.
3. An edit changes the counts of nine letters by two at most in sum; the join keeps only pairs that agree so far. The
   letters' counts are in one long, compared within the join's own code.
4. A segment that more than CROWD forms have of their own would pair them all. Its forms are only noted, and then met by
   all that `edits` edits leave of a line: of 2 * edits even segments all but some `edits` are the same, and one hash
   holds them all. They must nearly agree in their pairs of neighbouring characters too, of which an edit changes four
   at most; 128 bits tell which of them stand in a line an odd number of times.
5. What is left is verified on the lines themselves by a banded bit-parallel edit distance: after the common ends are
   cut, a word holds the 2 * edits + 1 diagonals of the band as bits, and a step for each character updates them all.

Edge cases: null or empty texts have no lines; null doc_ids come first, and are told apart by their texts, as rows that
share a doc_id are; rows equal in doc_id and text have the same lines at the same places and lose the same ones; if all
lines of a document go, its text is empty. Other columns are kept, whatever their names; only columns n_copies and
n_near of the input give way to the operator's in dedup().
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_saved, release, saved, table

LETTERS = "eanirstol"  # common ones, so that another word changes some
FEW = 1 << 20  # hashes of lines that are broadcast at most
CROWD = 16  # forms that have a segment of their own in common and are still paired by it


def segments(edits: int) -> dict[str, Column]:
    """Columns of the number (n), place (p) and size (z) of segment i of a line that is `less` shorter than l, for all less and i.

    Segments are even; the last ones take what is left over. Plain columns, so that the code of keys() stays small.
    """
    out, n = {}, edits + 1
    for less in range(edits + 1):
        own = F.col("l") - less
        base, over = F.floor(own / n).cast("int"), F.coalesce(own % n, F.lit(0))
        for i in range(n):
            more = F.greatest(over - (n - i), F.lit(0)) if i > 1 else F.lit(0)
            out |= {f"n{less}{i}": own * n + i, f"p{less}{i}": F.coalesce(base * i + more + 1, F.lit(1)), f"z{less}{i}": F.coalesce(base + (over >= n - i).cast("int"), F.lit(0))}
    return out


def keys(edits: int) -> list[Column]:
    """Hashes of a line's own segments, and then of the substrings at which it may hold those of lines shorter by 0 to edits."""
    key = lambda less, i, shift: F.xxhash64(F.col(f"n{less}{i}"), F.substring("line", F.col(f"p{less}{i}") + shift, F.col(f"z{less}{i}")))
    own, other = [key(0, i, 0) for i in range(edits + 1)], []
    for less in range(edits + 1):
        for i in range(edits + 1):
            shifts = range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
            other += [key(less, i, shift) for shift in shifts if less or shift]
    return own + other


def letter_counts(line: Column, length: Column) -> Column:
    """Counts of the letters modulo 64, six bits each, in a long; the length modulo 256 in its highest byte."""
    out, size = F.shiftleft((length % 256).cast("bigint"), 56), F.octet_length(line)
    for k, c in enumerate(LETTERS):
        n = ((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 64).cast("bigint")
        out = out.bitwiseOR(F.shiftleft(n, 6 * k))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """Never more than what the counts differ by in sum: each is compared around the circle of 64."""
    part = lambda x, k: F.shiftrightunsigned(x, 6 * k).bitwiseAND(F.lit(63))
    out = F.lit(0).cast("bigint")
    for k in range(len(LETTERS)):
        d = F.abs(part(a, k) - part(b, k))
        out = out + F.least(d, 64 - d)
    return out


def neighbours(line: Column) -> Column:
    """A struct of two longs: of 128 bits, dealt to pairs of neighbouring characters by hash, those of which an odd number stands in the line."""
    bit = lambda h, k: F.when(F.shiftright(h, 6).bitwiseAND(F.lit(1)) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("w0"), F.lit(0).cast("bigint").alias("w1"))

    def step(s, x):
        h = F.xxhash64(s["last"], x)
        return F.struct(x.alias("last"), s["w0"].bitwiseXOR(bit(h, 0)).alias("w0"), s["w1"].bitwiseXOR(bit(h, 1)).alias("w1"))

    return F.aggregate(F.split(line, ""), start, step, lambda s: F.struct(s["w0"].alias("w0"), s["w1"].alias("w1")))


def neighbours_apart(a: Column, b: Column) -> Column:
    """At most four times the edits: a substitution takes two pairs and adds two, any other edit changes three."""
    return F.bit_count(a["w0"].bitwiseXOR(b["w0"])) + F.bit_count(a["w1"].bitwiseXOR(b["w1"]))


def same_start(a: Column, b: Column) -> Column:
    """Characters that both begin with."""
    most = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((s <= most) & (p <= most - s) & (a.substr(p + 1, s) == b.substr(p + 1, s)), p + s).otherwise(p))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters whose lengths differ by at most `edits`; exact up to `edits`.

    Bit k of the band at column j stands for row j - edits + k. vp and vn are where the distance rises or falls by one
    from a row to the next; `low` is the distance at the band's last row.
    """
    m, n, band = F.size(a), F.size(b), 2 * edits + 1
    ones = F.lit((1 << band) - 1).cast("bigint")
    flip = lambda x: x.bitwiseXOR(ones)

    def step(s, j):
        eq = F.lit(0).cast("bigint")
        for k in range(band):
            i = j - edits + k
            hit = (i >= 0) & (i < m) & (F.get(a, F.greatest(i, F.lit(0))) == F.get(b, j))
            eq = eq.bitwiseOR(F.when(hit, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        one = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["low"].alias("low"), eq.alias("eq"))
        two = F.transform(F.array(one), lambda t: F.struct(t["vp"].alias("vp"), t["vn"].alias("vn"), t["low"].alias("low"), ((t["eq"].bitwiseAND(t["vp"]) + t["vp"]).bitwiseXOR(t["vp"]).bitwiseOR(t["eq"]).bitwiseOR(t["vn"])).bitwiseAND(ones).alias("d")))
        three = F.transform(two, lambda t: F.struct(t["low"].alias("low"), t["d"].alias("d"), t["vn"].bitwiseOR(flip(t["d"].bitwiseOR(t["vp"]))).alias("hp"), t["d"].bitwiseAND(t["vp"]).alias("hn"), F.shiftrightunsigned(t["d"], 1).alias("x")))
        four = F.transform(three, lambda t: F.struct(t["hn"].bitwiseOR(flip(t["x"].bitwiseOR(t["hp"]))).alias("vp"), t["x"].bitwiseAND(t["hp"]).alias("vn"), (t["low"] + F.when(F.shiftrightunsigned(t["d"], band - 1) == 0, 1).otherwise(0)).alias("low")))
        return four[0]

    start = F.struct(F.lit(((1 << band) - 1) & ~((1 << edits) - 1)).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.lit(edits).alias("low"))
    end = lambda s: s["low"] - F.bit_count(s["vp"].bitwiseAND(rest)) + F.bit_count(s["vn"].bitwiseAND(rest))
    rest = sum_bits(m - n + edits, 2 * edits)
    return F.when(n == 0, m).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step, end))


def sum_bits(first: Column, last: int) -> Column:
    """A mask of the bits first .. last - 1."""
    out = F.lit(0).cast("bigint")
    for k in range(last):
        out = out.bitwiseOR(F.when(first <= k, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def alike(a: Column, b: Column, edits: int) -> Column:
    """Of 2 * edits + 3 segments of a, all but `edits` stand in b, moved by `edits` places at most: true of all within `edits`."""
    n, found = 2 * edits + 3, F.lit(0)
    for i in range(n):
        at, end = F.floor(F.char_length(a) * i / n).cast("int"), F.floor(F.char_length(a) * (i + 1) / n).cast("int")
        around = F.substring(b, F.greatest(at - edits, F.lit(0)) + 1, end - at + 2 * edits)
        found = found + F.contains(around, F.substring(a, at + 1, end - at)).cast("int")
    return found >= n - edits


def same_inside(a: Column, b: Column, edits: int) -> Column:
    """True of strings without common ends that are within two edits: these stand at the ends, so all between is the same."""
    if edits > 2:
        return F.lit(True)
    inside = F.substring(a, F.lit(2), F.greatest(F.char_length(a) - 2, F.lit(0)))
    return F.startswith(b, inside) | F.startswith(F.substring(b, F.lit(2), F.lit(1 << 30)), inside) | F.startswith(F.substring(b, F.lit(3), F.lit(1 << 30)), inside)


def within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """The rows of pairs whose strings a and b are within `edits` edits of each other."""
    p = saved(pairs.where(alike(F.col(a), F.col(b), edits)), "line-alike").withColumn("_p", same_start(F.col(a), F.col(b)))
    cut = lambda x: F.reverse(F.col(x).substr(F.col("_p") + 1, F.char_length(x)))
    p = p.withColumn("_a", cut(a)).withColumn("_b", cut(b)).withColumn("_q", same_start(F.col("_a"), F.col("_b")))
    rest = lambda x: F.col(x).substr(F.col("_q") + 1, F.char_length(x))
    p = saved(p.withColumn("_a", rest("_a")).withColumn("_b", rest("_b")).drop("_p", "_q"), "line-trimmed")  # else filters would be pushed below these columns and repeat them
    chars = lambda x: F.filter(F.split(F.col(x), ""), lambda c: c != "")
    near = (F.abs(F.char_length("_a") - F.char_length("_b")) <= edits) & same_inside(F.col("_a"), F.col("_b"), edits)
    few = p.where(near).select(*pairs.columns, chars("_a").alias("_a"), chars("_b").alias("_b"))
    return few.where(edit_distance(F.col("_a"), F.col("_b"), edits) <= edits).select(*pairs.columns)


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, th (a hash of the text), at, line, h0, h1 (hashes of the line) of the lines that may go."""
    parts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    long = F.col("line").rlike(r"[^\x20\x09-\x0D]") & ((F.char_length("line") >= least) if least > 1 else F.lit(True))
    return parts.where(long).select("*", F.xxhash64("line").alias("h0"), F.xxhash64(F.lit(1), "line").alias("h1"))


def forms_of(lines: DataFrame, edits: int) -> DataFrame:
    """h0, h1, c, keys: every distinct line by its hashes, with its letters' counts, and its own keys before the others."""
    sized = lines.select("h0", "h1", "line", F.char_length("line").alias("l")).select("h0", "h1", "line", "l", *(c.alias(k) for k, c in segments(edits).items()))
    made = sized.select("h0", "h1", letter_counts(F.col("line"), F.col("l")).alias("c"), F.array(*keys(edits)).alias("keys"))
    return made.groupBy("h0", "h1").agg(F.first("c").alias("c"), F.first("keys").alias("keys"))


def able(edits: int) -> Column:
    """Of a form (h0, c) and one that is as long or longer (g0, c2): they nearly agree in their letters, and meet in one order only."""
    longer = F.shiftrightunsigned("c", 56) != F.shiftrightunsigned("c2", 56)
    return (counts_apart(F.col("c"), F.col("c2")) <= 2 * edits) & (longer | (F.col("h0") < F.col("g0")))


def meet(one: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """a, b: h0 of one and g0 of other where they share a key and `on` holds."""
    return one.join(other.hint("merge"), (F.col("key") == F.col("key2")) & on).select(F.col("h0").alias("a"), F.col("g0").alias("b"))


def candidates(forms: DataFrame, edits: int) -> DataFrame:
    """a, b: hashes h0 of forms that share a key and nearly agree in their letters, each pair once; written to the shared folder.

    For a key that more than CROWD forms have of their own, each form that has it at all stands there once, with a null.
    """
    one = forms.select("h0", "c", F.explode(F.slice("keys", 1, edits + 1)).alias("key"))
    same = one.select(F.col("h0").alias("g0"), F.col("c").alias("c2"), F.col("key").alias("key2"))
    more = forms.select(F.col("h0").alias("g0"), F.col("c").alias("c2"), F.explode(F.slice("keys", edits + 2, 1 << 20)).alias("key2"))
    group = Window.partitionBy("key")
    sized = one.withColumn("n", F.count("*").over(group)).withColumn("least", F.min("h0").over(group))
    few = sized.where((F.col("n") <= CROWD) | (F.col("h0") == F.col("least"))).select(F.when(F.col("n") <= CROWD, F.col("h0")).alias("h0"), "c", "key")
    on = F.col("h0").isNull() | able(edits)
    pairs = saved(meet(few, same, on).unionByName(meet(few, more, on)).distinct(), "line-pairs")
    del forms, one, same, more, sized, few
    release(pairs.sparkSession)
    return pairs


def places(edits: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """What may differ: `less`, a number, and for each of `edits` of 2 * edits segments which it is and how much longer the other line's is.

    First for a line itself and then for those that are as long or up to `edits` longer.
    """
    sets = [*enumerate(itertools.combinations(range(2 * edits), edits))]
    grown = [g for g in itertools.product(range(-edits, edits + 1), repeat=edits) if sum(map(abs, g)) <= edits and sum(g) >= 0]
    all_ = [(sum(g), k, *itertools.chain(*zip(s, g))) for k, s in sets for g in grown]
    own = [x for x in all_ if not any(x[3::2])]
    return own, [x for x in all_ if any(x[3::2])]


def rest_keys(lines: DataFrame, edits: int, at: list[tuple[int, ...]]) -> DataFrame:
    """h0, c, w, key: for each of `at` a hash of what stands outside of these segments of a line of h0, line, l, c, w."""
    names = ["less", "k", *itertools.chain(*((f"s{i}", f"g{i}") for i in range(edits)))]
    each = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, x))) for x in at)))
    x = lines.select("h0", "line", "l", "c", "w", each.alias("t")).select("h0", "line", "c", "w", "t", (F.col("l") - F.col("t.less")).alias("own"))
    edge = lambda i: F.floor(F.col("own") * i / (2 * edits)).cast("int")
    parts, start, moved = [], F.lit(0), F.lit(0)
    for i in range(edits):
        parts.append(F.substring("line", start + 1, F.greatest(edge(F.col(f"t.s{i}")) + moved - start, F.lit(0))))
        moved = moved + F.col(f"t.g{i}")
        start = edge(F.col(f"t.s{i}") + 1) + moved
    return x.select("h0", "c", "w", F.xxhash64("own", "t.k", *parts, F.substring("line", start + 1, F.lit(1 << 30))).alias("key"))


def crowded(lines: DataFrame, edits: int) -> DataFrame:
    """a, b as of candidates(), of the distinct ones of these lines, that agree outside of `edits` of 2 * edits segments."""
    forms = lines.select("h0", "line").distinct().withColumn("l", F.char_length("line"))
    forms = saved(forms.select("*", letter_counts(F.col("line"), F.col("l")).alias("c"), neighbours(F.col("line")).alias("w")), "line-crowds")
    own, others = places(edits)
    one, more = rest_keys(forms, edits, own), rest_keys(forms, edits, others)
    to = lambda x: x.select(F.col("h0").alias("g0"), F.col("c").alias("c2"), F.col("w").alias("w2"), F.col("key").alias("key2"))
    on = able(edits) & (neighbours_apart(F.col("w"), F.col("w2")) <= 4 * edits)
    pairs = saved(meet(one, to(one), on).unionByName(meet(one, to(more), on)).distinct(), "line-pairs")
    drop_saved(forms)
    return pairs


def of_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines whose h0 is one of the saved ids."""
    ids = F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge")
    return lines.join(ids, F.col("h0") == F.col("id"), "left_semi")


def edit_join(lines: DataFrame, edits: int) -> DataFrame:
    """The distinct lines (of lines_of()) that are within `edits` edits of each other, each pair once: a and b, each a
    struct of h0, h1, place and line. Written to the shared folder.
    """
    found = candidates(forms_of(lines, edits), edits)  # by now all keys are spent
    pairs, crowds = found.where("a is not null"), found.where("a is null").select(F.col("b").alias("id"))
    if not crowds.isEmpty():
        pairs = pairs.unionByName(crowded(of_ids(lines, crowds), edits)).distinct()
    ids = saved(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "line-ids")
    texts = saved(of_ids(lines, ids).groupBy("h0", "h1", "line").agg(F.min(F.struct("doc_id", "th", "at")).alias("place")), "line-texts")
    of = lambda x: texts.select(F.col("h0").alias(f"{x}0"), F.struct("h0", "h1", "place", "line").alias(f"{x}_form"))
    full = pairs.join(of("a"), F.col("a") == F.col("a0")).join(of("b"), F.col("b") == F.col("b0"))
    full = full.select(F.col("a_form").alias("a"), F.col("b_form").alias("b"), F.col("a_form.line").alias("x"), F.col("b_form.line").alias("y"))
    links = saved(within(full.where("x <> y"), "x", "y", edits).select("a", "b"), "line-links")
    drop_saved(found, pairs, texts)
    return links


def later_forms(links: DataFrame) -> DataFrame:
    """g0, g1, links, goes: the forms with links, how many, and whether one of them leads to an earlier form."""
    side = lambda x, y: links.select(F.col(f"{x}.h0").alias("g0"), F.col(f"{x}.h1").alias("g1"), F.col(f"{x}.place").alias("own"), F.col(f"{y}.place").alias("met"))
    return side("a", "b").unionByName(side("b", "a")).groupBy("g0", "g1").agg(F.count("*").alias("links"), (F.min("met") < F.min("own")).alias("goes"))


def spent(docs: DataFrame, edits: int, least: int, exact: int) -> DataFrame:
    """doc_id, th, at, near of the lines that go."""
    if least < 2 * edits + 1:
        raise ValueError("segments of shorter lines would be empty")
    near = later_forms(edit_join(lines_of(docs, least), edits)).where("goes").select("g0", "g1")
    marked = saved(lines_of(docs, exact).select("doc_id", "th", "at", "h0", "h1"), "line-places")
    first = marked.groupBy("h0", "h1").agg(F.min(F.struct("doc_id", "th", "at")).alias("place"), F.count("*").alias("n"))
    again = first.where("n > 1").select(F.col("h0").alias("f0"), F.col("h1").alias("f1"), "place")
    x = marked.join(again, (F.col("h0") == F.col("f0")) & (F.col("h1") == F.col("f1")), "left").join(near, (F.col("h0") == F.col("g0")) & (F.col("h1") == F.col("g1")), "left")
    copy = F.coalesce(F.struct("doc_id", "th", "at") != F.col("place"), F.lit(False))
    return x.where(copy | F.col("g0").isNotNull()).select("doc_id", "th", "at", F.col("g0").isNotNull().alias("near"))


def cut(docs: DataFrame, edits: int = 2, least: int = 20, exact: int | None = None) -> DataFrame:
    """row (a struct of the other columns of docs), text (what is left of it), n_copies and n_near of every document.

    exact: the least length of a line that goes as a copy; that of near copies if not given.
    """
    gone = spent(docs, edits, least, least if exact is None else exact).groupBy(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).agg(F.array_sort(F.collect_set(F.struct("at", "near"))).alias("gone"))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text").withColumn("th", F.xxhash64("text"))
    j = d.join(gone, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    parts, places = F.split("text", "\n"), F.col("gone.at")
    left = F.filter(parts, lambda x, i: ~F.array_contains(places, i))
    count = lambda near: F.coalesce(F.size(F.filter("gone", lambda g: g["near"] == near)), F.lit(0)).cast("bigint")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return j.select("row", text.alias("text"), count(False).alias("n_copies"), count(True).alias("n_near"))


def unpacked(columns: list[str], **new: Column) -> list[Column]:
    """These columns out of row, but for those given anew."""
    return [(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns]


def dedup(docs: DataFrame, edits: int = 2, least: int = 20, exact: int | None = None) -> DataFrame:
    """docs with the text left, and n_copies, n_near: how many lines went as copies or else as near copies."""
    counts = ["n_copies", "n_near"]
    return cut(docs, edits, least, exact).select(*unpacked([c for c in docs.columns if c not in counts], text=F.col("text")), *counts)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), exact=1)
    return d.select("doc_id", "n_copies", "n_near", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("lines_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
