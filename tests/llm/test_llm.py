"""The operators against brute force, exact round trips or other libraries, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import ann, bpe, components, langid, lines, minhash, mixing, mlm, planes, repetition, sufdedup

R = random.Random(4)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "l'été", "naïve", "x"]
say = lambda n: " ".join(R.choice(WORDS) + str(R.randint(0, 40)) for _ in range(n))
LONG = say(400)
TEXTS = [None, "", " \n\t ", "word", LONG, LONG, LONG.replace("alpha1", "ALPHA1"), LONG + " end", say(120) + "\n" + LONG[:900], "a" * 3000, "日本語 " * 60, "same line of some length here\n" * 8, "1234 %%", say(60)]
ROWS = [(i, t, R.choice(["en", "de", None]), R.choice(["s1", "s1", "s2", None]), None) for i, t in enumerate(TEXTS)] + [(None, "a null id with words enough to count", "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


ODD = ["a" * 2500, " " * 1500, "日本語" * 300, "", "\n\n x  y", "👍🏽" * 99, "x<|endoftext|>y", "it's we'll"] + ["".join(R.choice("ab é\n'1#s") for _ in range(R.randint(1, 60))) for _ in range(500)]


def test_bpe_matches_library(docs, none):
    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    e, t = bpe.encoder(data, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    assert e.encode_batch(ODD) == [t.encode_ordinary(x) for x in ODD]
    got = bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is not None:
            text, ids = TEXTS[r["doc_id"]] or "", t.encode_ordinary(TEXTS[r["doc_id"]] or "")
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_planes_round_trip_and_files(spark, docs, none, tmp_path):
    for p, n in itertools.product((4, 32), (0, 1, 65_536, 70_000)):
        ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
        assert (planes.unpack(planes.pack(ids, planes=p)) == ids).all() and (planes.unpack(planes.pack(ids, planes=p), 3, 66_000) == ids[3:66_000]).all()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    model = planes._model(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN)
    assert [x.tolist() for x in model.encode_batch(ODD)] == [x.ids for x in t.encode_batch(ODD, add_special_tokens=False)]
    planes.write(docs.where("doc_id is not null"), str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), P.PATTERN, 2)
    start = 0
    for r in planes.read(spark, str(tmp_path / "ids")).orderBy("doc_id").collect():
        ids = [*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    planes.write(none, str(tmp_path / "none"), P.path("byte_bpe_50k.json"), P.PATTERN, 2)
    assert planes.read(spark, str(tmp_path / "none")).count() == 0


def test_planes_take_added_tokens_as_the_library_does(spark, tmp_path):
    end = "<|endoftext|>"
    texts = [*ODD[:60], end, end * 2, f"a {end} b", f"x  {end}\n\n{end}y <|endoftext| {end}", f"<|{end}|>", *(f"{a}{end}{b}" for a, b in itertools.pairwise(ODD[8:60]))]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, start = planes.op3_id_planes(spark, str(tmp_path)).orderBy("doc_id").collect(), 0
    assert t.encode(end, add_special_tokens=False).ids == [50256] and len(got) == len(texts)
    for r, text in zip(got, texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_planes_split_as_the_pattern_does():
    """By re, but for characters that it has no classes for; the library gives no ids but those of new pieces, once."""
    import regex

    split, plain = planes.Split(P.PATTERN), regex.compile(P.PATTERN)
    texts = [f"a{c}1{c}#{c} {c}{c}'s" for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff"]
    texts += ["".join(R.choice("aé ß\n\t\r\x1c\x85\u2028\xa0\u30001²٣'sld#中𝔸👍") for _ in range(R.randint(0, 30))) for _ in range(4000)]
    assert all(split(x) == plain.findall(x) for x in texts)
    assert split.low is not split.any and split.low.findall("l'été 12") == plain.findall("l'été 12")

    m, given = planes.PieceIds(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN), []

    class Watched:
        model = m.model

        def encode_batch_fast(self, texts, **more):
            self.model.pre_tokenizer = self.pre_tokenizer
            given.extend(got := self.model.encode_batch_fast(texts, **more))
            return got

    m.model = Watched()
    texts = [*ODD, *ODD[::-1], say(500)]
    got = m.encode_batch(texts)
    want = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in got] == [x.ids for x in want]
    assert sum(len(x.ids) for x in given) == sum(len(m.encode_batch([p])[0]) for p in m.seen if p not in m.added)


def test_repetition_by_brute_force(docs, none):
    for _ in range(40):
        parts = [[R.randint(0, R.choice([1, 3, 9])) for _ in range(R.randint(0, 30))] for _ in range(4)]
        want = []
        for w in parts:
            for i in range(len(w)):
                best = 0
                for j in range(len(w)):
                    k = 0
                    while i != j and i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert repetition.common_prefixes(np.array(sum(parts, []), np.int64), np.repeat(np.arange(4), [len(p) for p in parts])).tolist() == want
    got = {r["doc_id"]: r for r in repetition.rules(docs).collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"] and got[4]["kept"] and got[11]["n_dup_lines"] == 7 and got[12]["n_symbols"] == 2
    assert {r["doc_id"] for r in repetition.keep(docs).collect()} == {k for k, r in got.items() if r["kept"]}
    assert repetition.rules(none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_join_by_brute_force(spark):
    def changed(s, k):
        s = list(s)
        for _ in range(k):
            i = R.randrange(len(s) + 1)
            s[i : i + R.randint(0, 1)] = R.choice(["", "a", "é"])
        return "".join(s)

    base = ["".join(R.choice("abcé ") for _ in range(R.randint(4, 40))) for _ in range(40)]
    pool = sorted({x for b in base for x in (b, *(changed(b, R.randint(0, 4)) for _ in range(4))) if len(x) > 4})
    d = lines.lines_of(spark.createDataFrame([(i, x) for i, x in enumerate([*pool, *pool[:9]])], "doc_id long, text string"), 5)
    got = [tuple(sorted((r["a"]["line"], r["b"]["line"]))) for r in lines.edit_join(d, 2).collect()]
    kept = [x for x in pool if x.strip()]
    assert sorted(got) == [(a, b) for a, b in itertools.combinations(kept, 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    with pytest.raises(ValueError):
        lines.dedup(d, least=4)


def test_edit_join_of_lines_with_common_parts(spark, monkeypatch):
    """Crowds of lines that share a third of them: all links, and few others reach the verification."""
    rng, seen, verify = random.Random(21), [], lines.within
    monkeypatch.setattr(lines, "within", lambda pairs, *a: seen.append(pairs.count()) or verify(pairs, *a))

    def changed(s, k):
        s = list(s)
        for _ in range(k):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é", "x"])
        return "".join(s)

    def joined(pool):
        d = lines.lines_of(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string"), 20)
        return sorted(tuple(sorted((r["a"]["line"], r["b"]["line"]))) for r in lines.edit_join(d, 2).collect())

    text = "the same words stand in 日本 all of these"
    pool = sorted({changed(text, rng.choice([1, 1, 2, 2, 3, 4])) for _ in range(110)} | {text + x for x in ("", "y", "zz", "äöü")})
    want = [(a, b) for a, b in itertools.combinations(pool, 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    assert joined(pool) == want and len(want) > 200
    ends = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)) for _ in range(120)]
    pool = sorted([*("here a common start, " + x for x in ends), "here a common start, " + ends[0][:-2] + "é"])
    assert joined(pool) == [tuple(sorted(("here a common start, " + ends[0], "here a common start, " + ends[0][:-2] + "é")))]
    assert seen[-1] <= 240  # of 7,140 pairs with the same letters and a segment in common


def test_pipeline_line_dedup_does_not_pair_a_crowd(spark, monkeypatch):
    import corpus_pipeline

    rng, seen, verify = random.Random(5), [], lines.within
    monkeypatch.setattr(lines, "within", lambda pairs, *a: seen.append(pairs.count()) or verify(pairs, *a))
    texts = ["here a common start, " + "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)) for _ in range(60)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, texts[0] + "!"])], DOCS)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, d, None).collect()} == dict(enumerate(texts))
    assert seen[0] <= 120  # of 1,770 pairs with the same letters and a segment in common


def test_neighbours_of_lines_within_two_edits(spark):
    rng, letters = random.Random(8), "abcde é日"
    pairs = []
    for _ in range(400):
        y = list(x := "".join(rng.choices(letters, k=rng.randint(1, 50))))
        for _ in range(2):
            i = rng.randrange(len(y) + 1)
            y[i : i + rng.randint(0, 1)] = rng.choice(["", *letters])
        pairs.append((x, "".join(y)))
    d = spark.createDataFrame(pairs, "x string, y string")
    apart = lines.neighbours_apart(lines.neighbours(F.col("x")), lines.neighbours(F.col("y")))
    assert d.select(F.max(apart)).first()[0] <= 8


def test_line_dedup_query_by_brute_force(spark, tmp_path):
    """Repeated and null doc_ids, rows equal in all, hot lines, ties, long lines, lines of other scripts."""
    rng = random.Random(12)
    base = ["".join(rng.choice("lduscm eé日") for _ in range(rng.choice([3, 19, 20, 21, 60, 700]))) for _ in range(25)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
        return "".join(x)

    rows = [(rng.choice([None, 3, 3, i]), rng.choice([None, "", "a hot line that stands in many texts"]) if i % 7 == 0 else "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(3, rows[5][1]), (3, rows[5][1])]
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    th = {r[0]: r[1] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    first: dict = {}
    each = [((i is not None, i or 0, th[t], k), x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    for at, x in each:
        first[x] = min(first.get(x, at), at)
    near = {x for x in first if len(x) >= 20 and any(len(y) >= 20 and abs(len(x) - len(y)) <= 2 and first[y] < first[x] and x != y and distance(x, y) <= 2 for y in first)}
    want = []
    for i, t in rows:
        kept, n = [], [0, 0]
        for k, x in enumerate((t or "").split("\n")):
            at = (i is not None, i or 0, th[t], k)
            if x in first and (x in near or at != first[x]):
                n[x in near] += 1
            else:
                kept.append(x)
        left = "\n".join(kept)
        want.append((i, *n, left.count("\n") + 1, hashlib.sha256(left.encode()).hexdigest()))
    assert near and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in lines.op6_line_dedup(spark, str(tmp_path)).collect())


def test_line_dedup_rows(spark, none):
    keep, near = "this is a line that stands here", "this is a line that stands hero"
    d = spark.createDataFrame([(1, f"{keep}\nshort\n{keep}\nshort", "x"), (2, f"{near}\n\nanother line that is not like it", "y"), (3, None, "z"), (4, "", None)], "doc_id long, text string, goes string")
    got = {r["doc_id"]: r for r in lines.dedup(d).collect()}
    assert got[1]["text"] == f"{keep}\nshort\nshort" and got[1]["n_copies"] == 1
    assert got[2]["text"] == "\nanother line that is not like it" and got[2]["n_near"] == 1 and got[2]["goes"] == "y"
    assert got[3]["text"] is None and got[4]["text"] == ""
    assert lines.dedup(none).count() == 0


def test_line_dedup_takes_short_copies(spark, tmp_path):
    texts = ["Read more\na line that is long enough to stay\nRead more\n\nx", "Read more\nRead mole\n\nx\n  ", "x", None]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    left = ["Read more\na line that is long enough to stay\n\nx", "Read mole\n\n  ", "", None]
    got = {r["doc_id"]: r for r in lines.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i]["text_sha256"] for i in range(4)] == [hashlib.sha256((t or "").encode()).hexdigest() for t in left]
    assert [(got[i]["n_copies"], got[i]["n_near"]) for i in range(4)] == [(1, 0), (2, 0), (1, 0), (0, 0)]
    import corpus_pipeline

    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, d, None).collect()} == {0: left[0], 1: left[1], 3: None}


def test_mixing_targets(spark, docs, none):
    rows = [(i, " ".join(["w"] * R.randint(0, 30)), "en", R.choice(["a", "a", "a", "b", None])) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = mixing.mix(d, shards=4).collect()
    goals = {r["source"]: r for r in mixing.targets(d.select("source", mixing.n_words("text").alias("n")).groupBy("source").sum("n").withColumnRenamed("sum(n)", "source_size"), [3.0, 1.0, 2.0], 1.5, 2.0).collect()}
    sizes = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in ("a", "b", None)}
    assert abs(sum(r["target"] for r in goals.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(sum(r["mix_size"] for r in m if r["source"] == s) - goals[s]["target"]) <= 30 and goals[s]["target"] <= 2 * sizes[s] + 1e-9
    assert {r["mix_shard"] for r in m} == set(range(4)) and max(sum(1 for r in m if r["doc_id"] == i) for i in range(600)) <= 2
    key = lambda x: sorted((r["doc_id"], r["mix_pass"], r["mix_shard"], r["mix_place"]) for r in x)
    assert key(m) == key(mixing.mix(d.repartition(3), shards=4).collect())
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).count() > 0
    order = [(r["mix_shard"], r["mix_place"]) for r in mixing.in_order(mixing.mixed(d, shards=4)).collect()]
    assert order == sorted(order) and len(order) == len(m)


def test_mixing_query_by_brute_force(spark, tmp_path):
    """Targets computed anew, each source's words near its own; repeated and null doc_ids, empty and long texts."""
    rng = random.Random(21)
    rows = [(rng.choice([None, 7, i, i, i]), rng.choice([None, "", " \n", " ".join(["w"] * min(60, int(rng.paretovariate(0.8)) * 3))]), "en", rng.choice(["a", "a", "a", "b", "é", "c d", "", None, "z"]), 1) for i in range(900)]
    rows += [(5000, "x " * 900, "en", "a", 1), rows[0], rows[0]]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    size = lambda t: len((t or "").split())
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    own = {n: sum(size(r[1]) for r in rows if r[3] == n) for n in names}
    weight, goal, free = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}, {}, set(names)
    while free:
        rest = 1.5 * sum(own.values()) - sum(goal.values())
        over = {n for n in free if rest * weight[n] / sum(weight[m] for m in free) > 2 * own[n]}
        goal |= {n: 2.0 * own[n] for n in over} if over else {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        free -= over or free
    got = mixing.op7_mixing(spark, str(tmp_path)).collect()
    source = {}
    for i, t, _, n, _ in rows:
        source.setdefault((i, size(t), own[n]), n)
    assert sorted(map(repr, ((r["doc_id"], r["size"]) for r in got))) == sorted(map(repr, ((r[0], size(r[1])) for r in rows)))
    by = {}
    for r in got:
        n = next(x for x in names if own[x] == r["source_size"])
        assert abs(r["target"] - goal[n]) < 1e-6 * max(1, goal[n]) and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
        assert len(r["shards"]) == len(r["places"]) and r["taken"] == r["size"] * len(r["shards"])
        by[n] = by.get(n, 0) + r["taken"]
    assert len(set(own.values())) == len(own)
    middle = {n: sorted(size(r[1]) for r in rows if r[3] == n and size(r[1]))[len([1 for r in rows if r[3] == n and size(r[1])]) // 2] for n in names}
    assert all(abs(by.get(n, 0) - goal[n]) <= 3 * middle[n] for n in names), [(n, by.get(n, 0), goal[n], own[n], middle[n]) for n in names]
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.op7_mixing(spark, str(tmp_path)).collect()))


def test_minhash_by_brute_force(spark, docs, none):
    texts = list(TEXTS)
    for _ in range(12):
        w = LONG.split()
        for _ in range(R.randint(0, 12)):
            w[R.randrange(len(w))] = R.choice(["new1", "new2", "new3"])
        texts.append(" ".join(w))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, LONG)], "doc_id long, text string")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: r for r in minhash.near_duplicates(d).collect()}
    assert all(got[i]["component_id"] == find(i) and got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (find(i) == i) for i in range(len(texts)))
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_links_all_texts_of_an_id(spark):
    rng = random.Random(17)
    a, b, c = ([f"w{rng.randrange(10_000)}" for _ in range(120)] for _ in range(3))
    near = lambda w: " ".join([*w[:60], "other", *w[61:]])
    rows = [(9, near(a)), (2, near(b)), (5, " ".join(a)), (5, " ".join(b)), (5, None), (7, " ".join(c)), (7, " ".join(c)), (None, " ".join(a)), (3, "x y"), (4, "X  y")]
    got = sorted(map(repr, map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    want = [(9, 116, 2, False), (2, 116, 2, True), (5, 116, 2, False), (5, 116, 2, False), (5, 0, 5, True), (7, 116, 7, True), (7, 116, 7, True), (None, 116, None, True), (3, 1, 3, True), (4, 1, 3, False)]
    assert got == sorted(map(repr, want))


def test_minhash_makes_few_pairs_of_unlike_variants(spark):
    """Variants of one text that are too far from each other don't meet in pairs, and no similar pair is lost."""
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 62), 1 << 62, 100)
    sets = [np.unique(np.r_[base[rng.permutation(100)[: 100 - k]], rng.integers(-(1 << 62), 1 << 62, k)]) for k in [15] * 120 + [4] * 20]
    rows = [(i, s.tolist(), minhash.parities(s), i) for i, s in enumerate(sets)]
    d = spark.createDataFrame(rows, "doc_id long, shingles array<long>, parities array<long>, c long")
    listed = minhash.prefixes(d, 85).join(d.select("doc_id", "parities", "c"), "doc_id")
    made = [tuple(sorted(r)) for r in minhash.crossing(listed, 85).collect()]
    alike = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * (n := len(np.intersect1d(x, y))) >= 85 * (len(x) + len(y) - n)}
    assert alike and {(j, i) for i, j in alike} <= set(made) and len(set(made)) < 500 + 2 * len(alike)  # of 9,730


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 91), (90, 90)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(e).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[91] == 90


def test_language_codes(spark, docs, none):
    rows = [(i, " ".join(R.choice(w) for _ in range(40)), lang, "s", 1) for i, (lang, w) in enumerate([("en", ["the", "house", "with"]), ("de", ["der", "haus", "mit"]), ("fr", ["le", "maison", "avec"])] * 8)]
    d = spark.createDataFrame(rows, DOCS)
    coder = langid.learn(d)
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(d, coder).collect()} == {r[0]: r[2] for r in rows}
    odd = {r["doc_id"]: r for r in langid.predict(docs, coder).collect()}
    assert odd[0]["lang_pred"] == odd[2]["lang_pred"] == odd[12]["lang_pred"] == "und" and odd[3]["lang_pred"] in ("en", "de", "fr") and 0 <= odd[3]["score"] <= 1
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(none)).collect()} == {"und"}
    code = langid.codewords(12)
    assert min(int((code[a] != code[b]).sum()) for a, b in itertools.combinations(range(12), 2)) >= 5


def test_suffix_dedup_by_brute_force(spark, none):
    part = lambda n: "".join(R.choice("abcdefgh é") for _ in range(n))
    shared, hot = part(320), part(250)
    texts = [None, "", part(199), part(500) + shared, shared[:230] + part(90), part(60) + hot + part(60) + hot, hot, hot, "z" * 450, part(300) + hot[:199], part(20) + shared[100:]]
    texts += [part(40) + hot[: 200 + i] + part(30) for i in range(10)]
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for b in data:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for r in sufdedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        b = data[r["doc_id"]]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        cuts = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        assert bytes(r["kept"]) == bytes(c for c, g in zip(b, gone) if not g) and (r["n_removed"], r["n_spans"]) == (sum(gone), cuts)
    assert sufdedup.dedup(none).count() == 0


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    full, hit = x.astype(np.float64), 0
    for q in range(0, 900, 20):
        score = full @ full[q]
        best = [i for i in np.lexsort((np.arange(900), -np.round(score, 12))) if i != q][:20]
        assert len(got[q]) == 20
        hit += len(set(best) & {i for i, _ in got[q]})
    assert hit >= 0.9 * 45 * 20 and len(got) == 45
    assert [i for i, _ in got[100]] == list(range(101, 121))
    for odd in (v.where("vec_id >= 1000"), v.where("vec_id < 0")):
        assert ann.search(odd, odd).collect() == []


def test_nearest_holds_what_few_queries_found():
    import tracemalloc

    x = np.random.default_rng(4).standard_normal((4000, 8))
    index = ann.SortedProjections(x, np.sqrt((x * x).sum(axis=1)).max(), 16)
    tracemalloc.start()
    got = list(index.nearest(x[:1000], 21))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # what all queries find takes over 16 MB
    for (places, scores), (found, score) in zip(got, index.search(x[:1000], 21)):
        take = np.argsort(-score, kind="stable")[:21]
        assert places.tolist() == found[take].tolist() and scores.tolist() == score[take].tolist()


def plain(words, counts=(), other=0):
    return mlm.Vocabulary(words, mlm.GROUPS, mlm.Spelling(np.zeros(0, np.int64), np.zeros(0)), counts, other)


def test_masked_lm(docs, none):
    vocab = mlm.vocabulary(docs)
    net = mlm.fit(docs, vocab)
    ctx = np.array([[1, 2, 3, 4]], np.int32)
    every = mlm.log_probs(net, np.repeat(ctx, mlm.SIZE + 1, 0), np.arange(mlm.SIZE + 1))
    assert abs(np.exp(every).sum() - 1) < 1e-3
    got = {r["doc_id"]: r for r in mlm.score(docs, vocab, net).collect()}
    assert got[0]["n_words"] == 0 and got[0]["log_likelihood"] == 0 and got[0]["mean"] is None and got[4]["log_likelihood"] == got[5]["log_likelihood"] < 0
    rng = np.random.default_rng(0)
    ids = np.tile(np.arange(1, 9), 4000).astype(np.int32)
    v = plain([b"%d" % i for i in range(8)], [4000] * 8)
    c, trained = mlm.contexts(ids, np.zeros(len(ids), int)), mlm.fresh(v)
    assert abs(mlm.log_probs(trained, c, ids).mean() + np.log(8)) < 0.01
    seen = mlm.squares(trained)
    for _ in range(20):
        mlm.train(trained, c, ids, seen=seen)
    assert mlm.log_probs(trained, c, ids).mean() > mlm.log_probs(trained, c, rng.permutation(ids)).mean() + 1
    assert mlm.score(none, *(lambda v: (v, mlm.fit(none, v)))(mlm.vocabulary(none))).count() == 0


def test_masked_lm_in_double_precision():
    """Probabilities and a step of training by the plain formulas, of flat and of steep networks, in little room."""
    import tracemalloc

    rng, v = np.random.default_rng(7), plain([b"%d" % i for i in range(mlm.SIZE)], range(mlm.SIZE, 0, -1), 500)
    ids, ctx = rng.integers(0, mlm.SIZE + 1, 5000).astype(np.int32), rng.integers(-1, mlm.SIZE + 1, (5000, 4)).astype(np.int32)
    ids[:40] = 0
    for wide in (0.3, 30):
        net = {k: (x + rng.normal(0, wide if k in ("gw", "iw") else 0.1, x.shape)).astype(np.float32) for k, x in mlm.fresh(v).items()}
        n = {k: x.astype(float) for k, x in net.items()}
        x = n["e"][ctx].reshape(5000, -1)
        h = np.tanh(x @ n["w"] + n["b"])
        group, inner, row = (ids + 63) // 64, (ids - 1) % 64, np.arange(5000)
        norm = lambda y: np.exp(y - y.max(1, keepdims=True)) / np.exp(y - y.max(1, keepdims=True)).sum(1, keepdims=True)
        outer, near = norm(h @ n["gw"] + n["gb"]), norm(np.einsum("nh,nhk->nk", h, n["iw"][group - 1]) + n["ib"][group - 1])
        want = np.log(np.maximum(outer[row, group] * np.where(ids > 0, near[row, inner], 1), 1e-37))
        assert mlm.is_steep(mlm.with_bias(net)[1]) == (wide > 1) and np.allclose(mlm.log_probs(net, ctx, ids), want, atol=1e-4, rtol=1e-4)
        d, some = outer / 5000, near / 5000 * (ids > 0)[:, None]
        d[row, group] -= 1 / 5000
        some[row, inner] -= (ids > 0) / 5000
        gi, bi = np.zeros_like(n["iw"]), np.zeros_like(n["ib"])
        np.add.at(gi, group[ids > 0] - 1, (h[:, :, None] * some[:, None])[ids > 0])
        np.add.at(bi, group[ids > 0] - 1, some[ids > 0])
        z = (d @ n["gw"].T + np.einsum("nk,nhk->nh", some, n["iw"][group - 1])) * (1 - h * h)
        e = np.zeros_like(n["e"])
        np.add.at(e, ctx.ravel() % len(e), (z @ n["w"].T).reshape(-1, mlm.DIM))
        seen = {k: np.ones(x.shape, np.float32) for k, x in net.items()}
        mlm.train(net, ctx, ids, seen=seen)
        for k, grad in (("gw", h.T @ d), ("gb", d.sum(0)), ("iw", gi), ("ib", bi), ("w", x.T @ z), ("b", z.sum(0)), ("e", e)):
            assert np.allclose((n[k] - net[k]) / 0.2, grad / np.sqrt(1 + grad**2), atol=4e-6 if wide < 1 else 4e-5, rtol=1e-3), (wide, k)
    ctx, ids = np.tile(ctx, (4, 1))[:16_384], np.tile(ids, 4)[:16_384]
    tracemalloc.start()
    mlm.log_probs(net, ctx, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9e6, peak  # the logits of all rows at once are 4.3 MB, and were there twice


def test_masked_lm_beats_counts_whatever_the_partitions(spark):
    """On documents held out, by words of the vocabulary; the network is the same from 1 and from 32 partitions."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known, held = d.where("doc_id % 10 <> 3"), [r["text"] for r in d.where("doc_id % 10 = 3").collect()]
    vocab = mlm.vocabulary(known)
    nets = [mlm.fit(known.repartition(n), vocab, unit_words=60_000) for n in (1, 32)]
    assert all(np.allclose(nets[0][k], nets[1][k], atol=1e-5) for k in nets[0])
    ids, doc, _, _ = mlm._ids(held, vocab)
    c = mlm.contexts(ids, doc)
    counts, trained = (mlm.log_probs(net, c, ids).mean() for net in (mlm.fresh(vocab), nets[0]))
    assert trained > counts + 0.2, (trained, counts)


def test_masked_lm_spells_words_outside_the_vocabulary(spark):
    rng = random.Random(3)
    rare = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9_000)]
    d = spark.createDataFrame([(i, "the word is " + " of ".join(rare[i * 30 : i * 30 + 30])) for i in range(300)], "doc_id long, text string")
    vocab = mlm.vocabulary(d)
    assert vocab.groups == mlm.GROUPS and {b"the", b"word", b"is", b"of"} <= set(vocab)
    s = vocab.spelling
    for before in (0, 256 * 257 + 256, 98 * 257 + 99, 5):
        assert abs(s.of_keys(before * 257 + np.arange(257)).sum() - 1) < 1e-9
    words = [b"", b"a", b"abc", b"abcdefgha", "l'été".encode()]
    keys, sizes = mlm.spelled(words)
    want = [(bytes([]), 256)]
    for w in words[1:]:
        want += [(w[max(0, i - 2) : i], [*w, 256][i]) for i in range(len(w) + 1)]
    pad = lambda b: [256] * (2 - len(b)) + list(b)
    assert sizes.tolist() == [len(w) + 1 for w in words] and keys.tolist() == [sum(x * 257 ** (2 - i) for i, x in enumerate([*pad(b), c])) for b, c in want]
    texts = ["the word is abcdefg", "the word is hgfedcb", "the word is zqxj#%1"]
    got = {r["doc_id"]: r for r in mlm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocab, mlm.fit(d, vocab)).collect()}
    assert all(got[i]["n_unknown"] == 1 for i in range(3)) and got[0]["log_likelihood"] != got[1]["log_likelihood"] and min(got[0]["log_likelihood"], got[1]["log_likelihood"]) > got[2]["log_likelihood"] + 5
    assert mlm.groups_for(1_000) == mlm.GROUPS and mlm.groups_for(10**8) > 2 * mlm.groups_for(10**7) > 4 * mlm.GROUPS


def test_masked_lm_trains_on_every_place(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 80))) for _ in range(60)] + [None, ""]
    vocab = plain([f"w{i}".encode() for i in range(40)], [9] * 40, 90)
    met, train = [], mlm.train

    def watched(net, ctx, ids, **more):
        met.extend(zip(map(tuple, ctx.tolist()), ids.tolist()))
        train(net, ctx, ids, **more)

    monkeypatch.setattr(mlm, "train", watched)
    net = mlm.fresh(vocab)
    n = mlm.learn(iter([texts[:20], texts[20:], []]), vocab, net)
    want = []
    for t in texts:
        w = [-1, -1, *(vocab.get(x, 0) for x in mlm.words_of(t)), -1, -1]
        want += [((w[i - 2], w[i - 1], w[i + 1], w[i + 2]), w[i]) for i in range(2, len(w) - 2)]
    assert n == len(want) and sorted(met) == sorted(want) and not np.array_equal(net["gw"], mlm.fresh(vocab)["gw"])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ROWS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert len({r["doc_id"] for r in got} & {4, 5, 6, 7}) <= 1


def test_near_dedup_stage_by_brute_force(spark):
    import corpus_pipeline

    rng, texts = random.Random(8), []
    for k in range(30):
        base = [f"w{k}x{rng.randrange(10_000)}" for _ in range(300)]
        for changes in (0, rng.randint(3, 8)):
            w = list(base)
            for i in range(changes):
                w[20 + 30 * i] = f"new{rng.randrange(10_000)}"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    share = {i: len(sets[i - 1] & sets[i]) / len(sets[i - 1] | sets[i]) for i in range(1, len(texts), 2)}
    assert any(0.8 <= s < 0.85 for s in share.values()) and min(share.values()) < 0.8
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, None).collect()} == {i for i in range(len(texts)) if share.get(i, 0) < 0.8}


CLASHING = ["row", "gone", "gone_id", "n_copies", "n_near", "at", "line", "kept", "key", "spans", "s", "b", "parts", "draws", "size", "target", "copies", "mix_size", "mix_pass", "_own", "_block", "_tie", "_size", "sketch", "n_words", "ids", "dotted.name"]
rows_of = lambda d: sorted(repr((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])) for r in d.collect())


def with_clashes(docs):
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(CLASHING)))


def test_stages_keep_columns_of_clashing_names(spark, docs):
    import corpus_pipeline

    more = with_clashes(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, None)
        assert out.columns == more.columns, name
        assert all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHING)), name
        assert rows_of(out) == rows_of(stage(spark, docs, None)), name


def test_operators_take_columns_of_clashing_names(spark, docs):
    more = with_clashes(docs)
    for f in (lines.dedup, mixing.mix):
        out = f(more)
        assert sorted(out.columns) == sorted({*more.columns, *f(docs).columns}) and rows_of(out) == rows_of(f(docs))
    for f in (repetition.rules, minhash.near_duplicates, sufdedup.dedup):
        assert sorted(map(repr, f(more).collect())) == sorted(map(repr, f(docs).collect()))
