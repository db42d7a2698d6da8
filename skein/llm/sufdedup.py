"""Suffix-array dedup: remove every byte under a string of `least` bytes that starts anywhere else too.

Sorting the suffix at every byte would move the corpus 200 times over. Anchors thin them out: the least hash of the
48-byte grams in a window of `least` bytes (leftmost of equals) is the window's anchor, so equal windows have equal
anchors at the same place, and consecutive windows mostly share theirs. A run is the windows of one anchor; its
context is the bytes under them.

1. Each text gives its runs: hash of the gram, hash of the context, place. Grams met once are dropped.
2. Runs of equal gram and equal context are one class; with two members or more, every window of the class repeats.
3. Classes of a gram with other contexts beside it are compared as suffixes: sampled splitters range-partition them by
   the gram's leading bytes; a bucket sorts the suffixes at all their windows by multikey quicksort, eight bytes at a
   time, going on with tied suffixes only. Neighbours with `least` bytes in common repeat. A gram lies in one bucket
   (equal keys are never split by a range), so no suffix has a partner beyond a bucket's end.
4. The windows that repeat are joined to spans and cut from the texts.

Copies of a passage are counted by class before anything is gathered; what meets in a bucket are its distinct forms.

Edge cases: null and short texts lose nothing; matches never cross documents; equal texts of `least` bytes or more go
whole, whatever their doc_ids; rows equal in doc_id and text share their spans; overlapping repeats inside one text
count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table

GRAM = 48
BYTES = np.random.default_rng(48).integers(0, 1 << 64, (2, 256), np.uint64)
BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n, base, np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class _Rolling:
    """Hashes of any substrings of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(20, int(len(data)).bit_length())
        self.back = _powers(pow(BASE[which], -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[which][data] * _powers(BASE[which], size)[: len(data)], out=self.sums[1:])

    def of(self, first, last) -> np.ndarray:
        return _mixed((self.sums[last] - self.sums[first]) * self.back[first])


def runs(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """text, gram, context, first, windows, offset of the runs in some texts; first is the place in its own text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(data), least - GRAM + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if not len(sizes) or sizes.max() < least:
        return empty
    begins = np.cumsum(sizes) - sizes
    gram = _Rolling(data, 0)
    h = _mixed((gram.sums[GRAM:] - gram.sums[:-GRAM]) * gram.back[: n - GRAM + 1])
    bits = np.uint64(max(22, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = np.full(-(-len(v) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - least + 1
    place = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & low).astype(np.int64)
    count = np.maximum(sizes - least + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
    anchor = place[at]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first, windows = at[new], np.diff(np.r_[new, len(at)])
    text, anchor = text[new], anchor[new]
    last = first + windows - 1 + least
    context = _Rolling(data, 1).of(first, last) + (last - first).astype(np.uint64) * np.uint64(BASE[0])
    return text, h[anchor].view(np.int64), context.view(np.int64), first - begins[text], windows, anchor - first


def repeats(group: np.ndarray, data: list[bytes], least: int, offset: np.ndarray, most: int = 400_000) -> list[np.ndarray]:
    """For each context, which of its windows another context of its group has too.

    Windows can only be equal if their anchors have the same place in them, so suffixes are first told apart by group
    and that place, then eight bytes at a time.
    """
    windows = np.array([len(d) - least + 1 for d in data], np.int64)
    out = [np.zeros(w, bool) for w in windows.tolist()]
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True])
    for a, b in slices((np.add.reduceat(windows[order], edge[:-1])).tolist(), most):
        mine = order[edge[a] : edge[b]]
        flat = np.frombuffer(b"".join(data[i] for i in mine) + bytes(8), np.uint8)
        begin = np.cumsum([0, *(len(data[i]) for i in mine[:-1])])
        count = windows[mine]
        owner = np.repeat(np.arange(len(mine)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[owner] + k
        words = np.zeros(len(flat) - 7, np.uint64)  # the eight bytes from each place, first byte highest
        for j in range(8):
            words |= flat[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        key = np.searchsorted(group[order][edge[a:b]], group[mine][owner]) * (least + 1) + offset[mine][owner] - k
        tied = np.arange(len(owner))
        tied, key = _still_tied(tied, key)
        for d in [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]:
            if not len(tied):
                break
            tied, key = _still_tied(tied, key, words[at[tied] + d])
        for i, w in zip(owner[tied].tolist(), k[tied].tolist()):
            out[mine[i]][w] = True
    return out


def _still_tied(rows: np.ndarray, key: np.ndarray, char: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are equal to another in key and char, in order, and their new keys."""
    order = np.argsort(key, kind="stable") if char is None else np.lexsort((char, key))
    key, rows = key[order], rows[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    if char is not None and len(key):
        char = char[order]
        new[1:] |= char[1:] != char[:-1]
    ranks = np.cumsum(new)
    keep = np.bincount(ranks, minlength=1)[ranks] > 1
    return rows[keep], ranks[keep]


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans, bytes cut, and how many pieces were cut out."""
    left, at, cuts, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            left.append(text[at:a])
            cuts += 1
        end = at = max(end, b)
    rest = b"".join([*left, text[at:]]) if spans else text
    return rest, len(text) - len(rest), cuts


RUN = "key bigint, gram bigint, context bigint, first int, windows int, offset int"


def run_table(docs: DataFrame, least: int, only_gram: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 1 << 19):
                text, *cols = runs(texts[a:b], least)
                if only_gram:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0])], names=["gram"])
                    continue
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][text]), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in RUN.split(", ")])

    return docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "gram bigint" if only_gram else RUN)


def spans(d: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """key, a, b: spans of windows that repeat (d has key and text), and the tables to drop when they are used up."""
    again = run_table(d, least, only_gram=True).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("g"))
    found = saved(run_table(d, least).join(again, F.col("gram") == F.col("g")).drop("g"), "runs")
    classes = saved(found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "windows", "offset")).alias("r")), "run-classes")
    c = classes.where("n > 1").select(F.col("gram").alias("cg"), F.col("context").alias("cc"))
    whole = found.join(c, (F.col("gram") == F.col("cg")) & (F.col("context") == F.col("cc"))).select("key", F.col("first").alias("a"), (F.col("first") + F.col("windows") - 1 + least).alias("b"))
    mixed = classes.groupBy("gram").agg(F.count("*").alias("forms"), F.min("n").alias("fewest")).where("forms > 1 and fewest = 1").select(F.col("gram").alias("mg"))
    wanted = classes.join(mixed, F.col("gram") == F.col("mg")).select("gram", "n", "r.*")
    asked = wanted.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("gram", "n", "first", "windows", "offset")).alias("asked"))
    texts = d.select("key", "text").hint("merge").join(asked, F.col("key") == F.col("k")).select("key", F.col("text").cast("binary").alias("text"), "asked")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                part = [text[x["first"] : x["first"] + x["windows"] - 1 + least] for x in asked]
                lead = [p[x["offset"] : x["offset"] + GRAM] for p, x in zip(part, asked)]
                cols = [pa.array(lead, pa.binary()), *(pa.array([x[c] for x in asked], pa.int64()) for c in ("gram", "n", "first", "offset"))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([key] * len(asked), pa.int64()), pa.array(part, pa.binary())], names=["lead", "gram", "n", "first", "offset", "key", "data"])

    schema = "lead binary, gram bigint, n bigint, first bigint, offset bigint, key bigint, data binary"
    bucketed = texts.mapInArrow(contexts, schema).repartitionByRange("lead").sortWithinPartitions("lead", "gram")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grams = batch.column(1).to_numpy()
            last = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if (grams != grams[-1]).any() else 0
            if last or (held and held[-1].column(1)[-1] != batch.column(1)[0]):
                yield matched([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield matched(held)

    def matched(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches([p for p in parts if p.num_rows])
        data, gram, n, first, offset, key = (t.column(c).to_pylist() for c in ("data", "gram", "n", "first", "offset", "key"))
        keys, a, b = [], [], []
        for i, hit in enumerate(repeats(np.array(gram), data, least, np.array(offset))):
            if n[i] == 1 and hit.any():
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    keys.append(key[i])
                    a.append(first[i] + x)
                    b.append(first[i] + y - 1 + least)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["key", "a", "b"])

    return whole.unionByName(bucketed.mapInArrow(compare, "key bigint, a int, b int")), [found, classes]


def dedup(docs: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept of every document."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    found, _ = spans(d.select("key", "text"), least)
    each = found.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    j = d.hint("merge").join(each, F.col("key") == F.col("k"), "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(t), *cut(t, [(x["a"], x["b"]) for x in s or []])) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            size, kept, gone, cuts = zip(*out) if out else ((), (), (), ())
            cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return j.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
