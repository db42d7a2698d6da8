"""Quality rules: base counts of a text, and its repetition by a suffix array over words.

A word is a run of characters other than space and 0x09-0x0D. For many documents at once, prefix doubling in numpy
sorts the suffixes (only those still tied go on), keeping the ranks of every level; common prefixes of neighbours come
from the ranks, level by level. The innermost interval of common prefixes around a suffix gives the longest substring
that starts there and occurs elsewhere in its text; the spans of those of at least `min_words` words are united. A
document passes the method if the spans cover at most `max_covered` of its words and the longest repeat has at most
`max_repeat` words.

Edge cases: a null or empty text has no words and fails the base rules; repeated documents get equal rows; repeats
never cross documents; overlapping repeats count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spare, table

BLANKS, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    min_words: int = 5
    max_covered: float = 0.45
    max_repeat: int = 150
    least_words: int = 50
    window: int = 3
    max_repeat_words: float = 0.5


def common_prefixes(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the words that the suffix there shares with the most similar other suffix of its document."""
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    ends = np.searchsorted(doc, doc, side="right")  # doc ascends
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, h = [rank], 1
    while True:
        size = np.diff(np.r_[np.flatnonzero(new), n])
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        at = order[tied]
        head = rank[at]
        nxt = np.where(at + h < ends[at], rank[np.minimum(at + h, n - 1)], -1)
        again = np.lexsort((nxt, head))
        at, head, nxt = at[again], head[again], nxt[again]
        order[tied] = at
        fresh = np.r_[True, (head[1:] != head[:-1]) | (nxt[1:] != nxt[:-1])]
        places = np.flatnonzero(tied)
        new[places] = fresh
        rank = rank.copy()
        rank[at] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        levels.append(rank)
        h *= 2
    i, j = order[:-1].copy(), order[1:].copy()
    pair = np.flatnonzero(levels[0][i] == levels[0][j])
    i, j = i[pair], j[pair]
    got = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((i < n) & (j < n))
        ok = ok[(doc[i[ok]] == doc[order[pair[ok]]]) & (doc[j[ok]] == doc[order[pair[ok]]])]
        ok = ok[levels[k][i[ok]] == levels[k][j[ok]]]
        got[ok] += 1 << k
        i[ok] += 1 << k
        j[ok] += 1 << k
    np.maximum.at(best, order[pair], got)
    np.maximum.at(best, order[pair + 1], got)
    return best


def covered(best: np.ndarray, least: int, fixed: int | None = None) -> np.ndarray:
    """Positions under the spans that start where best is at least `least`; spans are best long, or `fixed`."""
    at = np.flatnonzero(best >= least)
    edge = np.zeros(len(best) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (best[at] if fixed is None else fixed), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], limits: Limits) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat of each text."""
    ids: dict[bytes, int] = {}
    word_of, counts, base = [], [], []
    for t in texts:
        b = t.encode()
        words = b.split()
        counts.append(len(words))
        word_of.extend([ids.setdefault(w, len(ids)) for w in words])
        solid = b.translate(None, BLANKS)
        lines = [x for x in b.split(b"\n") if x.strip()]
        base.append((len(words), len(t) - (len(b) - len(solid)), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
    doc = np.repeat(np.arange(len(texts)), counts)
    best = common_prefixes(np.array(word_of, np.int64), doc)
    sums = [np.bincount(doc, covered(best, *x), len(texts)).astype(np.int64).tolist() if len(doc) else [0] * len(texts) for x in ((limits.window, limits.window), (limits.min_words,))]
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, best)
    return [(*x, r, c, g) for x, r, c, g in zip(base, *sums, longest.tolist())]


def rules(docs: DataFrame, limits: Limits = Limits(), slice_chars: int = 500_000) -> DataFrame:
    """The measures of every document with base_failed and kept. One pass without a shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], slice_chars):
                cols = list(zip(*measure(texts[a:b], limits)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *names])
        spare()

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))
    failed = (F.col("n_words") < limits.least_words) | (F.col("n_repeat_words") > limits.max_repeat_words * F.col("n_words"))
    passed = (F.col("covered_words") <= limits.max_covered * F.col("n_words")) & (F.col("longest_repeat") <= limits.max_repeat)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)


def keep(docs: DataFrame, limits: Limits = Limits(), slice_chars: int = 500_000) -> DataFrame:
    """The documents that pass, with all their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            ok = []
            for a, b in slices([len(t) for t in texts], slice_chars):
                for n, _, _, _, r, c, g in measure(texts[a:b], limits):
                    ok.append(n >= limits.least_words and r <= limits.max_repeat_words * n and c <= limits.max_covered * n and g <= limits.max_repeat)
            yield batch.filter(pa.array(ok, pa.bool_()))
        spare()

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow can't take names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))
