"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of bits. For each bit a binary classifier weighs hashed byte n-grams by the log-odds
between the mean profile of the languages with the bit and of those without; its margin is the mean weight over the
n-grams of a text. Decoding takes the language whose codeword has the least loss over all bits, each bit weighted by
how far the language's own profile lies from the bit's boundary. A second codeword almost as near marks the text as
ambiguous.

The profiles are sums over all learning documents (no sample), gathered a partition at a time; the driver holds one
profile a language, and more than `MAX_LANGS` languages are refused.

Edge cases: a null text, or one without letters, is `und` with score 0, as is everything if nothing could be learnt;
documents with a null lang are predicted but teach nothing; a null doc_id counts as the empty text in the fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DIMS, ORDERS, MAX_LANGS = 8192, (1, 2, 3, 4), 2000
LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters becomes a blank.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text."""
    b = np.frombuffer(b" " + text.lower().encode().translate(PLAIN) + b" ", np.uint8).astype(np.uint32)
    out, h = np.zeros(DIMS, np.int64), np.full(len(b), 2166136261, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] ^ b[n - 1 :]) * np.uint32(16777619)
        if n in ORDERS:
            out += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(19), minlength=DIMS)
    return out


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, a row a language: all splits for few languages, else the best of seeded random codes."""
    if n <= 7:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if k == 0 or c >> (k - 1) & 1 else -1 for c in range(bits)] for k in range(n)], np.int8)
    rng, best, far = np.random.default_rng(n), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(20):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = ((code.shape[1] - code.astype(np.int32) @ code.T.astype(np.int32)) // 2 + np.eye(n, dtype=int) * bits).min()
        if apart > far:
            best, far = code, apart
    return best


class Coder:
    """Classifiers and decoder for profiles (a row of counts a language)."""

    def __init__(self, langs: list[str], counts: np.ndarray, sharp: float = 8.0, near: float = 0.1):
        self.langs, self.sharp, self.near = langs, sharp, near
        if not langs:
            return
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.code = codewords(len(langs))
        self.weights = np.zeros((DIMS, self.code.shape[1]))
        for b, bit in enumerate(self.code.T):
            rest = p[bit < 0].mean(axis=0) if (bit < 0).any() else np.full(DIMS, 1 / DIMS)
            self.weights[:, b] = np.log(p[bit > 0].mean(axis=0)) - np.log(rest)
        own = p @ self.weights  # margins of the languages' own profiles
        self.scale = np.abs(own).mean(axis=0) + 1e-12
        trust = np.maximum(own * self.code, 1e-6)
        self.trust = trust / trust.sum(axis=1, keepdims=True)

    def decode(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and whether another language is almost as near."""
        z = counts @ self.weights / max(1, counts.sum()) / self.scale
        loss = (self.trust * np.logaddexp(0, -2 * self.code * z)).sum(axis=1)
        share = np.exp(-self.sharp * (loss - loss.min()))
        share /= share.sum()
        top = np.argsort(-share, kind="stable")
        return self.langs[top[0]], float(share[top[0]]), len(top) > 1 and bool(share[top[0]] - share[top[1]] < self.near)


def learn(docs: DataFrame) -> Coder:
    """Profiles of the languages of all given documents (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LETTER.search(text):
                    if lang not in sums:
                        sums[lang] = np.zeros(DIMS, np.int64)
                    sums[lang] += profile(text)
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.tolist()], pa.list_(pa.int64()))], names=["lang", "counts"])

    parts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, counts array<bigint>")
    sums = parts.select("lang", F.posexplode("counts").alias("at", "n")).where("n > 0").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list(F.struct("at", "n")).alias("c")).sort("lang").limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    rows.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(rows), DIMS))
    for k, r in enumerate(rows):
        for at, n in r["c"]:
            counts[k, at] = n
    return Coder([r["lang"] for r in rows], counts)


def predict(docs: DataFrame, coder: Coder) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            got = [c.decode(profile(t)) if t and c.langs and LETTER.search(t) else ("und", 0.0, False) for t in batch.column(1).to_pylist()]
            lang, score, close = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    coder = learn(docs.where(~held))
    return predict(docs, coder).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
