"""LM scoring by masked pseudo-likelihood: every word is predicted from the words on both its sides.

The vocabulary holds the commonest words of the corpus, counted over all documents, in groups of 64: 64 groups, and more
with the root of the number of distinct words (words as common as the first that has no place are left out with it).
Every other word is the class 0, a group of its own, and is spelled: each byte is predicted from the two before it by
interpolated counts (Witten-Bell) over all such words of the corpus, less what that gives to words of the vocabulary. A
network embeds the two words before and the two after the masked place (beyond a text's ends: a padding word), one tanh
layer reads them, and a two-level softmax (groups of words, 64 words in a group) gives the probability of the masked
word or class. A document's score is the sum of the log-probabilities of all its words.

Training masks every place of every document once. The output biases start at the logarithms of the words' shares of
the corpus, so that training begins at what counts alone predict. Documents are dealt to units by a hash of what they
hold, as many units as the corpus's words ask for, whatever its partitions; in each of three rounds, over growing shares
of the units, every unit trains from the last round's network on its own places, in the order of the hash, and the
networks are averaged, weighted by their places (sums by part of the network and salt, so that no task meets all
networks). What is counted and trained on grows with the corpus.

Edge cases: null or empty texts have no words, log_likelihood 0 and a null mean; equal texts get equal scores but for the
last bits (a product of matrices in single precision depends on a row's place in it); an empty corpus has no vocabulary, and all bytes are alike; a text of any length is read a million characters at a time or
whole; rows equal in doc_id and text fall to one unit; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, saved, slices, table

GROUPS, IN_GROUP, SIDE, DIM, HIDDEN = 64, 64, 2, 8, 16
SIZE, PAD = GROUPS * IN_GROUP, -1  # the last row of e
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK, BLOCK = 4096, 2048  # BLOCK: rows whose softmax stays in a core's cache
BYTES, BEFORE, HELD = 257, 2, 600_000  # 256 stands before a word and at its end
ROUNDS = (0, 1, 4, 16)  # sixteenths of the documents that each round ends at


def shapes(groups: int) -> dict[str, tuple[int, ...]]:
    return {"e": (groups * IN_GROUP + 2, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "gw": (HIDDEN, groups + 1), "gb": (groups + 1,), "iw": (groups, HIDDEN, IN_GROUP), "ib": (groups, IN_GROUP)}


def groups_for(distinct: int, least: int = GROUPS) -> int:
    """Groups of the vocabulary of a corpus of so many distinct words."""
    return max(least, math.isqrt(distinct) // 16)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def fresh(vocab: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """A network that predicts what the counts of the words do."""
    rng, net = np.random.default_rng(seed), {}
    for k, s in shapes(vocab.groups).items():
        net[k] = (np.zeros(s) if k in ("b", "gw", "gb", "iw", "ib") else rng.normal(0, 0.5 if k == "e" else 0.3, s)).astype(np.float32)
    share = np.full(vocab.groups * IN_GROUP, 1e-3)
    share[: len(vocab.counts)] = vocab.counts
    share = share.reshape(-1, IN_GROUP)
    net["gb"][:] = np.log(np.r_[vocab.other + 0.5, share.sum(axis=1)] / (vocab.other + 0.5 + share.sum()))
    net["ib"][:] = np.log(share / share.sum(axis=1, keepdims=True))
    return net


def contexts(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ids of the words around each place, in its own document."""
    n = len(ids)
    out = np.full((n, 2 * SIDE), PAD, np.int32)
    for c, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), n - max(0, d)
        if b > a:
            out[a:b, c] = np.where(doc[a:b] == doc[a + d : b + d], ids[a + d : b + d], PAD)
    return out


def with_bias(net: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both levels with the biases as their last row, for hidden()'s column of ones."""
    return np.concatenate([net["gw"], net["gb"][None]]), np.concatenate([net["iw"], net["ib"][:, None]], axis=1)


def is_steep(w: np.ndarray) -> bool:
    """Whether the exponentials of h @ w could leave single precision; no value of h is beyond 1."""
    return not np.abs(w).sum(axis=-2).max() < 60


def exps(h: np.ndarray, w: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials that a softmax divides by their sums, and these."""
    x = h @ w
    if steep:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x.sum(axis=1)


def hidden(net: dict, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the tanh layer reads, and what it gives, with a last column of ones."""
    x, h = net["e"].take(ctx, axis=0, mode="wrap").reshape(len(ctx), -1), np.ones((len(ctx), HIDDEN + 1), np.float32)
    y = x @ net["w"]
    y += net["b"]
    np.tanh(y, out=h[:, :HIDDEN])
    return x, h


def by_group(ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each id, an order by group, and where each group ends in it."""
    group = ((ids + IN_GROUP - 1) // IN_GROUP).astype(np.uint16)
    return group, np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=groups + 1))


def log_probs(net: dict, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each id from its context."""
    _, h = hidden(net, ctx)
    (gw, iw), out = with_bias(net), np.empty(len(ids), np.float32)
    group, order, end = by_group(ids, len(iw))
    steep, inner_steep = is_steep(gw), is_steep(iw)
    for a in range(0, len(ids), BLOCK):
        p, total = exps(h[a : a + BLOCK], gw, steep)
        out[a : a + BLOCK] = p[np.arange(len(p)), group[a : a + BLOCK]] / total
    hs, inner, near = h[order], (ids[order] - 1) % IN_GROUP, np.ones(len(ids), np.float32)
    for g in np.flatnonzero(np.diff(end)).tolist():
        a, b = end[g], end[g + 1]
        p, total = exps(hs[a:b], iw[g], inner_steep)
        near[a:b] = p[np.arange(b - a), inner[a:b]] / total
    out[order] *= near
    return np.log(np.maximum(out, 1e-37))


def squares(net: dict) -> dict[str, np.ndarray]:
    return {k: np.full(v.shape, 1e-8, np.float32) for k, v in net.items()}


def train(net: dict, ctx: np.ndarray, ids: np.ndarray, rate: float = 0.2, seen: dict | None = None) -> None:
    """Adagrad on the masked places, once each, in place; seen holds the squares of what came before, from squares()."""
    seen = squares(net) if seen is None else seen
    groups = len(net["ib"])
    batch = 256 * groups

    def move(k, grad):
        seen[k] += grad * grad
        net[k] -= rate * grad / np.sqrt(seen[k])

    mixed = np.random.default_rng(len(ids)).permutation(len(ids))
    for a in range(0, len(mixed), batch):
        at = mixed[a : a + batch]
        c, y, n = ctx[at], ids[at], np.float32(len(at))
        x, h = hidden(net, c)
        (gw, iw), back, one = with_bias(net), np.empty((len(at), HIDDEN), np.float32), 1 / n
        group, order, end = by_group(y, groups)
        steep, inner_steep, of_gw, of_iw = is_steep(gw), is_steep(iw), np.zeros_like(gw), np.zeros_like(iw)
        for i in range(0, len(at), BLOCK):
            hb = h[i : i + BLOCK]
            p, total = exps(hb, gw, steep)
            p *= (one / total)[:, None]
            p[np.arange(len(hb)), group[i : i + BLOCK]] -= one
            np.matmul(p, net["gw"].T, out=back[i : i + BLOCK])
            of_gw += hb.T @ p
        hs, inner, deep = h[order], (y[order] - 1) % IN_GROUP, np.zeros_like(back)
        for g in np.flatnonzero(np.diff(end)).tolist():
            i, j = end[g], end[g + 1]
            p, total = exps(hs[i:j], iw[g], inner_steep)
            p *= (one / total)[:, None]
            p[np.arange(j - i), inner[i:j]] -= one
            np.matmul(p, net["iw"][g].T, out=deep[i:j])
            np.matmul(hs[i:j].T, p, out=of_iw[g])
        back[order] += deep
        h = h[:, :HIDDEN]
        z = back * (1 - h * h)
        into, size = z @ net["w"].T, len(net["e"])
        flat = np.where(c < 0, size - 1, c).ravel()
        e = np.stack([np.bincount(flat, into[:, k::DIM].ravel(), size) for k in range(DIM)], axis=1).astype(np.float32)
        for k, grad in (("iw", of_iw[:, :-1]), ("ib", of_iw[:, -1]), ("gw", of_gw[:-1]), ("gb", of_gw[-1]), ("w", x.T @ z), ("b", z.sum(axis=0)), ("e", e)):
            move(k, grad)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every byte and end of the words, each with the BEFORE bytes before it, and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    signs = np.full(int(size.sum()) + (BEFORE + 1) * len(words), BYTES - 1, np.int64)
    place = np.arange(int(size.sum())) + np.repeat(np.arange(len(words)) * (BEFORE + 1) + BEFORE, size)
    signs[place] = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(int(size.sum()) + len(words)) + np.repeat(np.arange(1, len(words) + 1) * BEFORE, size + 1)
    key = signs[at - BEFORE]
    for j in range(BEFORE - 1, -1, -1):
        key = key * BYTES + signs[at - j]
    return key, size + 1


class Spelling:
    """Probabilities of words by their bytes, from the counts of all keys of spelled()."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels, self.rest = [], 0.0
        for k in range(BEFORE + 1 if len(keys) else 0):
            key, place = np.unique(keys % BYTES ** (k + 1), return_inverse=True)
            n = np.bincount(place, counts, len(key))
            before, start = np.unique(key // BYTES, return_index=True)
            self.levels.append((key, n, before, np.add.reduceat(n, start), np.diff([*start, len(key)])))
        self.known = np.zeros(0, np.int64)
        if self.levels:
            self.known, self.logs = self.levels[-1][0], np.log(self.of_keys(self.levels[-1][0]))

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / BYTES)
        for k, (key, n, before, total, kinds) in enumerate(self.levels):
            own = keys % BYTES ** (k + 1)
            i = np.minimum(np.searchsorted(key, own), len(key) - 1)
            j = np.minimum(np.searchsorted(before, own // BYTES), len(before) - 1)
            p = np.where(before[j] == own // BYTES, (np.where(key[i] == own, n[i], 0) + kinds[j] * p) / (total[j] + kinds[j]), p)
        return p

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word, given that it is none of the vocabulary."""
        if not words:
            return np.zeros(0)
        keys, size = spelled(words)
        logs = np.empty(len(keys))
        at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        met = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        if met.any():
            logs[met] = self.logs[at[met]]
        logs[~met] = np.log(self.of_keys(keys[~met]))
        return np.add.reduceat(logs, np.cumsum(size) - size) - self.rest

    def leave_out(self, words: list[bytes]) -> None:
        """What these words have goes to all others."""
        self.rest = float(np.log1p(-np.exp(self.log_probs(words)).sum()))


class Vocabulary(dict):
    """Ids of words, from 1, for a network of so many groups; the words' counts, those of all others, and their spelling."""

    def __init__(self, words: list[bytes], groups: int, spelling: Spelling, counts: list[int] = (), other: int = 0):
        super().__init__((w, k) for k, w in enumerate(words, 1))
        self.groups, self.spelling, self.counts, self.other = groups, spelling, list(counts), other

    def __reduce__(self):
        return Vocabulary, (list(self), self.groups, self.spelling, self.counts, self.other)


def _ids(texts: list[str | None], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[int], list[bytes]]:
    """Ids of the words, their documents, the words of each document, and all words."""
    words = [words_of(t) for t in texts]
    counts = [len(w) for w in words]
    flat = [w for part in words for w in part]
    get = vocab.get
    ids = np.fromiter(map(get, flat, repeat(0)), np.int32, len(flat))
    return ids, np.repeat(np.arange(len(texts)), counts), counts, flat


def vocabulary(docs: DataFrame, size: int = SIZE) -> Vocabulary:
    """The commonest words, `size` of them or more in a large corpus, and the spelling of the others; counts cover all
    documents. The driver gets the words, how many words there are of each count, and the counts of three bytes in a row,
    of which there are 257 ** 3 at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(words_of(text))
                if len(n) > 200_000:
                    yield out()
                    n.clear()
        yield out()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b in slices([len(w) for w in words], 1_000_000):
                keys, sizes = spelled(words[a:b])
                key, place = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(place, np.repeat(n[a:b], sizes)).astype(np.int64))], names=["key", "n"])

    counted = saved(docs.where("text is not null").select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    by_count = sorted(((r["n"], r["words"]) for r in counted.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    groups, taken, least = groups_for(sum(words for _, words in by_count), size // IN_GROUP), 0, math.inf
    for n, words in by_count:
        taken += words
        if taken > groups * IN_GROUP:
            break
        least = n
    common = F.col("n") >= F.lit(least)
    rows = sorted(counted.where(common).collect(), key=lambda r: (-r["n"], r["word"]))
    words, counts = [bytes(r["word"]) for r in rows], [r["n"] for r in rows]
    rest = counted.where(~common).mapInArrow(spell, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    drop_saved(counted)
    spelling = Spelling(rest.column("key").to_numpy(), rest.column("n").to_numpy())
    spelling.leave_out(words)
    return Vocabulary(words, groups, spelling, counts, sum(n * words for n, words in by_count) - sum(counts))


def learn(lists: Iterator[list[str | None]], vocab: Vocabulary, net: dict[str, np.ndarray]) -> int:
    """Trains net on every place of the texts once; the number of places."""
    n, seen = 0, squares(net)
    for texts in lists:
        for a, b in slices([len(t or "") for t in texts], 1_000_000):
            ids, doc, _, _ = _ids(texts[a:b], vocab)
            train(net, contexts(ids, doc), ids, seen=seen)
            n += len(ids)
    return n


def fit(docs: DataFrame, vocab: Vocabulary, unit_words: int = 4_000_000, most_units: int = 8192, salts: int = 64) -> dict[str, np.ndarray]:
    """The network after all rounds."""
    at = F.xxhash64(F.col("doc_id").cast("string"), "text")
    marked = docs.where("text is not null").select("text", at.alias("at"))
    net, total = fresh(vocab), vocab.other + sum(vocab.counts)
    for first, last in zip(ROUNDS, ROUNDS[1:]):
        units = min(most_units, max(1, round(total * (last - first) / ROUNDS[-1] / unit_words)))
        part = F.pmod("at", F.lit(ROUNDS[-1]))
        mine = marked.where((part >= first) & (part < last)).repartition(units, F.xxhash64("at")).sortWithinPartitions("at").select("text")
        net = one_round(mine, vocab, net, salts)
    return net


def one_round(docs: DataFrame, vocab: Vocabulary, net: dict[str, np.ndarray], salts: int) -> dict[str, np.ndarray]:
    """The average of the networks that the partitions of docs (text) make of net."""
    sent, names = docs.sparkSession.sparkContext.broadcast((vocab, net)), list(shapes(vocab.groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, (vocab, start) = TaskContext.get().partitionId(), sent.value
        own = {k: v.copy() for k, v in start.items()}
        n = learn((batch.column(0).to_pylist() for batch in batches), vocab, own)
        if n:
            flat = np.concatenate([own[k].reshape(-1) for k in names]).astype(np.float64) * n
            for k, a in enumerate(range(0, len(flat), CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[a : a + CHUNK].tobytes()], pa.binary())], names=["chunk", "part", "n", "data"])

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        data = sum(np.frombuffer(x, np.float64) for x in t.column("data").to_pylist())
        return pa.table([t.column("chunk")[:1], pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "part", "n", "data"])

    schema = "chunk int, part int, n bigint, data binary"
    some = docs.mapInArrow(run, schema).withColumn("part", F.col("part") % salts).groupBy("chunk", "part").applyInArrow(total, schema)
    rows = sorted(some.groupBy("chunk").applyInArrow(total, schema).collect(), key=lambda r: r["chunk"])  # one network
    if not rows:
        return net
    flat, out, a = np.concatenate([np.frombuffer(r["data"], np.float64) / r["n"] for r in rows]), {}, 0
    for k, s in shapes(vocab.groups).items():
        out[k] = flat[a : a + int(np.prod(s))].reshape(s).astype(np.float32)
        a += int(np.prod(s))
    return out


class _Met(dict):
    """Numbers of words, in the order in which they were first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def score(docs: DataFrame, vocab: Vocabulary, net: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_words, n_unknown, log_likelihood, mean of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vocab, net), seen, logs = sent.value, _Met(), np.zeros(0)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 1_000_000):
                ids, doc, counts, flat = _ids(texts[a:b], vocab)
                got = np.zeros(len(ids))
                c = contexts(ids, doc)
                for k in range(0, len(ids), 16_384):
                    got[k : k + 16_384] = log_probs(net, c[k : k + 16_384], ids[k : k + 16_384])
                other = np.flatnonzero(ids == 0)
                if len(seen) > HELD:
                    seen, logs = _Met(), np.zeros(0)
                number = np.fromiter(map(seen.__getitem__, map(flat.__getitem__, other.tolist())), np.int64, len(other))
                if len(seen) > len(logs):
                    logs = np.concatenate([logs, vocab.spelling.log_probs(list(islice(seen, len(logs), None)))])
                got[other] += logs[number]
                total = np.bincount(doc, got, b - a) if len(ids) else np.zeros(b - a)
                unknown = np.bincount(doc, ids == 0, b - a).astype(np.int64) if len(ids) else np.zeros(b - a, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(unknown), pa.array(total)], names=["doc_id", "n_words", "n_unknown", "log_likelihood"])

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_unknown bigint, log_likelihood double")
    return out.withColumn("mean", F.try_divide("log_likelihood", "n_words"))


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab = vocabulary(docs)
    return score(docs, vocab, fit(docs, vocab))
