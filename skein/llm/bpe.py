"""Byte-level BPE: encoding by rank, decoding, over whole texts.

Pieces of the split pattern that a worker has not met go, by length, into padded matrices of token ids. Each round
every row merges its leftmost pair of least rank; the ranks of pairs come from an open-addressing hash table. Rows
without a pair to merge leave the matrix (compaction). A piece over ``LONG`` bytes is a matrix of one row, in which a
round merges all places of the least pair, from left to right, where that can't differ from merging one at a time:
where no pair that this makes, even for a while, has a lower rank.

Edge cases: a null or empty text has no ids; equal texts get equal ids; a piece that is itself a token is that token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, splitter, table

LONG = 1024  # bytes of a row that shares its matrix
NONE = np.int32(2**31 - 1)
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512, LONG)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens by rank from the text of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class BytePairs:
    """Encoder and decoder for one rank table. `held` bounds the pieces that a worker remembers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, held: int = 400_000):
        self.ranks, self.pattern, self.held = ranks, splitter(pattern), held
        self.tokens = {r: t for t, r in ranks.items()}
        self.names = {r: str(r) for r in self.tokens}
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.seen: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}  # what was remembered before: of the pieces met, the last held / 2 and as many before
        found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
        self._build(left << 32 | right, merged)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = at[todo] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none or an id is below 0 (padding)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], NONE)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            there = self.keys[at[todo]]
            out[todo[there == keys[todo]]] = self.values[at[todo[there == keys[todo]]]]
            todo = todo[(there != keys[todo]) & (there != -1)]
        return out

    def merge_rows(self, rows: np.ndarray) -> list[tuple[int, ...]]:
        """Token ids of each row of a matrix of ids padded with -1 at the right."""
        n, width = rows.shape
        out: list = [None] * n
        live, ids = np.arange(n), rows.copy()
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        cols = np.arange(width)
        while len(live):
            j = rank.argmin(axis=1)  # the first of equal ranks: leftmost
            best = rank[np.arange(len(live)), j]
            done = best == NONE
            if done.any():
                for r, row in zip(live[done].tolist(), ids[done].tolist()):
                    out[r] = tuple(x for x in row if x >= 0)
                keep = ~done
                live, ids, rank, j, best = live[keep], ids[keep], rank[keep], j[keep], best[keep]
                if not len(live):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, rank, cols = ids[:, :used], rank[:, :used], cols[:used]
            k = np.arange(len(live))
            take = np.minimum(cols + (cols > j[:, None]), len(cols) - 1)
            last = ids.shape[1] - 1
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[:, last], rank[:, last] = -1, NONE
            ids[k, j] = best
            after = np.where(j < last, ids[k, np.minimum(j + 1, last)], -1)
            rank[k, j] = self.pair_ranks(best, after)
            inner = np.flatnonzero(j > 0)
            rank[inner, j[inner] - 1] = self.pair_ranks(ids[inner, j[inner] - 1], best[inner])
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one long piece."""
        ids = self.base[np.frombuffer(piece, np.uint8)]
        rank = self.pair_ranks(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of a run of overlapping places every other one counts
                run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                at = at[(at - np.repeat(at[run], np.diff(np.r_[run, len(at)]))) % 2 == 0]
            beyond = np.minimum(at + 2, len(ids) - 1)  # what follows each place before and after the next is merged
            then = np.where(at + 2 < len(ids), ids[beyond], -1)
            after = np.where(np.r_[at[1:] == at[:-1] + 2, False], best, then)
            before = np.where(np.r_[False, at[1:] == at[:-1] + 2], best, np.where(at > 0, ids[np.maximum(at - 1, 0)], -1))
            made = np.full(len(at), best, np.int32)
            left, right = self.pair_ranks(before, made), self.pair_ranks(made, after)
            if min(left.min(), right.min(), self.pair_ranks(made, then).min()) < best:
                at, left = at[:1], left[:1]
                right = self.pair_ranks(made[:1], then[:1])
            ids[at], rank[at] = best, NONE
            rank[at[at > 0] - 1] = left[at > 0]
            inner = at + 1 < len(rank)
            rank[at[inner] + 1] = right[inner]
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
        return tuple(ids.tolist())

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not remembered."""
        if len(self.seen) > self.held // 2:
            self.old, self.seen = self.seen, {}
        pieces = pieces.difference(self.seen)
        again = pieces.intersection(self.old)
        self.seen.update(zip(again, map(self.old.__getitem__, again)))
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces - again:
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.seen[p] = (whole,)
            elif len(b) > LONG:
                self.seen[p] = self.merge_long(b)
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(b)), []).append((p, b))
        for width, rows in by_width.items():
            most = max(1, (1 << 18) // width)
            for a in range(0, len(rows), most):
                part = rows[a : a + most]
                data = np.frombuffer(b"".join(b.ljust(width, b"\0") for _, b in part), np.uint8).reshape(-1, width)
                length = np.array([len(b) for _, b in part])
                ids = np.where(np.arange(width) < length[:, None], self.base[data], -1)
                for (p, _), got in zip(part, self.merge_rows(ids)):
                    self.seen[p] = got

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; pieces are learnt for all texts together."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        of = self.seen.__getitem__
        return [list(chain.from_iterable(map(of, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_made: dict[tuple, BytePairs] = {}


def encoder(data: bytes, pattern: str) -> BytePairs:
    """The encoder for a rank file, made once in each worker."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _made:
        _made[key] = BytePairs(read_ranks(data), pattern)
    return _made[key]


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False, slice_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every whole text.

    `path` is a rank file on the driver; it holds one vocabulary, whatever the size of the data, so its bytes are
    broadcast. One pass without a shuffle; memory is bounded by an Arrow batch and `slice_chars`.
    """
    data = open(path, "rb").read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast as a vocabulary")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], slice_chars):
                n, shas, back, all_ids = [], [], [], []
                for got in e.encode_batch(texts[a:b]):
                    n.append(len(got))
                    shas.append(hashlib.sha256(",".join(map(e.names.__getitem__, got)).encode()).hexdigest())
                    back.append(hashlib.sha256(e.decode(got)).hexdigest())
                    if ids:
                        all_ids.append(got)
                cols = [doc_ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
