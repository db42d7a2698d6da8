"""Token ids as binary: fixed-size blocks of ids transposed into byte or bit planes, each plane compressed by itself.

A segment holds the ids of whole documents in ascending doc_id order. Its bytes are

    header   magic 'IDPL', version, planes a block (4 byte planes or 32 bit planes), ids a block, ids in all
    index    for each block and plane: offset and length of its frame (u64, u32); length 0 is a plane of zeros
    frames   zstandard

so one block, or one plane of a block, can be read without the rest. The files are Parquet with a segment a row
(shard, seg, first, n_ids, doc_ids, n_tokens, payload; first counts the shard's ids before): Spark's committer writes them whole on any store, and a lost task is
written again. Readers get the position of any document from the columns without touching the payloads.

Edge cases: a null or empty text has only the end id; null doc_ids come first; documents of equal doc_id follow each
other by text; a document of any length stands in one segment.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, spare, splitter, table

HEADER = struct.Struct("<4sHHIQ")
FRAME = np.dtype([("offset", "<u8"), ("length", "<u4")])
MAGIC = b"IDPL"
SHARDS = "shard int, seg int, first bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, payload binary"


def pack(ids: np.ndarray, block: int = 65_536, planes: int = 4, level: int = 1) -> bytes:
    """A segment's bytes. planes: 4 for byte planes, 32 for bit planes."""
    ids, squeeze = np.ascontiguousarray(ids, "<u4"), zstandard.ZstdCompressor(level=level)
    frames, sizes = [], []
    for a in range(0, len(ids), block):
        cells = ids[a : a + block].view(np.uint8).reshape(-1, 4)
        if planes == 32:
            cells = np.unpackbits(cells, axis=1, bitorder="little")
        for plane in np.ascontiguousarray(cells.T):
            data = b""
            if plane.any():
                data = squeeze.compress((np.packbits(plane, bitorder="little") if planes == 32 else plane).tobytes())
            frames.append(data)
            sizes.append(len(data))
    index = np.zeros(len(sizes), FRAME)
    head = HEADER.pack(MAGIC, 1, planes, block, len(ids))
    if sizes:
        index["length"] = sizes
        index["offset"] = len(head) + index.nbytes + np.cumsum([0, *sizes[:-1]])
    return b"".join([head, index.tobytes(), *frames])


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids [first, last) of a segment; only the blocks that hold them are decompressed."""
    magic, version, planes, block, n = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment of id planes")
    last = n if last is None else min(last, n)
    blocks = -(-n // block)
    index = np.frombuffer(data, FRAME, blocks * planes, HEADER.size).reshape(blocks, planes)
    out, expand = [np.zeros(0, np.uint32)], zstandard.ZstdDecompressor()
    for b in range(first // block, -(-last // block) if last > first else 0):
        size = min(block, n - b * block)
        cells = np.zeros((planes, size), np.uint8)
        for k, (offset, length) in enumerate(index[b].tolist()):
            if length:
                got = np.frombuffer(expand.decompress(data[offset : offset + length]), np.uint8)
                cells[k] = np.unpackbits(got, count=size, bitorder="little") if planes == 32 else got
        flat = np.ascontiguousarray(cells.T)
        ids = (np.packbits(flat, axis=1, bitorder="little") if planes == 32 else flat).reshape(-1).view("<u4")
        out.append(ids[max(0, first - b * block) : last - b * block])
    return np.concatenate(out)


#: The split patterns of SAME for the standard library's re, which is faster but has no classes L, N and S of Unicode.
QUICK = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": " ?[{L}]+| ?[{N}]+|'(?:[stmd]|re|ve|ll)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+",
}


class Split:
    """The pieces of a text by a split pattern. Texts without characters from U+10000 on are split by re, where it can."""

    def __init__(self, pattern: str):
        import re

        self.any = self.low = splitter(pattern)
        if pattern in QUICK:
            self.low = re.compile(QUICK[pattern].format(L=self.ranges(r"\p{L}"), N=self.ranges(r"\p{N}"), S=self.ranges(r"\s")))

    @staticmethod
    def ranges(kind: str) -> str:
        """All characters of a kind below U+10000, as it stands in a class of re."""
        import regex

        out: list[list[int]] = []
        for c in map(ord, regex.findall(kind, "".join(map(chr, range(0x10000))))):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)

    def __call__(self, text: str) -> list[str]:
        low = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self.low if low else self.any).findall(text)


class PieceIds:
    """Ids of texts by the tokenizers library, asked once for each distinct piece that a worker remembers.

    The library's byte-level models split a text by the pattern before any merge, so a piece has the same ids alone
    as in its text; many pieces are asked at once, a line each, of a model that splits at line ends only, and drops them:
    the bytes that tokens stand for tell where a piece ends. Models with a normalizer, or a split other than the pattern,
    are refused. As the library does by default, texts are first cut at the model's added tokens, which have their own
    ids. A piece has a number, by which its ids are found in one array; all are forgotten when there are more than `held`.
    """

    def __init__(self, data: bytes, pattern: str, held: int = 600_000):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(data)
        before = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level models that split by the pattern can be asked piece by piece")
        tokens = made.get("added_tokens", [])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or "\n" in t["content"] for t in tokens):
            raise ValueError("only added tokens that stand for themselves can be cut out")
        self.added = {t["content"]: t["id"] for t in tokens}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.model = Tokenizer.from_str(data.decode())
        self.model.encode_special_tokens = True  # added tokens have been cut out before
        self.whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.in_lines = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), self.whole])
        self.model.model._resize_cache(0)  # every piece is asked once
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # a character of a token stands for a byte
        self.size[list(vocab.values())] = [len(t) for t in vocab]
        self.split, self.held = Split(pattern), held
        self.forget()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text, added tokens among them."""
        if not any(t in text for t in self.added):
            return self.split(text)
        parts = self.cut.split(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.split(part))]

    def forget(self) -> None:
        self.seen = _Numbers((t, k) for k, t in enumerate(self.added))
        self.ids, self.ends = np.array(list(self.added.values()), "<u4"), np.arange(len(self.added) + 1)

    def ask(self, new: list[str]) -> None:
        """Append the ids of new pieces, in the order of their numbers."""
        got: list = [None] * len(new)
        lone = [k for k, p in enumerate(new) if "\n" in p]
        self.model.pre_tokenizer = self.whole
        for k, x in zip(lone, self.model.encode_batch_fast([new[k] for k in lone], add_special_tokens=False)):
            got[k] = np.array(x.ids, "<u4")
        self.model.pre_tokenizer = self.in_lines
        rest, parts, sizes = [p for p in new if "\n" not in p], [], []
        for a in range(0, len(rest), 500):
            part = rest[a : a + 500]
            ids = np.array(self.model.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at, end = np.cumsum(self.size[ids]), np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)))
            last = np.searchsorted(at, end)
            if len(ids) != last[-1] + 1 or (at[last] != end).any():
                raise ValueError("the model's tokens are not the bytes of the pieces")
            parts.append(ids)
            sizes.append(np.diff(last, prepend=-1))
        size = np.zeros(len(new), np.int64)
        size[lone] = [len(got[k]) for k in lone]
        in_line = np.ones(len(new), bool)
        in_line[lone] = False
        size[in_line] = np.concatenate([np.zeros(0, np.int64), *sizes])
        flat, of_line = np.empty(int(size.sum()), "<u4"), np.repeat(in_line, size)
        flat[of_line] = np.concatenate([np.zeros(0, "<u4"), *parts])
        flat[~of_line] = np.concatenate([np.zeros(0, "<u4"), *(got[k] for k in lone)])
        before = len(self.seen) - len(new)
        end = int(self.ends[before])
        self.ids, self.ends = _put(self.ids, end, flat), _put(self.ends, before + 1, end + np.cumsum(size))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.seen) > self.held:
            self.forget()
        split = [self.pieces(t) for t in texts]
        count, before, of = np.array([len(p) for p in split], np.int64), len(self.seen), self.seen.__getitem__
        number = np.fromiter(map(of, chain.from_iterable(split)), np.int64, int(count.sum()))
        self.ask(list(islice(reversed(self.seen), len(self.seen) - before))[::-1])
        first = self.ends[number]
        size = self.ends[number + 1] - first
        last = np.cumsum(size)
        flat = self.ids[np.arange(int(size.sum())) + np.repeat(first - last + size, size)]
        return np.split(flat, np.r_[0, last][np.cumsum(count)[:-1]]) if len(texts) else []


def _put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """`more` behind the first n items of held, in a longer array where they find no room: it is copied now and then only."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.empty(n + 2 * len(more), held.dtype)])
    held[n : n + len(more)] = more
    return held


class _Numbers(dict):
    """Numbers of pieces, in the order in which they were first met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        return k


_made: dict[bytes, PieceIds] = {}


def _model(data: bytes, pattern: str) -> PieceIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    key = hashlib.sha256(data).digest()
    if key not in _made:
        _made[key] = PieceIds(data, pattern)
    return _made[key]


def write(docs: DataFrame, out: str, model: str, pattern: str, end_id: int, segment_ids: int = 1 << 18, block: int = 65_536, planes: int = 4) -> None:
    """Encode every whole text, as the library does by default, and write its ids in ascending doc_id order.

    Range partitioning by (doc_id, hash of the text) with sampled bounds gives the shards; the model is one
    vocabulary, broadcast whatever the size of the data.
    """
    data = open(model, "rb").read()
    if len(data) > 64 << 20:
        raise ValueError(f"{model} is too large to broadcast as a vocabulary")
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, seg, first = _model(sent.value, pattern).encode_batch, TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 1_000_000):
                part = [np.append(got, np.uint32(end_id)) for got in encode(texts[a:b])]
                for c, d in slices([len(x) for x in part], segment_ids):
                    ids = np.concatenate(part[c:d])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int32()),
                            pa.array([seg], pa.int32()),
                            pa.array([first], pa.int64()),
                            pa.array([len(ids)], pa.int64()),
                            pa.array([doc_ids.slice(a + c, d - c).to_pylist()], pa.list_(pa.int64())),
                            pa.array([[len(x) for x in part[c:d]]], pa.list_(pa.int64())),
                            pa.array([pack(ids, block, planes)], pa.binary()),
                        ],
                        names=["shard", "seg", "first", "n_ids", "doc_ids", "n_tokens", "payload"],
                    )
                    seg, first = seg + 1, first + len(ids)
        spare()

    ranged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").mapInArrow(run, SHARDS).write.option("compression", "none").parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    A first pass over the columns alone counts the ids of each shard; the driver turns these counts, one for each file
    written, into offsets, which the reading tasks add.
    """
    files = spark.read.schema(SHARDS).parquet(path)
    counts = sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts = np.zeros((counts[-1]["shard"] if counts else 0) + 2, np.int64)
    for r in counts:
        starts[r["shard"] + 1] = r["n"]
    sent = spark.sparkContext.broadcast(np.cumsum(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, _, first, _, doc_ids, n, payload = (batch.column(i)[row].as_py() for i in range(7))
                ids = unpack(payload).astype("<u4", copy=False)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(ends - n + sent.value[shard] + first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "id-planes")
    write(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return read(spark, out)
