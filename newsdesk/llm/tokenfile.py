"""Token ids in binary shards of patched frame-of-reference blocks.

A shard holds consecutive documents in ascending id order. Its tokens are cut into blocks of ``BLOCK`` ids; each block stores its
minimum, packs the differences at the width that ``PERCENTILE`` of them need, and keeps the larger ones in an exception list of
(position, value). An index gives the byte at which every block starts, so one block is decoded without the others.

Shard layout (little-endian): magic ``NDP1``; u32 documents, u32 blocks, u32 tokens in a block, u64 tokens, u64 first token within
its partition; documents x (i64 id, u8 null id, u64 tokens); (blocks + 1) x u64 block starts, counted from the first block; blocks:
u32 minimum, u8 width, u16 exceptions, packed bits, exceptions x u16 position, exceptions x u32 difference.

Shards are written as rows of a Parquet table in the shared folder: part, seq, n_docs, n_tokens, payload.

Defined results: null texts count as empty and hold the end id alone; null ids come first and are kept; repeated rows each get
their tokens, ordered by text; a very long text is encoded whole and may make its shard longer; the text of a special token becomes
that token, as in a plain call of the library; an empty table gives an empty file; extra columns don't matter.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import STOP, ChunkCache, chunk_of
from .memory import release
from .shared import stored

BLOCK, PERCENTILE = 256, 90
SHARD_TOKENS = 1 << 20
HEAD = struct.Struct("<4sIIIQQ")
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library in one worker process, as it comes: the text of a special token becomes that token."""

    #: Stands between chunks that are encoded in one call; the pattern always makes it a piece of its own there.
    BETWEEN = "\n\n"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.between = self._ids([self.BETWEEN])[0]
        self.cache = ChunkCache(self.encode, 1, 700_000, 8 << 20)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, keys: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each key's chunk."""
        plain = [k for k in keys if k[0] > STOP and not any(t in k for t in self.special)] if len(self.between) == 1 else []
        known = {}
        for a in range(0, len(plain), 100):
            part = plain[a : a + 100]
            ids = np.array(self._ids([self.BETWEEN + self.BETWEEN.join(map(chunk_of, part))])[0], "<u4")
            starts = np.flatnonzero(ids == self.between[0]) + 1
            if len(starts) != len(part):
                continue
            raw = ids.tobytes()
            known.update((k, raw[4 * i : 4 * j - 4]) for k, i, j in zip(part, starts.tolist(), [*starts[1:].tolist(), len(ids) + 1], strict=True))
        rest = [k for k in keys if k not in known]
        known.update(zip(rest, (np.array(x, "<u4").tobytes() for x in self._ids(list(map(chunk_of, rest)))), strict=True))
        return [known[k] for k in keys]

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; null counts as empty."""
        return (x for (x,) in self.cache.parts(texts))


def tokenizer(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Each block's bytes. The last block is padded with its own minimum, which packs to zeros."""
    n = len(ids)
    m = -(-n // BLOCK)
    full = np.full(m * BLOCK, 0, np.uint32)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = ids[(m - 1) * BLOCK :].min()
    full = full.reshape(m, BLOCK)
    low = full.min(1)
    diff = full - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    typical = np.partition(diff, at, axis=1)[:, at]
    width = np.ceil(np.log2(typical.astype(float) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * m
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        d = diff[rows]
        large = d >> np.uint32(w) > 0 if w < 32 else np.zeros_like(d, bool)
        kept = np.where(large, np.uint32(0), d)
        bits = np.zeros((len(rows), BLOCK, w), np.uint8)
        for k in range(w):
            bits[:, :, k] = (kept >> np.uint32(k)) & 1
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        counts = large.sum(1)
        ends = np.cumsum(counts)
        pos, val = np.nonzero(large)[1].astype("<u2"), d[large].astype("<u4")
        for k, row in enumerate(rows):
            a, b = ends[k] - counts[k], ends[k]
            out[row] = struct.pack("<IBH", low[row], w, counts[k]) + packed[k].tobytes() + pos[a:b].tobytes() + val[a:b].tobytes()
    return out


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, first: int) -> bytes:
    docs = np.zeros(len(doc_ids), DOC)
    docs["id"], docs["null"], docs["n"] = [d or 0 for d in doc_ids], [d is None for d in doc_ids], counts
    blocks = pack_blocks(ids) if len(ids) else []
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return HEAD.pack(b"NDP1", len(docs), len(blocks), BLOCK, len(ids), first) + docs.tobytes() + starts.tobytes() + b"".join(blocks)


def read_blocks(shard: bytes, blocks: range | None = None) -> np.ndarray:
    """Ids of the given blocks (all by default), found through the index."""
    magic, n_docs, n_blocks, size, n_tokens, _ = HEAD.unpack_from(shard)
    if magic != b"NDP1":
        raise ValueError("not a token shard")
    at = HEAD.size + n_docs * DOC.itemsize
    starts = np.frombuffer(shard, "<u8", n_blocks + 1, at).astype(np.int64) + at + 8 * (n_blocks + 1)
    blocks = range(n_blocks) if blocks is None else blocks
    out = np.zeros((len(blocks), size), np.uint32)
    raw = np.frombuffer(shard, np.uint8)
    heads = [struct.unpack_from("<IBH", shard, starts[b]) for b in blocks]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        n_bytes = size * int(w) // 8
        if w:
            begin = np.array([starts[blocks[r]] + 7 for r in rows])
            bits = np.unpackbits(raw[begin[:, None] + np.arange(n_bytes)], axis=1, bitorder="little").reshape(len(rows), size, w)
            value = np.zeros((len(rows), size), np.uint32)
            for k in range(int(w)):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[rows] = value
        for r in rows:
            low, _, n_exc = heads[r]
            if n_exc:
                p = int(starts[blocks[r]]) + 7 + n_bytes
                out[r, np.frombuffer(shard, "<u2", n_exc, p)] = np.frombuffer(shard, "<u4", n_exc, p + 2 * n_exc)
            out[r] += np.uint32(low)
    flat = out.reshape(-1)
    if len(blocks) and blocks[-1] == n_blocks - 1:
        flat = flat[: len(flat) - (n_blocks * size - n_tokens)]
    return flat


def read_shard(shard: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """First token within the partition, the documents (id, null, n) and all ids."""
    _, n_docs, _, _, _, first = HEAD.unpack_from(shard)
    return first, np.frombuffer(shard, DOC, n_docs, HEAD.size), read_blocks(shard)


def write_file(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode all texts and write the shards, ascending by id over partitions and within them; the table as read back."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        coder = tokenizer(path)
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, first, held, size
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            payload = write_shard([d for d, _ in held], [len(x) // 4 for _, x in held], ids, first)
            row = [[part], [seq], [len(held)], [len(ids)], [payload]]
            seq, first, held, size = seq + 1, first + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), coder.ids(batch.column("text")), strict=True):
                held.append((d, x + end))
                size += len(x) // 4 + 1
                if size >= SHARD_TOKENS:
                    yield shard()
        if held:
            yield shard()
        release()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(encode, "part int, seq int, n_docs long, n_tokens long, payload binary"), "tokens")


def read_file(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, decoded from the shards.

    A partition's first token follows from the totals of the partitions before it: one row a partition reaches the driver.
    """
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                first, docs, ids = read_shard(payload.as_py())
                ends = np.cumsum(docs["n"].astype(np.int64))
                starts = ends - docs["n"].astype(np.int64)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs["id"].astype(np.int64), pa.int64(), mask=docs["null"].astype(bool)),
                        pa.array(starts + first + base[part], pa.int64()),
                        pa.array(docs["n"].astype(np.int64), pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return shards.select("part", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def crc32_unsigned(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF
