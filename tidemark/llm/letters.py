"""Packs of documents that ask buckets of fingerprints which of theirs stand elsewhere too.

A pack is a few MB of documents, compressed, stored once in the shared folder. For each question it sends one letter
(a sorted array of fingerprints) to each bucket, and gets back one byte or bit for each fingerprint sent. So a
fingerprint costs its own bytes in a shuffle and no row, its place in the corpus is never sent (the pack works it out
again), and one that a third of all documents hold is one entry per pack.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, shuffle_partitions

PACK_BYTES, MOST_PACK_BYTES = 2 << 20, 64 << 20
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


class Rolling:
    """Fingerprints of all stretches of a sequence of 64-bit names: sums of name * base ** place, modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base | 1), U64(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def load(self, names: np.ndarray) -> Rolling:
        n = len(names)
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for what, x in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, x, U64)
                powers[0] = 1
                setattr(self, what, np.cumprod(powers))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(names * self.up[:n], out=self.sums[1:])
        return self

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def _pack(pack_bytes: int):
    def packed(texts: list, ids: list, kind: pa.DataType, tag: int) -> pa.RecordBatch:
        body = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.large_binary())], ["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(body)
        return pa.RecordBatch.from_arrays([pa.array([tag], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack_id", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list = []
        ids: list = []
        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist(), strict=True):
                if texts and size + len(t or b"") > pack_bytes:
                    yield packed(texts, ids, kind, uuid.uuid4().int >> 66)
                    texts, ids, size = [], [], 0
                texts.append(t or b"")
                ids.append(i)
                size += len(t or b"")
        if texts:
            yield packed(texts, ids, kind, uuid.uuid4().int >> 66)

    return run


def pack_size(spark: SparkSession) -> int:
    """Bytes of text in a pack: more with more buckets, so that the letters (packs times buckets) stay in proportion to the input."""
    return min(max(PACK_BYTES, 512 * bucket_count(spark)), MOST_PACK_BYTES)


def packs_of(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """pack_id and body, stored: the ids and texts of docs, a null text as an empty one. The random pack ids are fixed by being stored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = rows.mapInArrow(_pack(pack_size(docs.sparkSession)), "pack_id long, body binary")
    return scratch.written(packed, "packs", compression="none")


def unpacked(body: bytes) -> tuple[pa.Array, pa.LargeBinaryArray]:
    batch = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]
    return batch.column(0), batch.column(1)


def bucket_count(spark: SparkSession) -> int:
    """Twice the shuffle partitions, which are to follow the input, so that a bucket's letters fit in a task."""
    return 2 * shuffle_partitions(spark)


class Entries:
    """Distinct (name, detail) pairs of one pack, in the order in which they are sent; flags: a pair that counts as two."""

    def __init__(self, names: np.ndarray, details: np.ndarray, flags: np.ndarray, buckets: int):
        order = np.lexsort((details, names))
        n, d = names[order], details[order]
        fresh = np.ones(len(n), bool)
        fresh[1:] = (n[1:] != n[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        #: Of each given pair, its place among those sent.
        self.place = np.empty(len(n), np.int64)
        self.place[order] = group
        sizes = np.diff(np.append(at, len(n)))
        twice = (sizes > 1) | np.logical_or.reduceat(flags[order], at) if len(at) else np.zeros(0, bool)
        self.short = (n[at] >> U64(16)).astype(np.uint32)
        self.long = (d[at] & ~U64(1)) | twice.astype(U64)
        self.bucket = ((n[at] >> U64(32)) * U64(buckets)) >> U64(32)
        self.bounds = np.searchsorted(self.bucket, np.arange(buckets + 1, dtype=U64))

    def letters(self) -> Iterator[tuple[int, bytes]]:
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            lo, hi = self.bounds[b], self.bounds[b + 1]
            yield b, self.short[lo:hi].tobytes() + self.long[lo:hi].tobytes()


def opened(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 12
    return np.frombuffer(payload, np.uint32, n), np.frombuffer(payload, np.uint64, n, 4 * n)


def exchange(packs: DataFrame, send: Callable, answer: Callable, buckets: int) -> DataFrame:
    """pack_id and replies (bucket, payload): send(row) gives (bucket, payload) letters, answer(bucket, payloads) one reply each.

    A bucket's letters meet in one task. Their size is the corpus' fingerprints over the number of buckets; each pack
    sends a fingerprint once at most, so none can fill a bucket.
    """

    def sender(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sent = list(send(row))
                if sent:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array([row["pack_id"]] * len(sent), pa.int64()), pa.array([p for _, p in sent], pa.binary())], ["bucket", "pack_id", "payload"])

    def answerer(table: pa.Table) -> pa.Table:
        payloads = table.column("payload").to_pylist()
        replies = answer(table.column("bucket")[0].as_py(), payloads)
        return pa.table({"pack_id": table.column("pack_id"), "bucket": table.column("bucket"), "payload": pa.array(replies, pa.binary())})

    sent = packs.mapInArrow(sender, "bucket int, pack_id long, payload binary")
    got = sent.groupBy("bucket").applyInArrow(answerer, "pack_id long, bucket int, payload binary")
    return got.groupBy("pack_id").agg(F.collect_list(F.struct("bucket", "payload")).alias("replies"))


def asked(packs: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """packs with the replies to each as a column; both sides have a pack once, so the join has no skew."""
    return packs.join(replies.withColumnRenamed("replies", name), "pack_id", "left")


def joined(replies: list | None, low: int = 0, high: int = 1 << 30) -> np.ndarray:
    """The bytes of the replies of buckets low to high, one after the other, in the order in which the letters were sent."""
    own = sorted((r["bucket"], r["payload"]) for r in replies or () if low <= r["bucket"] < high)
    return np.frombuffer(b"".join(zlib.decompress(p) for _, p in own), np.uint8)


# What a pack hears about a unit (a stretch that holds all windows with one anchor; its name is the part they share).
ALONE, ALL_SAME, FIRST, FOLLOWS, DIFFERS = range(5)
#: Added for a name that more than FEW distinct units have.
MANY, FEW = 8, 64


def unit_classes(_: int, payloads: list[bytes]) -> list[bytes]:
    """For each unit: ALONE, its name stands nowhere else; ALL_SAME, it stands elsewhere as it is, and no other unit has the name;
    FIRST or FOLLOWS, it stands elsewhere, but others have the name too (one entry is FIRST); DIFFERS, only others have the name."""
    parts = [opened(p) for p in payloads]
    short, long = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    detail, weight = long & ~U64(1), 1 + (long & U64(1)).astype(np.int64)
    order = np.lexsort((detail, short))
    s, d, w = short[order], detail[order], weight[order]
    new_s = np.append(True, s[1:] != s[:-1])
    new_d = new_s | np.append(True, d[1:] != d[:-1])
    at_s, at_d = np.cumsum(new_s) - 1, np.cumsum(new_d) - 1
    many = np.bincount(at_s, w)[at_s] > 1
    kinds = np.bincount(at_s, new_d)[at_s]
    twice = np.bincount(at_d, w)[at_d] > 1
    told = np.where(~many, ALONE, np.where(kinds == 1, ALL_SAME, np.where(twice, np.where(new_d, FIRST, FOLLOWS), DIFFERS))).astype(np.uint8)
    told[(told >= FIRST) & (kinds > FEW)] += MANY
    out = np.empty(len(told), np.uint8)
    out[order] = told
    ends = np.cumsum([len(p[0]) for p in parts])
    return [zlib.compress(x.tobytes(), 1) for x in np.split(out, ends[:-1])]


def repeated(_: int, payloads: list[bytes]) -> list[bytes]:
    """For each fingerprint of 96 bits: 1 if it stands elsewhere too."""
    parts = [opened(p) for p in payloads]
    short, long = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    detail, weight = long & ~U64(1), 1 + (long & U64(1)).astype(np.int64)
    order = np.lexsort((detail, short))
    s, d = short[order], detail[order]
    at = np.cumsum(np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))) - 1
    out = np.empty(len(s), np.uint8)
    out[order] = np.bincount(at, weight[order])[at] > 1
    ends = np.cumsum([len(p[0]) for p in parts])
    return [zlib.compress(x.tobytes(), 1) for x in np.split(out, ends[:-1])]


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... hi of each pair, one after the other; none where hi < lo."""
    n = np.maximum(hi - lo + 1, 0)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
