"""Best-fit packing of token sequences by minimum bin slack: each bin takes the fullest combination of the lengths left."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, written

#: Chunks whose ids a worker remembers between batches.
REMEMBERED = 1_000_000
#: The pieces of one length are numbered in parts, so that a length many documents share is no single task's: as many as
#: there are shuffle partitions, between these.
SHARDS = 64, 4096


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Packs counts[length] items of each length into bins: [(items by length, how many such bins)], of at most capacity each.

    Every bin holds the longest item left, and the subset of the others whose sum comes closest to capacity, found by
    dynamic programming over a bitset of reachable sums; then as many equal bins are made as the counts allow. At least
    one length runs out, or falls under what the combination needs, with each entry, so the entries are few thousand
    at most for lengths up to capacity, however many items there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is not in 1 to capacity")
    bins = []
    lengths = sorted(left, reverse=True)
    while lengths:
        top = lengths[0]
        room = capacity - top
        mask = (1 << (room + 1)) - 1
        reach, trail = 1, []  # trail: (length, reachable sums before it)
        full = 1 << room
        for n in lengths:
            if n > room or reach & full:
                continue
            k, step = min(left[n] - (n == top), room // n), 1
            while k > 0 and not reach & full:  # 1, 2, 4, ... of them at a time
                take = min(step, k)
                trail.append((n, take, reach))
                reach |= (reach << n * take) & mask
                k, step = k - take, step * 2
        best = reach.bit_length() - 1
        used = {top: 1}
        for n, take, before in reversed(trail):
            if not before >> best & 1:
                used[n] = used.get(n, 0) + take
                best -= n * take
        times = min(left[n] // c for n, c in used.items())
        bins.append((used, times))
        for n, c in used.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return bins


def chunks_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where to cut texts for byte-level BPE: at their starts, and before a space that follows a character other than a space.

    There the pretokenizer always cuts, so the chunks' ids are the text's. A byte that may end a wide white-space
    character doesn't count.
    """
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    last = data[at - 1]
    # The last bytes of the white-space characters beyond ASCII (U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000).
    ends = np.zeros(256, bool)
    ends[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
    # The first bytes of those of two and of three bytes; 9 to 13 and 28 to 32 are ASCII's own.
    blank = (last == 32) | ((last >= 9) & (last <= 13)) | ((last >= 0x1C) & (last <= 0x1F))
    wide = ends[last] & ((data[np.maximum(at - 2, 0)] == 0xC2) | ((data[np.maximum(at - 3, 0)] >= 0xE1) & (data[np.maximum(at - 3, 0)] <= 0xE3)))
    cut = np.zeros(len(data), bool)
    cut[starts] = True
    cut[at[~(blank | wide)]] = True
    return np.flatnonzero(cut)


class ByteTokenizer:
    """Ids of chunks by the file's vocabulary: a byte-level BPE without special strings runs in tiktoken, which merges by the same ranks.

    Chunks with an added token's string, and the first few hundred of each call for a check, go through tokenizers itself.
    """

    # Fixed value: the pattern of the byte-level pretokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, tokenizer_file: str, checked: int = 200):
        from tokenizers import Tokenizer

        self.slow, self.checked = Tokenizer.from_file(tokenizer_file), checked
        spec = json.loads(self.slow.to_str())
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        before = spec["pre_tokenizer"] or {}
        vocabulary = spec["model"].get("vocab", {})
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
        plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        self.fast = None
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ", 1)), -1) for m in spec["model"].get("merges", [])]
        # ids stand for ranks only where every merge makes a token and the ids rise in the merges' order
        plain = plain and all(a < b for a, b in zip([-1, *merged], merged, strict=False))
        if plain and all(c in byte_of for t in vocabulary for c in t if t.encode() not in self.special):
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t.encode() not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """Each chunk's ids, as little-endian numbers of four bytes."""
        texts = [c.decode() for c in chunks]
        if self.fast is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]
        told = self.slow.encode_batch_fast(texts[: self.checked], add_special_tokens=False)
        ids = [e.ids for e in told] + [self.fast.encode_ordinary(t) for t in texts[self.checked :]]
        plain = [i for i, c in enumerate(chunks[: self.checked]) if not any(s in c for s in self.special)]
        if any(self.fast.encode_ordinary(texts[i]) != ids[i] for i in plain):
            self.fast = None  # from here on the library alone
            return self.encode(chunks)
        for s in self.special:
            for i in [i for i, c in enumerate(chunks) if s in c]:
                ids[i] = self.slow.encode(texts[i], add_special_tokens=False).ids
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        data, lo, out = np.fromiter((y for x in ids for y in x), "<u4", ends[-1] // 4 if ends else 0).tobytes(), 0, []
        for hi in ends:
            out.append(data[lo:hi])
            lo = hi
        return out


def _pieces(tokenizer_file: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = ByteTokenizer(tokenizer_file)
        ids_of: dict[bytes, bytes] = {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 3000):
                part = batch.slice(lo, 3000)
                texts = [t or b"" for t in part.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
                data = np.frombuffer(b"".join(texts), np.uint8)
                sizes = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(sizes)
                at = chunks_of(data, (ends - sizes)[sizes > 0]) if len(data) else np.zeros(0, np.int64)
                bounds = np.append(at, len(data)).astype(np.int64)
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(ids_of) > REMEMBERED:
                    ids_of = {}
                new = [w for w in words if w not in ids_of]
                ids_of.update(zip(new, tokenizer.encode(new), strict=True))
                table = [ids_of[w] for w in words]
                # all ids of the slice in a row: of each chunk its own, wherever they stand in the table
                sizes4 = np.fromiter(map(len, table), np.int64, len(table)) // 4
                first4 = np.cumsum(sizes4) - sizes4
                every = np.frombuffer(b"".join(table), "<u4")
                codes = coded.indices.to_numpy()
                count = sizes4[codes]
                stop = np.cumsum(count)
                flat = every[np.repeat(first4[codes] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
                bounds4 = np.append(0, stop)[np.searchsorted(at, ends)].tolist()
                rows: dict[str, list] = {"doc": [], "piece": [], "start": [], "length": [], "crc": []}
                a = 0
                for k, b in enumerate(bounds4):
                    ids = flat[a:b].tobytes() + end
                    a, n = b, len(ids) // 4
                    first = n if n <= length else n % length or length
                    start, piece = 0, 0
                    while start < n:
                        size = first if not start else length
                        rows["doc"].append(k)
                        rows["piece"].append(piece)
                        rows["start"].append(start)
                        rows["length"].append(size)
                        rows["crc"].append(zlib.crc32(ids[4 * start : 4 * (start + size)]))
                        start, piece = start + size, piece + 1
                docs = part.column(0).take(pa.array(rows["doc"], pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, pa.array(rows["piece"], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "crc"))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 2, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and the end id, in pieces of length tokens, of which the first may be shorter.

    A null text counts as empty: one piece, the end id alone. A row whose id repeats has its pieces as often.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_file, end_id, length), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _placed(table, slots, shards: int):
    """table: the first number of each (length, shard). slots: by length, arrays (first number, of a bin's items, first bin, first offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, by_length = table.value, slots.value
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False) - 1 + first[size, batch.column("shard").to_numpy(zero_copy_only=False)]
            bin_, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                begin, each, bins, offsets = by_length[int(n)]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                r = rank[at] - begin[k]
                bin_[at], offset[at] = bins[k] + r // each[k], offsets[k] + r % each[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bin_), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 1024, shards: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset, in sequences of at most capacity tokens without gaps. pieces must be stored, not computed anew.

    Pieces of full length, the most of all where texts are long, each are a sequence, with a number below 0 that needs no
    shuffle. Of the others the driver gets how many each (length, shard) has: capacity * 4096 numbers at most, for any input. From
    the counts by length it plans the bins; each piece then finds its place from its length and its number among the
    pieces of that length, which is its number in its shard plus those of the shards before. Equal pieces (a row given
    twice) take different places. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    shards = shards or min(max(shuffle_partitions(spark), SHARDS[0]), SHARDS[1])
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    pieces = pieces.filter(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(shards)).cast("int"))
    counts = pieces.groupBy("length", "shard").count().toArrow().to_pydict()
    grid = np.zeros((capacity + 1, shards), np.int64)
    grid[counts["length"], counts["shard"]] = counts["count"]
    totals = grid.sum(axis=1)
    slots: dict[int, list] = {}
    used, bins = {}, 0
    for items, times in minimum_bin_slack({n: int(c) for n, c in enumerate(totals) if c}, capacity):
        offset = 0
        for n, each in items.items():
            slots.setdefault(n, []).append((used.get(n, 0), each, bins, offset))
            used[n] = used.get(n, 0) + each * times
            offset += n * each
        bins += times
    by_length = {n: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for n, s in slots.items()}
    first = spark.sparkContext.broadcast(np.cumsum(grid, axis=1) - grid)
    plan = spark.sparkContext.broadcast(by_length)
    ranked = pieces.selectExpr("*", "row_number() OVER (PARTITION BY length, shard ORDER BY doc_id, piece, start) AS rank")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(_placed(first, plan, shards), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_pieces, stored in the shared folder, then pack: one row per piece with its sequence and place.

    A null or empty text is one piece, the end id. Rows with one id each have their pieces; an empty table gives an empty
    result. Columns other than the two named are not looked at.
    """
    return pack(written(token_pieces(docs, tokenizer_file, end_id, capacity, id_col, text_col), "pieces"), capacity)
