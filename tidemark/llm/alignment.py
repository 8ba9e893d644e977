"""Alignment of two tokenizers over the same text: elementary intervals between all token ends, and what tokens share."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, written
from tidemark.llm.packing import ByteTokenizer, chunks_of

#: Bytes of text that one pack holds, unless a single text is longer.
PACK = 4 << 20
#: Chunks, and bytes of their strings, that a worker remembers between packs.
REMEMBERED, REMEMBERED_BYTES = 150_000, 32 << 20
#: Chunks that are aligned at once.
AT_ONCE = 20_000
SPACE = "▁"


class PlainTokenizer(ByteTokenizer):
    """The byte-level vocabulary, with the strings of special tokens as plain text; and the bytes of each id."""

    def __init__(self, tokenizer_file: str):
        super().__init__(tokenizer_file)
        self.slow.encode_special_tokens = True
        special, self.special = set(self.special), []
        # Fixed value: the byte-level alphabet shows these bytes as themselves, the others from U+0100 on in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes_of = [b""] * (max(self.slow.get_vocab().values()) + 1)
        for token, i in self.slow.get_vocab().items():
            self.bytes_of[i] = token.encode() if token.encode() in special else bytes(byte_of[c] for c in token)


class PieceTokenizer:
    """The SentencePiece model by the library, chunk by chunk; and the bytes of each piece."""

    def __init__(self, model_file: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes_of = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        crossing = [i for i in range(n) if (p := sp.id_to_piece(i)).strip(SPACE) and SPACE in p[1:]]
        if crossing:
            raise ValueError("pieces with a space after another character would reach over chunks")

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        """Chunks begin with a space, which the library puts there itself."""
        ids = self.sp.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [x if c != b" " else [self.sp.piece_to_id(SPACE)] for c, x in zip(chunks, ids, strict=True)]


class Alignment:
    """Token ends of many chunks, one after the other, cut into elementary intervals.

    ends_a and ends_b hold every token's end; an interval runs from one end, of either kind, to the next. owner_a and
    owner_b say whose tokens it is a part of: each interval is one overlap of an A with a B token. Where both
    owners end with the interval, a group closes.
    """

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        self.ends = np.union1d(ends_a, ends_b)
        self.owner_a, self.owner_b = np.searchsorted(ends_a, self.ends), np.searchsorted(ends_b, self.ends)
        self.shared = (ends_a[self.owner_a] == self.ends) & (ends_b[self.owner_b] == self.ends)
        #: One past the last token of each group, and the place where it closes.
        self.group_a, self.group_b = self.owner_a[self.shared] + 1, self.owner_b[self.shared] + 1
        self.group_ends = self.ends[self.shared]

    def links(self, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, the group) of each link: tokens that end together ('ends'), that overlap ('overlaps'), or that share a group ('groups')."""
        number = np.cumsum(self.shared) - self.shared
        if which == "overlaps":
            return self.owner_a, self.owner_b, number
        if which == "ends":
            return self.owner_a[self.shared], self.owner_b[self.shared], number[self.shared]
        if which != "groups":
            raise ValueError(which)
        size_a, size_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        product = size_a * size_b
        group = np.repeat(np.arange(len(product)), product)
        at = np.arange(product.sum()) - np.repeat(np.cumsum(product) - product, product)
        return (self.group_a - size_a)[group] + at // size_b[group], (self.group_b - size_b)[group] + at % size_b[group], group


class Chunks:
    """What is known of distinct chunks, by number: tokens, groups, links, their string, and the id pairs that link."""

    def __init__(self, byte_file: str, piece_file: str, which: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b, self.which = PlainTokenizer(byte_file), PieceTokenizer(piece_file), which
        self.width = len(self.b.bytes_of)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes_of]) for t in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.held = 0
        #: Columns: A tokens, B tokens, groups, links, overlaps, products of groups, and 1 where the bytes differ.
        self.counts = np.zeros((0, 7), np.int64)
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        new = [w for w in words if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.strings), len(self.strings) + len(new)), strict=True))
            for lo in range(0, len(new), AT_ONCE):
                self._add(new[lo : lo + AT_ONCE])
        return np.fromiter((self.number[w] for w in words), np.int64, len(words))

    def _add(self, chunks: list[bytes]) -> None:
        ids_a, ids_b = [np.frombuffer(x, "<u4") for x in self.a.encode(chunks)], self.b.encode(chunks)
        table_a, table_b = self.a.bytes_of, self.b.bytes_of
        differs = [b"".join([table_a[i] for i in x]) != c or b"".join([table_b[i] for i in y]) != c for x, y, c in zip(ids_a, ids_b, chunks, strict=True)]
        flat_a = np.concatenate([x for x, bad in zip(ids_a, differs, strict=True) if not bad] or [np.zeros(0, "<u4")]).astype(np.int64)
        flat_b = np.array([i for y, bad in zip(ids_b, differs, strict=True) if not bad for i in y], np.int64)
        n_a, n_b, size = (np.array([0 if bad else len(x) for x, bad in zip(xs, differs, strict=True)], np.int64) for xs in (ids_a, ids_b, chunks))
        found = Alignment(np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b]))
        stop = np.cumsum(size)  # chunks end with a group; a chunk whose bytes differ is empty here
        upto = lambda ends: np.diff(np.searchsorted(ends, stop, side="right"), prepend=0)
        n_groups, n_overlaps = upto(found.group_ends), upto(found.ends)
        product = np.diff(found.group_a, prepend=0) * np.diff(found.group_b, prepend=0)
        to = np.cumsum(n_groups)
        summed = np.diff(np.append(0, np.cumsum(product))[to], prepend=0)
        link_a, link_b, group = found.links(self.which)
        pairs = flat_a[link_a] * self.width + flat_b[link_b]
        n_links = np.diff(np.searchsorted(group, to, side="left"), prepend=0)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, n_overlaps, summed, np.array(differs, np.int64)], axis=1)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(n_links))
        self.pairs = np.concatenate([self.pairs, pairs])
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups, a, b = [], 0, 0
        for c, d in zip(found.group_a.tolist(), found.group_b.tolist(), strict=True):
            groups.append(f"{','.join(text_a[a:c])}|{','.join(text_b[b:d])}")
            a, b = c, d
        lo = 0
        for hi in to.tolist():
            self.strings.append(";".join(groups[lo:hi]).encode())
            self.held += len(self.strings[-1]) + 100
            lo = hi


def _packs(kind: pa.DataType, byte_file: str, piece_file: str, which: str):
    """A row per pack: its documents' own columns as lists, the chunks of each document, the pairs of each chunk, and the pack's pairs with their counts."""

    def packed(known: Chunks, ids: pa.Array, texts: list[bytes | None], number: int) -> pa.RecordBatch:
        parts = [b for t in texts if t for b in (b" ", t)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        at = chunks_of(data, (ends - sizes)[sizes > 0]) if len(data) else np.zeros(0, np.int64)
        bounds = np.append(at, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        place = known.of(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
        to = np.searchsorted(at, ends)
        counts = known.counts[place]
        # a column at a time, as a document's chunks are many
        sums = np.stack([np.diff(np.append(0, np.cumsum(counts[codes, k]))[to], prepend=0) for k in range(7)], axis=1)
        bad = sums[:, 6] > 0
        sums[bad] = 0
        strings = [known.strings[p] for p in place.tolist()]
        lo, shas = 0, []
        for hi, wrong in zip(to.tolist(), bad.tolist(), strict=True):
            shas.append("" if wrong or lo == hi else hashlib.sha256(b";".join([strings[c] for c in codes[lo:hi].tolist()])).hexdigest())
            lo = hi
        own = np.diff(to, prepend=0)
        stay = np.repeat(~bad, own)
        codes, own = codes[stay], np.where(bad, 0, own)
        n_pairs = np.diff(known.first)[place]
        begin = known.first[place]
        flat = known.pairs[np.repeat(begin - (np.cumsum(n_pairs) - n_pairs), n_pairs) + np.arange(n_pairs.sum())]
        keys, local = np.unique(flat, return_inverse=True)
        times = np.bincount(codes, minlength=len(place))
        total = np.bincount(local, weights=np.repeat(times, n_pairs), minlength=len(keys)).astype(np.int64)
        squeeze = lambda x: pa.compress(np.ascontiguousarray(x, np.uint32).tobytes(), codec="zstd", asbytes=True)
        columns = {
            "pack": pa.array([number], pa.int64()), "ids": pa.array([ids.to_pylist()], pa.list_(kind)), "sums": pa.array([sums[:, :6].ravel()], pa.list_(pa.int64())), "shas": pa.array([shas], pa.list_(pa.string())),
            "n_chunks": pa.array([own], pa.list_(pa.int64())), "codes": pa.array([squeeze(codes)], pa.binary()), "n_codes": pa.array([len(codes)], pa.int64()),
            "n_pairs": pa.array([squeeze(n_pairs)], pa.binary()), "local": pa.array([squeeze(local)], pa.binary()), "n_words": pa.array([len(place)], pa.int64()), "n_local": pa.array([len(local)], pa.int64()),
            "keys": pa.array([keys], pa.list_(pa.int64())), "counts": pa.array([total], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, number = Chunks(byte_file, piece_file, which), TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]).tolist() if len(column) else []
            lo = 0
            for k, n in enumerate(sizes):
                if held and held + n > PACK:
                    ids.append(batch.column(0).slice(lo, k - lo))
                    texts += column.slice(lo, k - lo).to_pylist()
                    yield packed(known, pa.concat_arrays(ids), texts, number)
                    number, ids, texts, held, lo = number + 1, [], [], 0, k
                held += n
            ids.append(batch.column(0).slice(lo))
            texts += column.slice(lo).to_pylist()
        if texts:
            yield packed(known, pa.concat_arrays(ids), texts, number)

    return run


def _answered(kind: pa.DataType):
    """Of a pack and what was told of its pairs, a row per document."""

    def run(key: tuple, packs: pa.Table, told: pa.Table) -> pa.Table:
        row = {c: packs.column(c)[0] for c in packs.column_names}
        opened = lambda c, n: np.frombuffer(pa.decompress(row[c].as_buffer(), decompressed_size=4 * n, codec="zstd"), np.uint32) if n else np.zeros(0, np.uint32)
        order = np.argsort(told.column("at").to_numpy())
        best, count = (told.column(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("best", "count"))
        local, n_pairs = opened("local", row["n_local"].as_py()), opened("n_pairs", row["n_words"].as_py()).astype(np.int64)
        to = np.cumsum(n_pairs)
        by_word = [np.diff(np.append(0, np.cumsum(x[local]))[to], prepend=0) for x in (best, count)]
        codes, own = opened("codes", row["n_codes"].as_py()), row["n_chunks"].values.to_numpy()
        until = np.cumsum(own)
        n_best, count_sum = (np.diff(np.append(0, np.cumsum(x[codes]))[until], prepend=0) for x in by_word)
        sums = row["sums"].values.to_numpy().reshape(-1, 6)
        names = ("n_a", "n_b", "n_groups", "n_links")
        out = {"doc_id": row["ids"].values} | {c: pa.array(sums[:, k]) for k, c in enumerate(names)}
        return pa.table(out | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": row["shas"].values, "n_overlaps": pa.array(sums[:, 4]), "n_products": pa.array(sums[:, 5])})

    return run


def link_counts(docs: DataFrame, byte_file: str, piece_file: str, which: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_products of each row.

    A is the byte-level vocabulary over a space and the text, B the SentencePiece one, which adds that space itself.
    which says what a link is (Alignment.links). A pair of ids counts as often as it is linked in the whole table;
    n_best are a row's links whose count is the highest of their B id's, and count_sum adds up the counts of a row's links.

    Texts are cut where both tokenizers always cut (a space after a character that is no white space), and what a chunk's
    alignment gives is worked out once for each chunk that differs. A pack of some PACK bytes of text sends each of its
    id pairs once, with a count, and gets the totals back, which it adds up by chunk and by row; so a pair that is
    everywhere costs a row per pack, and no table of pairs is held whole anywhere.

    A null or empty text has no tokens, nor has one whose B bytes aren't its own (U+2581 in it): zeros and ''. A chunk's
    bytes can only get fewer that way, so a text differs if one of its chunks does. Rows that repeat count as often;
    an empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_type = docs.schema[id_col].dataType
    kind = id_type.simpleString()
    arrow = pa.schema(spark.createDataFrame([], f"x {kind}").toArrow().schema)[0].type
    schema = f"pack long, ids array<{kind}>, sums array<long>, shas array<string>, n_chunks array<long>, codes binary, n_codes long, n_pairs binary, local binary, n_words long, n_local long, keys array<long>, counts array<long>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    packs = scratch.written(rows.mapInArrow(_packs(arrow, byte_file, piece_file, which), schema), "packs")
    sent = packs.select("pack", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "x")).select("pack", "at", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    width = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    total = sent.groupBy("key").agg(F.sum("n").alias("count"))
    # of a B id there are at most as many pairs as A has ids
    of_b = Window.partitionBy(F.pmod(F.col("key"), F.lit(width)))
    total = scratch.written(total.withColumn("best", F.col("count") == F.max("count").over(of_b)), "totals")
    told = sent.select("pack", "at", "key").join(total, "key").select("pack", "at", "count", "best")
    out = packs.drop("keys", "counts").groupBy("pack").cogroup(told.toDF(*told.columns).groupBy("pack")).applyInArrow(_answered(arrow), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long, n_products long")
    out = written(out, "aligned")
    scratch.remove()
    return out


def _aligned(byte_file: str, piece_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = PlainTokenizer(byte_file), PieceTokenizer(piece_file)
        len_a, len_b = (np.array([len(x) for x in t.bytes_of]) for t in (a, b))
        for batch in batches:
            out = {"a_ids": [], "b_ids": [], "groups": [], "overlaps": []}
            for text in batch.column(1).to_pylist():
                ids_a = ids_b = np.zeros(0, np.int64)
                if text:
                    whole = b" " + text.encode()
                    ids_a, ids_b = np.frombuffer(a.encode([whole])[0], "<u4").astype(np.int64), np.array(b.encode([whole])[0], np.int64)
                    if any(b"".join([t.bytes_of[i] for i in ids]) != whole for t, ids in ((a, ids_a), (b, ids_b))):
                        ids_a = ids_b = np.zeros(0, np.int64)
                found = Alignment(np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b]))
                start = lambda x: np.append(0, x[:-1]) if len(x) else x
                row = lambda names, *xs: [dict(zip(names, x, strict=True)) for x in zip(*map(np.ndarray.tolist, xs), strict=True)]
                out["a_ids"].append(ids_a)
                out["b_ids"].append(ids_b)
                out["groups"].append(row(("start", "stop", "a_start", "a_stop", "b_start", "b_stop"), start(found.group_ends), found.group_ends, start(found.group_a), found.group_a, start(found.group_b), found.group_b))
                out["overlaps"].append(row(("start", "stop", "a", "b"), start(found.ends), found.ends, found.owner_a, found.owner_b))
            spans = lambda *names: pa.list_(pa.struct([(c, pa.int64()) for c in names]))
            kinds = {"a_ids": pa.list_(pa.int64()), "b_ids": pa.list_(pa.int64()), "groups": spans("start", "stop", "a_start", "a_stop", "b_start", "b_stop"), "overlaps": spans("start", "stop", "a", "b")}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], k) for c, k in kinds.items())], ["doc_id", *kinds])

    return run


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, groups, overlaps of each row: byte spans and token spans of groups, and each interval with its two tokens (by place).

    A null or empty text, and one whose bytes differ, has empty lists. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = lambda *names: f"array<struct<{', '.join(f'{c}: long' for c in names)}>>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_aligned(byte_file, piece_file), f"doc_id {kind}, a_ids array<long>, b_ids array<long>, groups {span('start', 'stop', 'a_start', 'a_stop', 'b_start', 'b_stop')}, overlaps {span('start', 'stop', 'a', 'b')}")
