"""SentencePiece encoding and decoding for merge-type vocabularies, with an agenda of adjacent symbol pairs by score."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks whose ids a worker remembers between batches.
REMEMBERED = 1_000_000
#: Chunks of more symbols than this use a heap each; shorter ones pop their agendas in step.
LONG = 48


class MergeVocabulary:
    """A merge-type SentencePiece model: pieces with scores, byte fallback, no normalisation beyond spaces."""

    def __init__(self, model_file: str):
        self.differing = 0  # chunks for which the library said otherwise
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {pieces[i]: (-sp.get_score(i), i) for i in plain}
        self.byte_id = {int(pieces[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_id.items()} | {i: pieces[i].replace(SPACE, " ").encode() for i in plain}
        self.eos = sp.eos_id()
        self.decimal = [b" %d" % i for i in range(n)]
        pairs = []
        for piece, (cost, i) in self.rank.items():
            for k in range(1, len(piece)):
                if piece[:k] in self.rank and piece[k:] in self.rank:
                    pairs.append((self.rank[piece[:k]][1] * n + self.rank[piece[k:]][1], i, cost))
        pairs.sort()
        #: Of two ids that may merge: left * n + right, the merged id, and the place of its score among all scores.
        self.n = n
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_ids = np.array([p[1] for p in pairs], np.int64)
        self.pair_costs = np.unique([p[2] for p in pairs], return_inverse=True)[1].astype(np.int64)
        self.char_id = {p: i for p, (_, i) in self.rank.items() if len(p) == 1}
        inner = [p for p in self.rank if SPACE in p[1:] and p.strip(SPACE)]
        if inner or any(sp.is_unused(i) for i in range(n)) or len(self.byte_id) != 256:
            raise ValueError("only vocabularies with byte fallback, no unused pieces and no space inside a piece are supported")

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a chunk in which spaces already stand as U+2581: the best-scored pair merges first, the leftmost of equals."""
        rank = self.rank
        symbols: list[str] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair][0], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heapq.heappush(agenda, (rank[new][0], i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heapq.heappush(agenda, (rank[new][0], h, new))
        ids: list[int] = []
        for s in symbols:
            if s:
                ids += [rank[s][1]] if s in rank else [self.byte_id[b] for b in s.encode()]
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """encode_chunk of each: one agenda of (score, place) per chunk, and every chunk with pairs left pops its best at once.

        Symbols that are no piece never merge; they have a negative id here, and become bytes at the end.
        """
        out: list[list[int]] = [[]] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= LONG]
        for i, c in enumerate(chunks):
            if len(c) > LONG:
                out[i] = self.encode_chunk(c)
        if not short:
            return out
        points = np.frombuffer("".join([chunks[i] for i in short]).encode("utf-32-le"), np.uint32)
        kinds, at = np.unique(points, return_inverse=True)
        ids = np.array([self.char_id.get(chr(p), -1 - int(p)) for p in kinds], np.int64)[at]
        owner = np.repeat(np.arange(len(short)), [len(chunks[i]) for i in short])
        done_ids, done_owner = [], []
        far = np.int64(1) << 60
        while True:
            left, right = ids[:-1], ids[1:]
            key = np.where((owner[1:] == owner[:-1]) & (left >= 0) & (right >= 0), left * self.n + right, -1)
            slot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            good = np.append(self.pair_keys[slot] == key, False)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(first, len(owner)))
            place = np.arange(len(ids)) - np.repeat(first, sizes)
            agenda = np.where(good, np.append(self.pair_costs[slot], 0) * (LONG + 1) + place, far)
            best = np.minimum.reduceat(agenda, first)
            open_ = np.repeat(best < far, sizes)
            done_ids.append(ids[~open_])
            done_owner.append(owner[~open_])
            if not open_.any():
                break
            i = first[best < far] + best[best < far] % (LONG + 1)
            ids[i] = self.pair_ids[slot[i]]
            open_[i + 1] = False
            ids, owner = ids[open_], owner[open_]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        ids = ids[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(short))).tolist()
        listed, lo = ids.tolist(), 0
        odd = bool((ids < 0).any())
        for i, hi in zip(short, ends, strict=True):
            own = listed[lo:hi]
            if odd and min(own, default=0) < 0:
                own = [y for x in own for y in ((x,) if x >= 0 else [self.byte_id[b] for b in chr(-1 - x).encode()])]
            out[i], lo = own, hi
        return out

    def known(self, chunks: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        """Of each chunk: its ids in decimal (each after a space), their number and their text; checked against the library."""
        texts = [c.decode() for c in chunks]
        coded = self.encode_chunks([t.replace(" ", SPACE) for t in texts])
        table, decimal = self.bytes_of, self.decimal
        back = [b"".join([table[i] for i in ids]) for ids in coded]
        held = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " "]  # the library puts the first space itself
        right = self.sp.encode([texts[i][1:] for i in held], num_threads=1)
        said = self.sp.decode(right, num_threads=1) if held else []
        for i, ids, text in zip(held, right, said, strict=True):
            if ids != coded[i] or text.encode() != back[i][1:]:  # the library's word stands
                coded[i], back[i] = ids, b" " + text.encode()
                self.differing += 1
        return [(b"".join([decimal[i] for i in ids]), len(ids), chunk if text == chunk else text) for ids, text, chunk in zip(coded, back, chunks, strict=True)]


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cuts " " + text before each run of spaces (plain or U+2581); (the chunks, how many each text has). Empty texts have none."""
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    parts = [b for t in texts.to_pylist() if t for b in (b" ", t)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.where(size > 0, size + 1, 0)
    starts = np.cumsum(sizes) - sizes
    space = data == 32
    run = space.copy()
    if len(data) > 2:  # U+2581 is E2 96 81
        wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        space[wide] = True
        for k in range(3):
            run[wide + k] = True
    cut = space.copy()
    cut[1:] &= ~run[:-1]
    cut[starts[size > 0]] = True
    at = np.flatnonzero(cut)
    bounds = np.append(at, len(data)).astype(np.int64)
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return made, np.searchsorted(at, starts + sizes) - np.searchsorted(at, starts)


def _encoded(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = MergeVocabulary(model_file)
        remembered: dict[bytes, tuple[bytes, int, bytes]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 3000):  # bounds what is held at once
                part = batch.slice(lo, 3000)
                texts = part.column(1).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
                texts = pa.concat_arrays([texts])
                chunks, counts = chunks_of(texts)
                coded = chunks.dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(remembered) > REMEMBERED:
                    remembered = {}
                new = [w for w in words if w not in remembered]
                remembered.update(zip(new, vocabulary.known(new), strict=True))
                got = [remembered[w] for w in words]
                decimal, back = [x[0] for x in got], [x[2] for x in got]
                lengths = np.fromiter((x[1] for x in got), np.int64, len(got))
                true_back = np.fromiter((b == w for b, w in zip(back, words, strict=True)), bool, len(words))
                codes = coded.indices.to_numpy(zero_copy_only=False)
                listed = codes.tolist()
                ends = np.cumsum(counts)
                total = np.concatenate([[0], np.cumsum(lengths[codes])])
                off = np.concatenate([[0], np.cumsum(~true_back[codes])])
                n_tokens, ids_sha, text_sha, kept = [], [], [], texts.to_pylist()
                eos = b" %d" % vocabulary.eos
                for k, (c, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    own = listed[e - c : e]
                    ids = b"".join([decimal[i] for i in own]) + eos
                    text = kept[k] if off[e] == off[e - c] else b"".join([back[i] for i in own])[1:]
                    n_tokens.append(int(total[e] - total[e - c]) + 1)
                    ids_sha.append(hashlib.sha256(ids[1:]).hexdigest())
                    text_sha.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, with an end id; no shuffle.

    A null text counts as empty and has the end id alone. Each batch's distinct chunks (a word with the spaces before
    it; pieces never go over one's end) are encoded with the agenda and held against the library, ids and decoded text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(model_file), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(model_file: str):
    def run(batches):
        vocabulary = MergeVocabulary(model_file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = pa.concat_arrays([part.column(1).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")])
                chunks, counts = chunks_of(texts)
                coded = chunks.dictionary_encode()
                ids = vocabulary.encode_chunks([w.decode().replace(" ", SPACE) for w in coded.dictionary.to_pylist()])
                codes, ends, out = coded.indices.to_pylist(), np.cumsum(counts).tolist(), []
                for c, e in zip(counts.tolist(), ends, strict=True):
                    out.append([i for w in codes[e - c : e] for i in ids[w]] + [vocabulary.eos])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_ids(model_file), f"doc_id {kind}, ids array<int>")


def _texts(model_file: str):
    def run(batches):
        vocabulary = MergeVocabulary(model_file)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                text = b"".join(vocabulary.bytes_of.get(i, b"") for i in ids or ())
                out.append(text.removeprefix(b" ").decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; control ids give no text, null ids an empty one."""
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_texts(model_file), f"doc_id {kind}, text string")
