"""Substring dedup over words by recompression: rounds that name runs and pairs alike everywhere; what shares no symbol shares no window."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm import letters as L
from tidemark.llm.common import Scratch
from tidemark.llm.letters import U64, mix

ROUNDS = 6


class Parse:
    """A pack's words and its symbols after some rounds.

    A symbol's name is a fingerprint of what it stands for, so that equal stretches of any two documents get equal names
    without a table of names to share. start and end are its words; lo and hi the words that settle it: if a stretch of
    text holds lo to hi, each other copy of the stretch, in whatever surroundings, has the same symbol at the same
    place. A symbol that is what it is because the document begins or ends there has lo or hi beyond the document.
    """

    def __init__(self, texts: pa.LargeBinaryArray, rounds: int = ROUNDS):
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = lists.flatten()
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.greater(pc.binary_length(words), 0)
        words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
        coded = words.cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        one, two = (np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), U64, len(distinct))[codes] for seed in (1, 2))
        self.doc, self.word, self.word2 = doc, one, two
        self.ends = np.searchsorted(doc, np.arange(len(texts)), side="right")
        self.begins = np.searchsorted(doc, np.arange(len(texts)), side="left")
        n = len(one)
        self.name, self.start, self.end = one, np.arange(n), np.arange(1, n + 1)
        self.lo, self.hi = self.start.copy(), self.end.copy()
        for k in range(rounds):
            if len(self.name):
                self.name_runs()
                self.name_pairs(k)

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        d = self.doc[self.start]
        new = np.append(True, d[1:] != d[:-1])
        return new, np.append(new[1:], True)

    def name_runs(self) -> None:
        """A run of one symbol becomes a symbol; what isn't a run is so because the neighbours differ."""
        new, last = self._edges()
        head = new.copy()
        head[1:] |= self.name[1:] != self.name[:-1]
        a = np.flatnonzero(head)
        b = np.append(a[1:], len(head)) - 1
        size = b - a + 1
        name = np.where(size > 1, mix(self.name[a] ^ mix(size.astype(U64) + U64(1 << 40))), self.name[a])
        start, end = self.start[a], self.end[b]
        # a word that differs from the symbol's own last word shows that the symbol before is another
        word = self.word
        left = np.where(word[start - 1] != word[self.end[a] - 1], start - 1, np.minimum(self.lo[a - 1], start - 1))
        left[new[a]] = start[new[a]] - 1
        stop = np.minimum(end, len(word) - 1)
        right = np.where(word[stop] != word[self.start[b]], end + 1, np.maximum(self.hi[np.minimum(b + 1, len(head) - 1)], end + 1))
        right[last[b]] = end[last[b]] + 1
        self.lo, self.hi = np.minimum(self.lo[a], left), np.maximum(self.hi[b], right)
        self.name, self.start, self.end = name, start, end

    def name_pairs(self, k: int) -> None:
        """Each name is a left or a right one, by its fingerprint and the round; a left one with a right one behind it becomes a symbol."""
        new, last = self._edges()
        right = (mix(self.name ^ U64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U64(63)) == 1
        paired = np.append(~right[:-1] & right[1:] & ~new[1:], False)
        taken = np.append(False, paired[:-1])
        at = np.flatnonzero(~taken)
        two = paired[at]
        nxt, prv = np.minimum(at + 1, len(right) - 1), np.maximum(at - 1, 0)
        name = np.where(two, mix(self.name[at] * U64(0x9FB21C651E98DF25) + mix(self.name[nxt])), self.name[at])
        end = np.where(two, self.end[nxt], self.end[at])
        # a lone symbol is settled by the neighbour that it would have gone with
        lo = np.where(right[at], np.where(new[at], self.start[at] - 1, self.lo[prv]), self.lo[at])
        hi = np.where(two, self.hi[nxt], np.where(right[at], self.hi[at], np.where(last[at], end + 1, self.hi[nxt])))
        self.lo, self.hi = np.minimum(lo, self.lo[at]), np.maximum(hi, np.where(two, self.hi[nxt], self.hi[at]))
        self.name, self.start, self.end = name, self.start[at], end


class Windows:
    """The windows of a pack by the first symbol that each settles: unit i has first[i] to last[i]; loose ones settle none."""

    def __init__(self, texts: pa.LargeBinaryArray, window: int, hashes: tuple[L.Rolling, L.Rolling]):
        self.parse = p = Parse(texts)
        self.window, n = window, len(p.word)
        begin, end = p.begins[p.doc[p.start]] if n else p.start, p.ends[p.doc[p.start]] if n else p.start
        fit = (p.lo >= begin) & (p.hi <= end) & (p.hi - p.lo <= window)
        lo, hi, begin, end = p.lo[fit], p.hi[fit], begin[fit], end[fit]
        before = np.append(-1, lo[:-1]) if len(lo) else lo
        first = np.maximum(np.maximum(np.where(before >= begin, before + 1, begin), hi - window), begin)
        last = np.minimum(lo, end - window)
        some = last >= first
        self.lo, self.hi, self.first, self.last = lo[some], hi[some], first[some], last[some]
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, self.first, 1)
        np.add.at(covered, self.last + 1, -1)
        whole = np.zeros(n, bool)
        whole[L.ranges(p.begins, p.ends - window)] = True
        self.loose = np.flatnonzero(whole & (np.cumsum(covered[:-1]) == 0))
        self.one, self.two = hashes[0].load(p.word), hashes[1].load(p.word2)

    def units(self, buckets: int) -> L.Entries:
        """A unit's name is what all its windows share, the words that settle its symbol; its detail all its words."""
        names = self.one.of(self.lo, self.hi)
        place = mix(((self.lo - self.first) * 1009 + self.last - self.first).astype(U64))
        details = mix(self.two.of(self.first, self.last + self.window) ^ place)
        return L.Entries(names, details, np.zeros(len(names), bool), buckets)

    def asked(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that have to be compared themselves, and which of them stand elsewhere for sure."""
        kind = told & 7
        open_ = (kind == L.FIRST) | (kind == L.DIFFERS)
        at = L.ranges(self.first[open_], self.last[open_])
        sure = np.repeat(kind[open_] == L.FIRST, (self.last - self.first + 1)[open_])
        return np.concatenate([at, self.loose]), np.concatenate([sure, np.zeros(len(self.loose), bool)])

    def entries(self, at: np.ndarray, sure: np.ndarray, buckets: int) -> L.Entries:
        return L.Entries(self.one.of(at, at + self.window), self.two.of(at, at + self.window), sure, buckets)

    def found(self, told: np.ndarray) -> np.ndarray:
        """The windows that stand elsewhere by what is known of their units."""
        kind = told & 7
        return L.ranges(*(x[(kind >= L.ALL_SAME) & (kind <= L.FOLLOWS)] for x in (self.first, self.last)))


def _hashes() -> tuple[L.Rolling, L.Rolling]:
    return L.Rolling(0x9E3779B97F4A7C15), L.Rolling(0xC2B2AE3D27D4EB4F)


def _covered(size: int, at: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _first_question(window: int, buckets: int):
    def send(row: dict):
        return Windows(L.unpacked(row["body"])[1], window, _hashes()).units(buckets).letters()

    return send


def _second_question(window: int, buckets: int):
    def send(row: dict):
        w = Windows(L.unpacked(row["body"])[1], window, _hashes())
        told = L.joined(row["units"])[w.units(buckets).place]
        return w.entries(*w.asked(told), buckets).letters()

    return send


def _dropped(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, texts = L.unpacked(row["body"])
                w = Windows(texts, window, hashes)
                told = L.joined(row["units"])[w.units(buckets).place]
                at, sure = w.asked(told)
                more = L.joined(row["windows"])[w.entries(at, sure, buckets).place] > 0
                gone = _covered(len(w.parse.word), np.concatenate([w.found(told), at[more]]), window)
                begins, ends = w.parse.begins, w.parse.ends
                total = np.append(0, np.cumsum(gone))
                n_gone, kept = total[ends] - total[begins], []
                for k, text in enumerate(texts.to_pylist()):
                    words = text.split()
                    kept.append(b" ".join(compress(words, (~gone[begins[k] : ends[k]]).tolist()) if n_gone[k] else words))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ends - begins, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept of each row: its words without those in a window that also starts elsewhere.

    Words are runs of other bytes than space and 0x09 to 0x0D; kept joins those left by one space. A null or empty text
    has no words. Repeated rows are repeats of each other; a text repeated within itself counts too. Columns other than
    the two named are not looked at; an empty table gives an empty result. scratch: takes what is stored on the way,
    for the caller to remove.

    First every document asks which of its units (windows that settle the same recompression symbol) share that
    symbol, with the words that settle it, with any other place; where they do, which are equal as a whole. Only
    windows of units that share their symbol with unequal ones, and windows that settle none (long runs), are then
    compared one by one, by fingerprints of 96 bits over words of 64.
    """
    packs = L.packs_of(docs, id_col, text_col, scratch or Scratch(docs.sparkSession))
    buckets = L.bucket_count(packs.sparkSession)
    units = L.exchange(packs, _first_question(window, buckets), L.unit_classes, buckets)
    packs = L.asked(packs, units, "units")
    windows = L.exchange(packs, _second_question(window, buckets), L.repeated, buckets)
    packs = L.asked(packs, windows, "windows")
    kind = docs.schema[id_col].dataType.simpleString()
    return packs.mapInArrow(_dropped(window, buckets), f"doc_id {kind}, n_words long, n_removed long, kept string")
