"""Substring dedup over bytes with suffix arrays, built by grouping suffixes by their Lyndon prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import letters as L
from tidemark.llm.common import Scratch
from tidemark.llm.letters import U64, mix

#: An anchor is a place whose next GRAM bytes hash under one in SPACING; windows within WIDE bytes before it are its unit.
GRAM, SPACING, SHARED = 12, 32, 48
#: A token is what lies between places whose next CUT bytes hash under one in EVERY.
CUT, EVERY = 3, 12
#: Tokens that one suffix array is built over.
MOST_TOKENS = 60_000


def suffix_array(text: list[int]) -> list[int]:
    """The starts of text's suffixes in ascending order, in linear time.

    Grouping: suffixes start in groups by first symbol, and a group is worked on from the greatest downward. By then a
    group's suffixes share their longest Lyndon prefix. Each one's previous smaller suffix is the nearest to its left
    that isn't worked on yet; that one's Lyndon prefix goes on with the group's. Those with the most such
    continuations form the uppermost new groups, each right above the one it comes from.
    Emitting: in ascending order, a suffix settles the ones whose next smaller suffix it is: the one before it, that
    one's previous smaller suffix, and so on until a settled one. Each takes the first free place of its group.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    kinds = {s: k for k, s in enumerate(sorted(set(text)))}
    group = [kinds[s] for s in text]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(kinds) - 1))  # the next group downward
    above_of = list(range(1, len(kinds) + 1))  # and upward
    left, right = list(range(-1, n)), list(range(1, n + 1))  # among what isn't worked on
    previous = [-1] * n
    done: list[int] = []
    g = len(kinds) - 1
    while g >= 0:
        moved: dict[tuple[int, int], list[int]] = {}
        for s in members[g]:
            if group[s] != g:
                continue
            p = left[s]
            if p >= 0 and group[p] == g:
                continue  # its run's first member takes it along
            k, t = 0, s
            while t < n and group[t] == g:
                previous[t] = p
                k += 1
                t = right[t]
            if p >= 0:
                right[p] = t
                key = (k, group[p])
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            if t < n:
                left[t] = p
        done.append(g)
        if moved:
            for key in sorted(moved, reverse=True):
                own, old, new = moved[key], key[1], len(members)
                for p in own:
                    group[p] = new
                members.append(own)
                up = above_of[old]
                below.append(old)
                above_of.append(up)
                above_of[old] = new
                below[up] = new
        g = below[g]
    free, at = [0] * len(members), 0
    sizes = [0] * len(members)
    for x in group:
        sizes[x] += 1
    for x in reversed(done):
        free[x] = at
        at += sizes[x]
    out, settled = [-1] * n, [False] * n
    # the end of the text is the least suffix of all: it settles the last place's chain
    j = n - 1
    while j >= 0:
        out[free[group[j]]] = j
        free[group[j]] += 1
        settled[j] = True
        j = previous[j]
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not settled[j]:
            x = group[j]
            out[free[x]] = j
            free[x] += 1
            settled[j] = True
            j = previous[j]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many symbols, up to most, each suffix of order shares with the one before it; the text must end in a symbol of its own."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for t in range(most):
        a, b = order[at] + t, order[at - 1] + t
        at = at[(a < len(text)) & (b < len(text))]
        a, b = order[at] + t, order[at - 1] + t
        at = at[text[a] == text[b]]
        if not len(at):
            break
        out[at] += 1
    return out


_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=U64)


def _rolling() -> tuple[L.Rolling, L.Rolling]:
    return L.Rolling(0x9E3779B97F4A7C15), L.Rolling(0xC2B2AE3D27D4EB4F)


def _places(h: L.Rolling, n: int, width: int, every: int, salt: int) -> np.ndarray:
    if n < width:
        return np.zeros(0, np.int64)
    at = np.arange(n - width + 1)
    return np.flatnonzero(mix(h.of(at, at + width) ^ U64(salt)) < U64((1 << 64) // every))


class Windows:
    """The windows of a pack by the first anchor in each: unit i has the starts first[i] to last[i]; loose ones have no anchor in reach."""

    def __init__(self, texts: pa.LargeBinaryArray, window: int, hashes: tuple[L.Rolling, L.Rolling]):
        all_texts = texts.to_pylist()
        self.data = data = np.frombuffer(b"".join(all_texts), np.uint8)
        self.window, n = window, len(data)
        sizes = np.array([len(t) for t in all_texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.one, self.two = hashes[0].load(_TABLE[data]), hashes[1].load(_TABLE[255 - data] + U64(1))
        reach, shared = window - min(SHARED, window // 2), min(SHARED, window // 2)
        at = _places(self.one, n, min(GRAM, shared), SPACING, 0)
        doc = np.searchsorted(self.ends, at, side="right")
        begin, end = self.begins[doc], self.ends[doc]
        before = np.append(-1, at[:-1]) if n and len(at) else at
        first = np.maximum(np.maximum(begin, before + 1), at - reach)
        last = np.minimum(at, end - window)
        some = last >= first
        self.at, self.first, self.last, self.shared = at[some], first[some], last[some], shared
        whole = np.zeros(n + 1, np.int64)
        for lo, hi, by in ((self.begins, self.ends - window, 1), (self.first, self.last, -1)):
            keep = hi >= lo
            np.add.at(whole, lo[keep], by)
            np.add.at(whole, hi[keep] + 1, -by)
        self.loose = np.flatnonzero(np.cumsum(whole[:-1]) > 0)

    def units(self, buckets: int) -> L.Entries:
        names = self.one.of(self.at, self.at + self.shared)
        place = mix(((self.at - self.first) * 1009 + self.last - self.first).astype(U64))
        details = mix(self.two.of(self.first, self.last + self.window) ^ place)
        return L.Entries(names, details, np.zeros(len(names), bool), buckets)

    def kinds(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return told & 7, (told & L.MANY) > 0

    def asked(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows to compare by fingerprint: those of units whose anchor has very many unlike units, and loose ones."""
        kind, many = self.kinds(told)
        open_ = many & ((kind == L.FIRST) | (kind == L.DIFFERS))
        at = L.ranges(self.first[open_], self.last[open_])
        sure = np.repeat(kind[open_] == L.FIRST, (self.last - self.first + 1)[open_])
        return np.concatenate([at, self.loose]), np.concatenate([sure, np.zeros(len(self.loose), bool)])

    def sorted_units(self, told: np.ndarray) -> np.ndarray:
        """The units to compare by suffix array, one of each sort, in the order of their anchors' names."""
        kind, many = self.kinds(told)
        at = np.flatnonzero(~many & ((kind == L.FIRST) | (kind == L.DIFFERS)))
        names = self.one.of(self.at[at], self.at[at] + self.shared)
        return at[np.argsort(names, kind="stable")]

    def entries(self, at: np.ndarray, sure: np.ndarray, buckets: int) -> L.Entries:
        return L.Entries(self.one.of(at, at + self.window), self.two.of(at, at + self.window), sure, buckets)

    def unit_letters(self, at: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
        """To bucket + buckets: the units' texts, by their anchors' names."""
        if not len(at):
            return
        names = self.one.of(self.at[at], self.at[at] + self.shared)
        bucket = ((names >> U64(32)) * U64(buckets)) >> U64(32)
        bounds = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
        sizes = (self.last - self.first + self.window)[at]
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = at[bounds[b] : bounds[b + 1]]
            text = self.data[L.ranges(self.first[own], self.last[own] + self.window - 1)]
            head = np.concatenate([np.array([len(own)], np.uint32), sizes[bounds[b] : bounds[b + 1]].astype(np.uint32)])
            yield b + buckets, zlib.compress(head.tobytes() + names[bounds[b] : bounds[b + 1]].tobytes() + text.tobytes(), 1)


def repeated_windows(texts: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """For each window of the given stretches, in order: whether its bytes stand in another place of them too.

    The texts are cut into tokens where their bytes say so, which a window does alike in each of its copies. The suffix
    array over the tokens tells which windows hold the same whole tokens; the rests at both ends are compared besides.
    """
    n = len(texts)
    h = L.Rolling(0x9E3779B97F4A7C15).load(_TABLE[texts])
    inside = np.repeat(np.arange(len(begins)), ends - begins)
    cut = _places(h, n, CUT, EVERY, 77)
    cut = cut[inside[cut] == inside[np.minimum(cut + CUT - 1, n - 1)]]
    owner = inside[cut]
    next_ = np.append(cut[1:], n)
    closed = np.append(owner[1:] == owner[:-1], False) if len(cut) else np.zeros(0, bool)
    # tokens between cuts have names from 1; a text's last cut has the symbol 0, which no window looks at
    starts, stops = cut[closed], next_[closed]
    pool = texts[L.ranges(starts, stops - 1)]
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int64)
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(pool)]).dictionary_encode().indices.to_numpy()
    symbol = np.zeros(len(cut), np.int64)
    symbol[closed] = names + 1
    at = L.ranges(begins, ends - window)
    first, last = np.searchsorted(cut, at), np.searchsorted(cut, at + window - CUT, side="right") - 1
    count = last - first  # whole tokens in the window
    ruled = count > 0
    key = np.empty(len(at), U64)
    bare = at[~ruled]
    key[~ruled] = h.of(bare, bare + window)
    if ruled.any():
        order = np.array(suffix_array(symbol.tolist()), np.int64)
        most = int(count.max())
        shared = common_prefixes(symbol, order, most)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which, k = rank[first[ruled]], count[ruled]
        same = np.empty(len(k), np.int64)
        by = np.argsort(k, kind="stable")
        edges = np.searchsorted(k[by], np.arange(most + 2))
        for c in range(1, most + 1):
            own = by[edges[c] : edges[c + 1]]
            if len(own):
                same[own] = np.cumsum(shared < c)[which[own]]
        a = at[ruled]
        head, tail = h.of(a, cut[first[ruled]]), h.of(cut[last[ruled]], a + window)
        key[ruled] = mix(mix(mix(same.astype(U64) * U64(4096) + k.astype(U64)) + head) ^ (tail * U64(0x9FB21C651E98DF25)))
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[back] > 1


def _sorted_answers(window: int, payloads: list[bytes]) -> list[bytes]:
    sizes, names, parts = [], [], []
    for p in payloads:
        raw = zlib.decompress(p)
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        sizes.append(np.frombuffer(raw, np.uint32, n, 4).astype(np.int64))
        names.append(np.frombuffer(raw, U64, n, 4 + 4 * n))
        parts.append(np.frombuffer(raw, np.uint8, -1, 4 + 12 * n))
    size, name, data = np.concatenate(sizes), np.concatenate(names), np.concatenate(parts)
    start = np.cumsum(size) - size
    order = np.argsort(name, kind="stable")
    windows = size - window + 1
    out_at = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), np.uint8)
    # by whole names, so many at a time that one suffix array stays small;
    edge = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
    filled = np.cumsum(size[order]) // (MOST_TOKENS * EVERY)
    cuts = edge[np.flatnonzero(np.append(True, filled[edge][1:] != filled[edge][:-1]))]
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        own = order[lo:hi]
        text = data[L.ranges(start[own], start[own] + size[own] - 1)]
        ends = np.cumsum(size[own])
        out[L.ranges(out_at[own], out_at[own] + windows[own] - 1)] = repeated_windows(text, ends - size[own], ends, window)
    stops = np.cumsum([int((s - window + 1).sum()) for s in sizes])
    return [zlib.compress(x.tobytes(), 1) for x in np.split(out, stops[:-1])]


def _first_question(window: int, buckets: int):
    def send(row: dict):
        return Windows(L.unpacked(row["body"])[1], window, _rolling()).units(buckets).letters()

    return send


def _second_question(window: int, buckets: int):
    def send(row: dict):
        w = Windows(L.unpacked(row["body"])[1], window, _rolling())
        told = L.joined(row["units"])[w.units(buckets).place]
        yield from w.entries(*w.asked(told), buckets).letters()
        yield from w.unit_letters(w.sorted_units(told), buckets)

    return send


def _second_answer(window: int, buckets: int):
    def answer(bucket: int, payloads: list[bytes]) -> list[bytes]:
        return L.repeated(bucket, payloads) if bucket < buckets else _sorted_answers(window, payloads)

    return answer


def _dropped(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _rolling()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, texts = L.unpacked(row["body"])
                w = Windows(texts, window, hashes)
                told = L.joined(row["units"])[w.units(buckets).place]
                kind, _ = w.kinds(told)
                sure = (kind >= L.ALL_SAME) & (kind <= L.FOLLOWS)
                at, flags = w.asked(told)
                more = L.joined(row["windows"], 0, buckets)[w.entries(at, flags, buckets).place] > 0
                unit = w.sorted_units(told)
                heard = L.joined(row["windows"], buckets) > 0
                starts = np.concatenate([L.ranges(w.first[sure], w.last[sure]), at[more], L.ranges(w.first[unit], w.last[unit])[heard]])
                n = len(w.data)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                run_starts = gone.copy()
                run_starts[1:] &= ~gone[:-1]
                run_starts[w.begins[w.begins < w.ends]] |= gone[w.begins[w.begins < w.ends]]
                total, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(run_starts))
                removed = total[w.ends] - total[w.begins]
                kept = [w.data[b:e][~gone[b:e]].tobytes() if r else t for b, e, r, t in zip(w.begins.tolist(), w.ends.tolist(), removed.tolist(), texts.to_pylist(), strict=True)]
                columns = [pa.array(x, pa.int64()) for x in (w.ends - w.begins, removed, spans[w.ends] - spans[w.begins])]
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row: its UTF-8 bytes without those in a window that also starts elsewhere.

    A null text counts as empty. Repeated rows are repeats of each other. Columns other than the two named are not looked at.

    Documents first ask which of their units (windows with one first anchor) share the anchor with any other place, and
    which of those are equal as a whole. Texts of units that share it with unequal ones are sorted by suffix array in
    the anchor's bucket, where the fate of each of their windows shows. An anchor with more than FEW unlike units (the
    edge of a passage that very many documents hold) doesn't go to one bucket: its windows are compared one by one,
    spread by fingerprints of 96 bits, and so are windows with no anchor in reach.
    """
    packs = L.packs_of(docs, id_col, text_col, scratch or Scratch(docs.sparkSession))
    buckets = L.bucket_count(packs.sparkSession)
    units = L.exchange(packs, _first_question(window, buckets), L.unit_classes, buckets)
    packs = L.asked(packs, units, "units")
    windows = L.exchange(packs, _second_question(window, buckets), _second_answer(window, buckets), buckets)
    packs = L.asked(packs, windows, "windows")
    kind = docs.schema[id_col].dataType.simpleString()
    return packs.mapInArrow(_dropped(window, buckets), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
