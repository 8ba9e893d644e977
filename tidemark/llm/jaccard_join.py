"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import letters as L
from tidemark.llm.common import Scratch, written
from tidemark.llm.components import components
from tidemark.llm.letters import U64, mix

#: Stands for a null id, which ranks behind any other.
NO_ID = (1 << 63) - 1
#: Matches asked for, in hundredths of a set's size (besides one): the first cut takes FIRST_CUT, pairs the cheapest of LEVELS.
FIRST_CUT, LEVELS = 15, (0, 5, 15)
#: A set's smallest names, by which it finds the set to be held against first.
SKETCH = 16
#: The price of a candidate, in rows of the join that finds candidates.
VERIFIED = 2
#: A border set's commonest names, by which it finds its second hub.
COMMON = 4
#: Further hubs for sets still at the border, at most; fewer where one round links nothing any more.
ROUNDS = 2
#: Names in a pack of sets.
SET_PACK = 1 << 19


def needed(n, percent: int):
    """ceil(percent * n / 100): the least overlap that a partner of a set of n must have."""
    return -(-percent * n // 100)


def as_smaller(n, percent: int):
    """The least overlap of a set of n with a partner that isn't smaller: percent / (100 + percent) of both sizes."""
    return -(-2 * percent * n // (100 + percent))


def matches(n, level: int):
    return n * level // 100 + 1


class Sets:
    """The distinct word n-gram names of each text of a pack, in ascending order: size per text, and all names in a row."""

    def __init__(self, texts: pa.LargeBinaryArray, words: int):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.greater(pc.binary_length(flat), 0)
        flat, doc = flat.filter(full), doc[full.to_numpy(zero_copy_only=False)]
        coded = flat.cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = np.fromiter((xxhash.xxh3_64_intdigest(w, 3) for w in distinct), U64, len(distinct))[coded.indices.to_numpy()]
        n = len(ids)
        k = min(words, n) if n else 0
        count = np.bincount(doc, minlength=len(texts))
        begin = np.cumsum(count) - count
        name = np.zeros(max(n - words + 1, 0), U64)
        for i in range(words):
            name = mix(name + U64(i + 1)) + ids[i : i + len(name)] if len(name) else name
        whole = doc[: len(name)] == doc[words - 1 : words - 1 + len(name)] if len(name) else np.zeros(0, bool)
        names, owner = [mix(name[whole])], [doc[: len(name)][whole]]
        short = np.flatnonzero((count > 0) & (count < words))
        rest = np.zeros(len(short), U64)
        for i in range(k and words - 1):
            more = count[short] > i
            rest[more] = mix(rest[more] + U64(i + 101)) + ids[begin[short[more]] + i]
        names.append(mix(rest))
        owner.append(short)
        name, owner = np.concatenate(names), np.concatenate(owner)
        order = np.lexsort((name, owner))
        name, owner = name[order], owner[order]
        fresh = np.append(True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])) if len(name) else np.zeros(0, bool)
        self.name, self.owner = name[fresh], owner[fresh]
        self.size = np.bincount(self.owner, minlength=len(texts))
        self.begin = np.cumsum(self.size) - self.size
        place = np.arange(len(self.name)) - self.begin[self.owner]
        #: The hash order is the order of all prefixes.
        self.place = place

    def prefix(self, percent: int, level: int) -> np.ndarray:
        """The names in prefixes that any set's partner shares matches(.., level) of."""
        reach = self.size - needed(self.size, percent) + matches(self.size, level)
        return np.flatnonzero(self.place < reach[self.owner])

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set; sums, so that the order doesn't matter."""
        edge = np.append(0, np.cumsum(mix(self.name))), np.append(0, np.cumsum(mix(self.name ^ U64(0x5851F42D4C957F2D))))
        one, two = (mix((e.astype(U64)[self.begin + self.size] - e.astype(U64)[self.begin]) + self.size.astype(U64)) for e in edge)
        return one, two


def _ids(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _by_print(sets: Sets, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have a set, in the order of their prints' buckets."""
    one, two = sets.prints()
    some = np.flatnonzero(sets.size > 0)
    some = some[np.lexsort((some, one[some]))]
    bucket = ((one[some] >> U64(32)) * U64(buckets)) >> U64(32)
    return some, np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64)), one, two


def _question(words: int, percent: int, buckets: int):
    def send(row: dict):
        ids, texts = L.unpacked(row["body"])
        sets = Sets(texts, words)
        names = sets.name[sets.prefix(percent, FIRST_CUT)]
        yield from L.Entries(names, np.zeros(len(names), U64), np.zeros(len(names), bool), buckets).letters()
        some, bounds, one, two = _by_print(sets, buckets)
        ids = _ids(ids)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = some[bounds[b] : bounds[b + 1]]
            yield b + buckets, np.concatenate([one[own], two[own], ids[own].view(U64)]).tobytes()

    return send


def _answer(buckets: int):
    def answer(bucket: int, payloads: list[bytes]) -> list[bytes]:
        if bucket < buckets:
            return L.repeated(bucket, payloads)
        parts = [np.frombuffer(p, U64).reshape(3, -1) for p in payloads]
        one, two, ids = np.concatenate(parts, axis=1)
        ids = ids.view(np.int64)
        order = np.lexsort((ids, two, one))
        o, t = one[order], two[order]
        fresh = np.append(True, (o[1:] != o[:-1]) | (t[1:] != t[:-1]))
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order][fresh][np.cumsum(fresh) - 1]
        stops = np.cumsum([p.shape[1] for p in parts])
        return [zlib.compress(x.tobytes(), 1) for x in np.split(least, stops[:-1])]

    return answer


def _heard(words: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, texts = L.unpacked(row["body"])
                sets, own = Sets(texts, words), _ids(ids)
                at = sets.prefix(percent, FIRST_CUT)
                names = sets.name[at]
                entries = L.Entries(names, np.zeros(len(names), U64), np.zeros(len(names), bool), buckets)
                shared = L.joined(row["replies"], 0, buckets)[entries.place] > 0
                hits = np.bincount(sets.owner[at], shared, minlength=len(own)).astype(np.int64)
                some, _, one, two = _by_print(sets, buckets)
                rep = own.copy()
                rep[some] = L.joined(row["replies"], buckets).view(np.int64)
                kept = (sets.size > 0) & (hits >= matches(needed(sets.size, percent), FIRST_CUT)) & (rep == own)
                # of texts in this pack that have one id and one set, one is enough
                at_kept = np.flatnonzero(kept)
                at_kept = at_kept[np.lexsort((at_kept, two[at_kept], one[at_kept], own[at_kept]))]
                again = (np.diff(own[at_kept]) == 0) & (one[at_kept][1:] == one[at_kept][:-1]) & (two[at_kept][1:] == two[at_kept][:-1])
                kept[at_kept[1:][again]] = False
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(kept, sets.size, 0))), pa.int32()), pa.array(sets.name[kept[sets.owner]].view(np.int64)), mask=pa.array(~kept))
                asked = np.maximum(np.bincount(sets.owner[at], minlength=len(own)), 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets.size, pa.int64()), pa.array(rep), pa.array(hits * 1000 // asked, pa.int64()), lists], ["doc_id", "n", "rep", "score", "names"])

    return run


def _linked(percent: int) -> Column:
    both = F.size(F.array_intersect("x_names", "y_names")).cast("long")
    return 100 * both >= percent * (F.size("x_names") + F.size("y_names") - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of sets that link, as (u, v). A set that very many pairs name is the skewed side of a join, which can be split."""
    x = sets.select(F.col("rep").alias("x"), F.col("names").alias("x_names"))
    y = sets.select(F.col("rep").alias("y"), F.col("names").alias("y_names"))
    return pairs.join(x, "x").join(y, "y").filter(_linked(percent)).select(F.col("x").alias("u"), F.col("y").alias("v"))


def _hubs(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y): y is, of the sets that lead the sets with one of x's smallest names, the one that most of those names lead to.

    The set that shares most of its names with others leads: where copies are made of one text, that text does, and
    not one of its copies, which may be alike with it but not with each other.
    """
    small = sets.select("rep", "score", F.explode(F.slice("names", 1, SKETCH)).alias("name"))
    lead = small.groupBy("name").agg(F.max(F.struct("score", (-F.col("rep")).alias("back"))).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    lead = scratch.written(lead.select("name", (-F.col("lead.back")).alias("hub")), "hubs")
    seen = small.join(lead, "name").filter("hub <> rep").groupBy("rep", "hub").count()
    best = seen.groupBy("rep").agg(F.max(F.struct("count", (-F.col("hub")).alias("back"))).alias("best"))
    return best.select(F.col("rep").alias("x"), (-F.col("best.back")).alias("y"))


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 66], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack_id", "body"])


def _set_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of SET_PACK names, or of one set that has more."""
    for batch in batches:
        size = pc.fill_null(pc.list_value_length(batch.column("names")), 0).to_numpy(zero_copy_only=False)
        pack = np.cumsum(size) // SET_PACK
        cuts = np.flatnonzero(np.append(True, pack[1:] != pack[:-1])) if len(size) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(size)], strict=True):
            yield _packed(batch.slice(lo, hi - lo))


class SetPack:
    """Stored sets with the parts they belong to, and the other numbers stored with them."""

    def __init__(self, body: bytes):
        batch = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]
        for c in batch.schema.names:
            if c != "names":
                setattr(self, c, batch.column(c).to_numpy(zero_copy_only=False))
        lists = pa.concat_arrays([batch.column("names").cast(pa.list_(pa.int64()))])
        self.held = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.name = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
        self.owner = np.repeat(np.arange(len(self.held)), self.held)

    def entries(self, buckets: int) -> L.Entries:
        return L.Entries(self.name, mix(self.part[self.owner].view(U64)), np.zeros(len(self.name), bool), buckets)


def _parts_question(buckets: int):
    def send(row: dict):
        return SetPack(row["body"]).entries(buckets).letters()

    return send


def _by_part(payloads: list[bytes]) -> tuple:
    """The entries (name, part, packs) of all payloads in order, and what puts answers back: per payload, compressed."""
    parts = [L.opened(p) for p in payloads]
    short, long = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    detail, weight = long & ~U64(1), 1 + (long & U64(1)).astype(np.int64)
    order = np.lexsort((detail, short))
    stops = np.cumsum([len(p[0]) for p in parts])[:-1]

    def back(told: np.ndarray) -> list[bytes]:
        out = np.empty(len(told), np.uint8)
        out[order] = told
        return [zlib.compress(x.tobytes(), 1) for x in np.split(out, stops)]

    return short[order], detail[order], weight[order], back


def _ranks(_: int, payloads: list[bytes]) -> list[bytes]:
    """For each name: 0 if it stands in one part only, else a rank that grows with how often it was sent."""
    s, d, weight, back = _by_part(payloads)
    new = np.append(True, s[1:] != s[:-1])
    at = np.cumsum(new) - 1
    kinds, often = np.bincount(at, new | np.append(True, d[1:] != d[:-1])), np.bincount(at, weight)
    return back(np.where(kinds > 1, np.minimum(1 + 4 * np.log2(np.maximum(often, 1)), 255), 0).astype(np.uint8)[at])


#: What a set hears about a key: only its own part has it; its part has it more often than any other; another part has.
OWN, MAIN, OTHER = range(3)


def _mains(_: int, payloads: list[bytes]) -> list[bytes]:
    s, d, weight, back = _by_part(payloads)
    new = np.append(True, s[1:] != s[:-1])
    new_part = new | np.append(True, d[1:] != d[:-1])
    key, part = np.cumsum(new) - 1, np.cumsum(new_part) - 1
    kinds, often = np.bincount(key, new_part), np.bincount(part, weight)
    of = key[new_part]  # each part's key
    main = np.zeros(len(often), bool)
    order = np.lexsort((often, of))
    main[order[np.append(of[order][1:] != of[order][:-1], True)]] = True
    return back(np.where(kinds[key] == 1, OWN, np.where(main[part], MAIN, OTHER)).astype(np.uint8))


def _border(percent: int, buckets: int):
    """The sets that may have a partner in another part, with the longest prefixes they need, and the names they share with most sets.

    The order of all prefixes: names that stand in one part only come first (they are no match for any other part, and
    aren't stored), then the others from rare to frequent. A set with fewer of the latter than a partner must share has
    no partner. A set's level is the cheapest: each match its prefix promises costs a joined row, and each candidate,
    of which a higher level leaves fewer, as much as VERIFIED rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                p = SetPack(row["body"])
                rank = L.joined(row["replies"])[p.entries(buckets).place]
                across = np.bincount(p.owner, rank > 0, minlength=len(p.held)).astype(np.int64)
                need = needed(p.held, percent)
                some = (across >= need) & (p.held > 0)
                use = np.flatnonzero((rank > 0) & some[p.owner])
                use = use[np.lexsort((p.name[use], rank[use], p.owner[use]))]
                owner = p.owner[use]
                left = np.bincount(owner, minlength=len(p.held))
                place = np.arange(len(use)) - (np.cumsum(left) - left)[owner]
                often = 2.0 ** ((rank[use].astype(float) - 1) / 4)
                price = []
                for level in LEVELS:
                    inside = place < (across - as_smaller(p.held, percent) + matches(p.held, level))[owner]
                    price.append(np.bincount(owner, often * inside, minlength=len(p.held)) * (1 + VERIFIED / matches(p.held, level)))
                more = p.held * np.array(LEVELS)[np.argmin(price, axis=0)] // 100
                own = place < (across - need + more + 1)[owner]
                lists = lambda which: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner[which], minlength=len(p.held))[some])), pa.int32()), pa.array(p.name[use[which]].view(np.int64)))
                columns = [p.rep[some], p.part[some], p.held[some], across[some], more[some]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), lists(place >= (across - COMMON)[owner]), lists(own)], ["rep", "part", "n", "across", "more", "common", "names"])

    return run


def size_classes(largest: int) -> np.ndarray:
    """The least size of each class, up to beyond largest: sizes of one class differ by less than 12 hundredths."""
    least = [1]
    while least[-1] <= largest:
        least.append(max(least[-1] + 1, least[-1] * 112 // 100))
    return np.array(least)


#: A row leads to larger partners, follows for smaller ones, or is for partners of just its size.
LEADS, FOLLOWS, EQUAL = range(3)


class Keys:
    """The keys by which border sets meet: a name of the prefix, with the size class of the smaller of the pair.

    The larger a partner must be, the more it must share and the shorter the prefix is. So a set's prefix as the larger
    one has a length for each class of smaller partners, and another for those of its own size: sets that differ from
    one common text each in other places, the usual case, then don't meet by the names that all of them share.
    """

    def __init__(self, p: SetPack, percent: int):
        place = np.arange(len(p.name)) - (np.cumsum(p.held) - p.held)[p.owner]
        room = (p.across + p.more)[p.owner] - place  # of a prefix for partners that must share fewer than this
        n, need = p.n, needed(p.n, percent)
        least = size_classes(int(n.max(initial=0)))
        own = np.searchsorted(least, n, side="right") - 1
        code = lambda at, c: mix(p.name[at] ^ mix(c[p.owner[at]].astype(U64) + U64(1 << 20)))
        first = np.flatnonzero(room >= as_smaller(n, percent)[p.owner])
        found = [(first, code(first, own), LEADS), (first, code(first, n + (1 << 32)), EQUAL)]
        lowest = np.searchsorted(least, need, side="right") - 1
        for back in range(int((own - lowest).max(initial=-1)) + 1):
            k = np.maximum(own - back, 0)
            smallest = np.maximum(least[k], need)
            share = -(-percent * (smallest + n) // (100 + percent))
            at = np.flatnonzero((room >= share[p.owner]) & ((own - back >= lowest) & (smallest < n))[p.owner])
            found.append((at, code(at, k), FOLLOWS))
        self.at = np.concatenate([f[0] for f in found])
        self.key = np.concatenate([f[1] for f in found])
        self.side = np.concatenate([np.full(len(f[0]), f[2], np.int8) for f in found])
        self.owner, self.place, self.pack = p.owner[self.at], place[self.at], p

    def entries(self, buckets: int) -> L.Entries:
        return L.Entries(self.key, mix(self.pack.part[self.owner].view(U64)), np.zeros(len(self.key), bool), buckets)


def _keys_question(percent: int, buckets: int):
    def send(row: dict):
        return Keys(SetPack(row["body"]), percent).entries(buckets).letters()

    return send


def _prefixes(percent: int, buckets: int):
    """The rows of keys that more than one part has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                p = SetPack(row["body"])
                keys = Keys(p, percent)
                told = L.joined(row["replies"])[keys.entries(buckets).place]
                use = np.flatnonzero(told != OWN)
                o = keys.owner[use]
                columns = [keys.key[use].view(np.int64), p.rep[o], p.part[o], p.n[o], p.across[o], p.more[o], keys.place[use]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(keys.side[use].astype(np.int32)), pa.array(told[use] == MAIN)], PREFIX_COLUMNS)

    return run


PREFIX_COLUMNS = ["name", "rep", "part", "n", "across", "more", "place", "side", "main"]


def _second_hubs(border: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y): y is, of the sets that lead the border sets with one of x's commonest names, the one most of those names lead to, if it's in another part.

    The set that has most of its names in other parts leads: the text that others were made from, rather than one of
    them. Sets that are alike with it, but not with the hub they were held against first, so join its part at once.
    """
    held = border.select("rep", "part", F.floor(1000 * F.col("across") / F.col("n")).alias("score"), F.explode("common").alias("name"))
    lead = held.groupBy("name").agg(F.max(F.struct("score", (-F.col("rep")).alias("back"), "part")).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    lead = scratch.written(lead.select("name", (-F.col("lead.back")).alias("hub"), F.col("lead.part").alias("hub_part")), "second_hubs")
    seen = held.join(lead, "name").filter("part <> hub_part").groupBy("rep", "hub").count()
    best = seen.groupBy("rep").agg(F.max(F.struct("count", (-F.col("hub")).alias("back"))).alias("best"))
    return best.select(F.col("rep").alias("x"), (-F.col("best.back")).alias("y"))


def _further_hubs(border: DataFrame, number: int) -> DataFrame:
    """(x, y): y is, of the sets that lead border sets with a name of x's prefix and are in another part, the one that most of those names lead to.

    A name is led by the set whose hash for this round is least, so that each round has other hubs: sets that are alike
    with some of a part, but not with the hubs they were held against before, join it one after the other.
    """
    held = border.select("rep", "part", F.explode("names").alias("name"))
    lead = held.groupBy("name").agg(F.min(F.struct(F.xxhash64(F.lit(number), "rep").alias("order"), F.col("rep").alias("hub"), F.col("part").alias("hub_part"))).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    seen = held.join(lead.select("name", "lead.hub", "lead.hub_part"), "name").filter("part <> hub_part").groupBy("rep", "hub").count()
    best = seen.groupBy("rep").agg(F.max(F.struct("count", (-F.col("hub")).alias("back"))).alias("best"))
    return best.select(F.col("rep").alias("x"), (-F.col("best.back")).alias("y"))


def _replaced(border: DataFrame, links: DataFrame) -> DataFrame:
    """border with the components of links as parts."""
    parts = components(links)
    return border.drop("part").join(parts, border["rep"] == parts["id"], "left").withColumn("part", F.coalesce("component", "rep")).drop("id", "component")


def _across(sets: DataFrame, links: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The pairs (x, y) of sets in different parts that may link, all of them, by prefixes; and the links between parts found on the way.

    The parts are the components of links, and of those with second and further hubs for the sets at the border of parts. Of a pair, x is the smaller, and the lower level's matches are asked. A key's main part, the one that has it most
    often, isn't held against itself: its sets meet only those of other parts.
    """
    parts = components(links)
    placed = sets.join(parts, sets["rep"] == parts["id"], "left").select("rep", F.coalesce("component", "rep").alias("part"), "names")
    packs = scratch.written(placed.mapInArrow(_set_packs, "pack_id long, body binary"), "set_packs", compression="none")
    buckets = L.bucket_count(packs.sparkSession)
    replies = L.exchange(packs, _parts_question(buckets), _ranks, buckets)
    shape = "rep long, part long, n long, across long, more long, common array<bigint>, names array<bigint>"
    border = scratch.written(L.asked(packs, replies, "replies").mapInArrow(_border(percent, buckets), shape), "border")
    found = scratch.written(_verified(_second_hubs(border, scratch), sets, percent), "second_links")
    border = _replaced(border.drop("common"), links.unionByName(found))
    for number in range(ROUNDS):
        border = scratch.written(border, "placed")
        more = scratch.written(_verified(_further_hubs(border, number), sets, percent), "further_links")
        if more.isEmpty():
            break
        found = found.unionByName(more)
        border = _replaced(border, links.unionByName(found))
    border = scratch.written(border.mapInArrow(_set_packs, "pack_id long, body binary"), "border_packs", compression="none")
    replies = L.exchange(border, _keys_question(percent, buckets), _mains, buckets)
    some = L.asked(border, replies, "replies").mapInArrow(_prefixes(percent, buckets), "name long, rep long, part long, n long, across long, more long, place long, side int, main boolean")
    some = scratch.written(some, "prefixes")
    side = lambda s, d, meets: d.select("name", meets.alias("meets"), *[F.col(c).alias(f"{s}_{c}") for c in PREFIX_COLUMNS[1:]])
    x = side("x", some.filter(F.col("side") != FOLLOWS), F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    y = side("y", some.filter(F.col("side") != LEADS), F.col("main"))
    ordered = F.when(F.col("x_side") == EQUAL, F.col("x_rep") < F.col("y_rep")).otherwise(F.col("x_n") < F.col("y_n"))
    share = F.expr(f"({percent} * (x_n + y_n) + {99 + percent}) div {100 + percent}")  # names that the two must have in common
    inside = lambda s: F.col(f"{s}_place") <= F.col(f"{s}_across") + F.col(f"{s}_more") - share
    may = ordered & (F.col("x_part") != F.col("y_part")) & (100 * F.col("x_n") >= percent * F.col("y_n")) & (F.least("x_across", "y_across") >= share) & inside("x") & inside("y")
    pairs = x.join(y, ["name", "meets"]).filter(may).groupBy("x_rep", "y_rep", "x_more", "y_more").count()
    return pairs.filter(F.col("count") > F.least("x_more", "y_more")).select(F.col("x_rep").alias("x"), F.col("y_rep").alias("y")), found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest id that links reach, itself included.

    Texts (A-Z lower-cased) link when their sets of word n-grams have a Jaccard similarity of percent hundredths or
    more. A text of fewer words has its whole sequence as its one n-gram; a null or empty one has no set and no link. Ids
    are whole numbers; a null id ranks behind all others. Rows with one id are one document: their links are shared.
    Columns other than the two named are not looked at; an empty table gives an empty result.

    1. Every set's names are in hash order, and the prefix in which a partner must share FIRST_CUT hundredths of its size
       is asked about: sets with too few shared names have no partner. Equal sets get one representative.
    2. Each representative left is held against one other, its hub; links are put together to components. Sets that may
       still have a partner elsewhere are held against a second hub, then against others as long as that links any.
    3. For sets in different components all pairs that adaptive prefixes allow are verified, in an order of names from
       rare to frequent. So no link is lost, and a group of very many near copies isn't expanded into its pairs.
    """
    scratch = Scratch(docs.sparkSession)
    packs = L.packs_of(docs, id_col, text_col, scratch)
    buckets = L.bucket_count(packs.sparkSession)
    replies = L.exchange(packs, _question(words, percent, buckets), _answer(buckets), buckets)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = L.asked(packs, replies, "replies").mapInArrow(_heard(words, percent, buckets), f"doc_id {kind}, n long, rep long, score long, names array<bigint>")
    rows = scratch.written(rows, "sets")
    sets = rows.filter("names IS NOT NULL").select("rep", "score", "names")
    links = scratch.written(_verified(_hubs(sets, scratch), sets, percent), "hub_links")
    pairs, found = _across(sets, links, percent, scratch)
    more = scratch.written(_verified(pairs, sets, percent), "more_links")
    parts = components(links.unionByName(found).unionByName(more))
    component = F.coalesce("component", "rep")
    out = rows.drop("names").join(parts, F.col("rep") == F.col("id"), "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(component != NO_ID, component).alias("component_id")), "near_copies")
    scratch.remove()
    return out
