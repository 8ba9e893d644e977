"""Near copies among vectors: inverted lists, residual codes by subspace, table-lookup distances, then the exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, written
from tidemark.llm.components import components
from tidemark.llm.whitening import common_size, matrix, usable

#: Codewords of a subspace.
WORDS = 16
#: Rows of a tile's two sides, on average at most; numbers held at once inside it.
TILE, HELD = 4096, 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first by their largest entry, so that tiny and huge ones keep their direction."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = np.einsum("ij,ij->i", centres, centres) / 2
    step = max(1, 4 * HELD // len(centres))
    return np.concatenate([(half - x[lo : lo + step] @ centres.T).argmin(axis=1) for lo in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centres; a centre that loses all its points keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))
        centres[own[order][starts]] = np.add.reduceat(x[order], starts) / n[n > 0][:, None]
    return centres


class Index:
    """Coarse centres and codebooks of residuals, fitted on a sample."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, threshold: float, margin: float):
        sample = unit(sample)
        self.d = sample.shape[1]
        self.centres = k_means(sample, lists)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = [c for c in np.array_split(np.arange(self.d), min(subspaces, self.d)) if len(c)]
        self.books = [k_means(residual[:, c], WORDS) for c in self.cuts]
        #: The distance between unit vectors at the threshold, and by how much of it a partner may lie over a list's border.
        self.reach = math.sqrt(2 - 2 * threshold)
        self.slack = margin * self.reach / math.sqrt(self.d)
        norms = np.einsum("ij,ij->i", self.centres, self.centres)
        self.norms = norms
        self.apart = np.sqrt(np.maximum(0, norms[:, None] + norms - 2 * self.centres @ self.centres.T)).astype(np.float32)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each row its own list, and all to probe: those whose border with the own list is within slack of it."""
        home, probes = np.empty(len(x), np.int32), []
        step = max(1, HELD // len(self.centres))
        for lo in range(0, len(x), step):
            gap = self.norms - 2 * x[lo : lo + step] @ self.centres.T
            own = gap.argmin(axis=1)
            home[lo : lo + step] = own
            gap -= gap[np.arange(len(own)), own][:, None]
            near = gap <= 2 * self.slack * self.apart[own]
            near[np.arange(len(own)), own] = True
            probes += [np.flatnonzero(r).astype(np.int32) for r in near]
        return home, probes

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte per row and subspace, and how far the coded vector is from the row."""
        residual = x - self.centres[home]
        codes = np.stack([_nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            residual[:, c] -= b[codes[:, k]]
        return codes, np.sqrt(np.einsum("ij,ij->i", residual, residual))

    def distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of rows x to the coded vectors of a list: a table per row and subspace, looked up by code."""
        residual = (x - self.centres[home]).astype(np.float32)
        out = np.zeros((len(x), len(codes)), np.float32)
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            r, b = residual[:, c], b.astype(np.float32)
            table = np.einsum("ij,ij->i", r, r)[:, None] - 2 * r @ b.T + np.einsum("ij,ij->i", b, b)
            out += table[:, codes[:, k]]
        return out


def _coded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("v"), index.d))
            home, probes = index.lists(x)
            codes, off = index.codes(x, home)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("copies"), batch.column("v"), pa.array(home), pa.array(probes, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], ["k", "copies", "v", "home", "probes", "code", "off"])

    return run


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's least fellow so far) after links a - b."""
    a, b = label[a], label[b]
    while (a != b).any():
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label, a, b = parent[label], parent[a], parent[b]
    return label


def _tile(model, threshold: float):
    def run(key: tuple, members: pa.Table, visitors: pa.Table) -> pa.Table:
        index, home = model.value, key[0].as_py()
        out = {"k": [], "links": [], "root": []}
        if members.num_rows and visitors.num_rows:
            km, kv = (t.column("k").to_numpy() for t in (members, visitors))
            raw_m, raw_v = (matrix(t.column("v").combine_chunks(), index.d) for t in (members, visitors))
            unit_v = unit(raw_v)
            exact_m, exact_v = unit(raw_m), unit_v
            codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(km), -1)
            bound = ((index.reach + members.column("off").to_numpy()) ** 2 + 1e-4).astype(np.float32)
            from_ = visitors.column("home").to_numpy()
            copies_m, copies_v = (t.column("copies").to_numpy() for t in (members, visitors))
            probed = members.column("probes").combine_chunks()
            owner = np.repeat(np.arange(len(km)), np.diff(probed.offsets.to_numpy()))
            also = np.zeros((len(km), len(index.centres)), bool) if len(km) * len(index.centres) <= 64 * HELD else None
            pairs = np.sort(owner.astype(np.int64) * len(index.centres) + probed.flatten().to_numpy())
            if also is not None:
                also.ravel()[pairs] = True
            nodes = np.unique(np.concatenate([km, kv]))
            at_m, at_v = np.searchsorted(nodes, km), np.searchsorted(nodes, kv)
            label, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
            step = max(1, HELD // len(km))
            for lo in range(0, len(kv), step):
                near = index.distances(unit_v[lo : lo + step], home, codes) <= bound
                i, j = np.nonzero(near)
                i += lo
                # a pair that both lists would find counts in the list of the smaller number, and inside a list once
                own = from_[i] == home
                if also is not None:
                    back = also[j, from_[i]]
                else:
                    want = j.astype(np.int64) * len(index.centres) + from_[i]
                    slot = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
                    back = pairs[slot] == want
                stay = np.where(own, kv[i] < km[j], ~(back & (from_[i] < home)))
                i, j = i[stay], j[stay]
                for a in range(0, len(i), HELD // 16):
                    x, y = i[a : a + HELD // 16], j[a : a + HELD // 16]
                    good = np.einsum("ij,ij->i", exact_v[x], exact_m[y]) >= threshold
                    x, y = x[good], y[good]
                    np.add.at(links, at_v[x], copies_m[y])
                    np.add.at(links, at_m[y], copies_v[x])
                    label = joined(label, at_v[x], at_m[y])
            found = np.flatnonzero(links)
            out = {"k": nodes[found], "links": links[found], "root": nodes[label[found]]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, margin: float = 2.0, per_list: int = 64, subspaces: int = 16, sample_values: int = 1 << 24) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row: how many others link with it, the smallest id that links reach, whether that is its own.

    Equal vectors are one entry with a number of copies. There is a list for every per_list entries, as long as a sample
    of 16 entries a list has at most sample_values numbers: centres and codebooks are fitted on that many, chosen by
    hash, and every entry is then coded. An entry probes all lists whose border with its own list is within margin
    standard deviations of where a partner at the threshold lies (a partner's offset is spread over all directions), so
    the number of probes follows the data and has no cap; a pair is found if either end probes the other's list. Distances by
    lookup rule out what is farther than the threshold allows together with the entry's own coding error, so they lose
    nothing; what is left has its exact cosine in double precision. Lists are cut into tiles of some TILE entries
    a side, each a group of its own; a tile gives counts and the components inside it, never its pairs.

    Vectors that are null, zero, of unusual size, or hold null or non-finite entries, and rows without an id, link with nothing: they are
    their own component. Rows that repeat an id count as other vectors each. An empty table gives an empty result; other
    columns are not looked at.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    d = common_size(rows, "v")
    sound = usable(F.col("v"), d) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if d:
        scratch = Scratch(spark)
        entries = rows.filter(sound).groupBy("v").agg(F.min("vec_id").alias("first"), F.count("vec_id").alias("copies"))
        entries = scratch.written(entries.withColumn("k", F.monotonically_increasing_id()), "entries")
        found = _linked(entries, scratch, d, threshold, margin, per_list, subspaces, sample_values)
        entries = written(found.withColumn("h", F.xxhash64("v")), "linked")
        scratch.remove()
        with_class = rows.filter(sound).withColumn("h", F.xxhash64("v")).join(entries, ["h", "v"])
        alone = alone.unionByName(with_class.select("vec_id", "n_links", "component_id"))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(entries: DataFrame, scratch: Scratch, d: int, threshold: float, margin: float, per_list: int, subspaces: int, sample_values: int) -> DataFrame:
    """v, n_links, component_id of each entry."""
    spark = entries.sparkSession
    n = entries.count()
    lists = max(1, min(n // per_list, sample_values // (16 * d)))
    share = math.ceil(min(1.0, 16 * max(lists, WORDS) / max(n, 1)) * (1 << 30))
    sample = entries.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).orderBy("k").select("v").toArrow()
    if not sample.num_rows:
        sample = entries.select("v").limit(WORDS).toArrow()  # so few entries that the hash chose none: any will do
    if not sample.num_rows:
        return entries.select("v", F.lit(0).cast("long").alias("n_links"), F.col("first").alias("component_id"))
    model = spark.sparkContext.broadcast(Index(matrix(sample.column(0).combine_chunks(), d), lists, subspaces, threshold, margin))
    vector = entries.schema["v"].dataType.simpleString()
    coded = entries.select("k", "copies", "v").mapInArrow(_coded(model), f"k long, copies long, v {vector}, home int, probes array<int>, code binary, off double")
    coded = scratch.written(coded, "coded")
    visits = coded.select("k", "copies", "v", "home", F.explode("probes").alias("list"))
    # a row per list at most, and the lists are bounded by the sample
    blocks = lambda df, c, to: df.groupBy(F.col(c).alias("list")).agg(F.ceil(F.count("k") / TILE).cast("int").alias(to))
    sizes = F.broadcast(scratch.written(blocks(coded, "home", "mb").join(blocks(visits, "list", "vb"), "list"), "sizes"))
    part = lambda c: F.pmod(F.xxhash64("k"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = coded.withColumnRenamed("home", "list").join(sizes, "list").withColumn("m", part("mb")).withColumn("w", every("vb")).select("list", "m", "w", "k", "copies", "v", "probes", "code", "off")
    visitors = visits.join(sizes, "list").withColumn("w", part("vb")).withColumn("m", every("mb")).select("list", "m", "w", "k", "copies", "v", "home")
    tiles = members.groupBy("list", "m", "w").cogroup(visitors.toDF(*visitors.columns).groupBy("list", "m", "w")).applyInArrow(_tile(model, threshold), "k long, links long, root long")
    tiles = scratch.written(tiles, "tiles")
    links = tiles.groupBy("k").agg(F.sum("links").alias("links"))
    reached = components(tiles.select(F.col("k").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "k")
    least = reached.join(entries.select("k", "first"), "k").groupBy("component").agg(F.min("first").alias("least"))
    of = reached.join(least, "component").select("k", "least")
    out = entries.join(links, "k", "left").join(of, "k", "left")
    return out.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
