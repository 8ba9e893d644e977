"""Boosted trees by Newton steps: histograms of gradient and hessian as aggregates, with every model of a search in the same passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.landing import dropped_shuffles, landing_dir

#: Numbers (rows times models) that a task holds at once, and partial histograms that one group adds up.
HELD, FAN = 1 << 19, 64
#: Models whose sums are one row, and whose splits are chosen in one group.
TOGETHER = 16
#: Rounds after which the margins are stored; until then they are worked out from the trees since. With more than FEW models each round is.
STORED, FEW = 10, 16
#: With more passes than MANY and at most WHOLE cells, tasks hold all cells (some 30 bytes each) and train whole models, BLOCK cells at a time.
MANY, WHOLE, BLOCK = 16, 1 << 21, 1 << 16
#: The fold of a model that trains on all rows.
ALL = 1 << 30


@dataclass(frozen=True)
class Setting:
    """Depth of a tree, step (eta), penalties l2 (lambda) and l1 (alpha), least hessian of a child, rounds."""

    depth: int = 2
    step: float = 0.05
    l2: float = 5.0
    l1: float = 1.0
    rounds: int = 50
    least: float = 1.0


@dataclass
class Trees:
    """A round's tree of every model: by node the feature (-1: a leaf), the last bin that goes left, whether missing values do, gain and value."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, models: int, depth: int) -> Trees:
        inner, all_ = (models, 2**depth - 1), (models, 2 ** (depth + 1) - 1)
        return cls(np.full(inner, -1, np.int32), np.zeros(inner, np.int32), np.zeros(inner, bool), np.zeros(inner), np.zeros(all_))

    def nodes(self, bins: np.ndarray, missing: np.ndarray, levels: int) -> np.ndarray:
        """Of each row and model the node it has come to after some levels."""
        m, rows = np.arange(len(self.feature)), np.arange(len(bins))[:, None]
        node = np.zeros((len(bins), len(m)), np.int32)
        for _ in range(levels):
            at = np.minimum(node, self.feature.shape[1] - 1)
            f = np.where(node < self.feature.shape[1], self.feature[m, at], -1)
            b = bins[rows, f]
            left = np.where(b == missing[f], self.missing_left[m, at], b <= self.cut[m, at])
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        return node

    def told(self, bins: np.ndarray, missing: np.ndarray, depth: int) -> np.ndarray:
        return self.value[np.arange(len(self.value)), self.nodes(bins, missing, depth)]


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_splits(histograms: list[np.ndarray], s: Setting) -> list[dict]:
    """Of each node its best split. histograms: by feature an array (node, bin, 2) of sums of gradient and hessian, the missing values' bin last.

    A split's gain is T(G)**2 / (H + l2) of both sides less that of the node, T being the soft threshold at l1; both sides need
    the least hessian. Missing values go to the side that gains more. Of equal gains the first feature, then the first cut.
    """
    total = histograms[0].sum(axis=1)
    quality = lambda g, h: shrunk(g, s.l1) ** 2 / (h + s.l2)
    value = lambda g, h: -s.step * shrunk(g, s.l1) / (h + s.l2)
    before = quality(total[:, 0], total[:, 1])
    found = [{"feature": -1, "cut": 0, "missing_left": False, "gain": 1e-6, "value": float(v), "left": 0.0, "right": 0.0} for v in value(total[:, 0], total[:, 1])]
    for j, h in enumerate(histograms):
        left, lost = np.cumsum(h[:, :-1], axis=1), h[:, -1:]  # the last cut parts all values from the missing ones
        for missing_left in (False, True):
            if missing_left and not lost.any():
                continue
            a = left + lost * missing_left
            b = total[:, None] - a
            gain = quality(a[..., 0], a[..., 1]) + quality(b[..., 0], b[..., 1]) - before[:, None]
            enough = s.least * (1 - 1e-9)
            gain = np.where((a[..., 1] >= enough) & (b[..., 1] >= enough), gain, -np.inf)
            if not gain.shape[1]:
                continue
            # sums of other orders differ in their last digits: a later split has to be better by more
            most = np.maximum(gain.max(axis=1, keepdims=True), 0)
            for node, c in enumerate((gain >= most * (1 - 1e-9)).argmax(axis=1)):
                if gain[node, c] > found[node]["gain"] * (1 + 1e-9):
                    found[node] |= {"feature": j, "cut": int(c), "missing_left": missing_left, "gain": float(gain[node, c]), "left": float(value(*a[node, c])), "right": float(value(*b[node, c]))}
    return found


@dataclass
class Cells:
    """Rows with equal fold and bins as one cell, with their number and that of the positive ones; stored."""

    table: DataFrame
    cuts: list[np.ndarray]
    home: str
    number: int = 0
    names: list[str] = field(default_factory=list)
    parts: int = 1

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(c) for c in self.cuts], np.uint16)

    def store(self, table: DataFrame) -> None:
        """table as the cells from now on; what stood under the same home before is removed once it is written."""
        self.number += 1
        path = f"{self.home}/{self.number}"
        table.write.parquet(path)
        self.table = table.sparkSession.read.schema(table.schema).parquet(path)
        self.parts = self.table.rdd.getNumPartitions()
        self.remove(f"{self.home}/{self.number - 1}")

    def remove(self, path: str) -> None:
        at = self.table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def cut_points(rows: DataFrame, features: list[str], most: int = 256) -> list[np.ndarray]:
    """Of each feature the upper bounds of its bins: all its values where they are at most that many, else quantiles."""
    x = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    about = rows.agg(*[F.approx_count_distinct(v, 0.02).alias(f) for f, v in x.items()]).first()
    few = [f for f in features if about[f] <= most * 1.2]
    grid = [(i + 1) / most for i in range(most)]
    got = rows.agg(*[(F.collect_set(x[f]) if f in few else F.percentile_approx(x[f], grid, 100 * most)).alias(f) for f in features]).first()
    out = []
    for f in features:
        values = np.unique(np.array(got[f] or [], np.float64))
        out.append(values if len(values) <= most else values[np.unique(np.linspace(0, len(values) - 1, most).round().astype(int))])
    return out


def cells(rows: DataFrame, features: list[str], label: str, fold: str | None = "fold", most: int = 256) -> Cells:
    """The rows by fold and bins; a row whose label is null has no part, a null or NaN feature is missing. Without fold all rows are of fold 0."""
    number = F.col(fold).cast("int") if fold else F.lit(0)
    rows = rows.filter(F.col(label).isNotNull()).select(number.alias("fold"), F.col(label).cast("boolean").cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)])
    names = [f"x{j}" for j in range(len(features))]
    cuts = cut_points(rows, names, most)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, len(cuts)), np.uint16)
            for j, c in enumerate(cuts):
                v = batch.column(j + 2).to_numpy(zero_copy_only=False).astype(np.float64)
                out[:, j] = np.where(np.isnan(v), len(c), np.minimum(np.searchsorted(c, v), max(len(c) - 1, 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in out], pa.binary())], ["fold", "y", "cell"])

    found = rows.mapInArrow(binned, "fold int, y int, cell binary").groupBy("fold", "cell").agg(F.count("y").alias("n"), F.sum("y").alias("pos"))
    out = Cells(found, cuts, landing_dir(rows.sparkSession, "cells"), names=list(features))
    out.store(found.withColumn("margins", F.lit(None).cast("binary")))
    return out


@dataclass
class Shared:
    """What every task of a pass needs."""

    models: list[tuple[Setting, int]]
    missing: np.ndarray
    recent: list[Trees]
    current: Trees | None
    depth: int

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """fold, bins, n, pos and the margins of every model, those of recent rounds included."""
        fold, n, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "n", "pos"))
        bins = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint16).reshape(len(fold), -1)
        stored = [x for x in batch.column("margins").to_pylist() if x is not None]
        margins = np.frombuffer(b"".join(stored), np.float64).reshape(len(fold), -1).copy() if stored else np.zeros((len(fold), len(self.models)))
        for t in self.recent:
            margins += t.told(bins, self.missing, self.depth)
        return fold, bins, n, pos, margins


def _slices(batches: Iterator[pa.RecordBatch], models: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, step := max(1, HELD // models)):
            yield batch.slice(lo, step)


def _histograms(shared, level: int, active: np.ndarray):
    """Per partition and TOGETHER of the active models: of each its sums of gradient and hessian by feature, node of the level and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s: Shared = shared.value
        until = np.array([f for _, f in s.models])[active]
        width, size = 2**level, s.missing.astype(np.int64) + 1
        sums = [np.zeros((len(active) * width * b, 2)) for b in size]
        seen = False
        for batch in _slices(batches, len(s.models)):
            seen = True
            fold, bins, n, pos, margins = s.read(batch)
            node = s.current.nodes(bins, s.missing, level)[:, active] - (width - 1)
            p = 1 / (1 + np.exp(-margins[:, active]))
            on = (fold[:, None] < until) & (node >= 0)
            g, h = ((x * on).ravel() for x in (n[:, None] * p - pos[:, None], n[:, None] * p * (1 - p)))
            place = np.arange(len(active)) * width + np.maximum(node, 0)
            for j, b in enumerate(size):
                at = (place * b + bins[:, j : j + 1]).ravel()
                sums[j][:, 0] += np.bincount(at, g, len(sums[j]))
                sums[j][:, 1] += np.bincount(at, h, len(sums[j]))
        if seen:
            each = [b"".join(x.reshape(len(active), -1)[k].tobytes() for x in sums) for k in range(len(active))]
            rows = [b"".join(each[k : k + TOGETHER]) for k in range(0, len(each), TOGETHER)]
            part = np.full(len(rows), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(part.astype(np.int64)), pa.array(rows, pa.binary())], ["model", "part", "sums"])

    return run


def _total(table: pa.Table) -> np.ndarray:
    """The sum of the partial histograms, in the order of their parts: the same on every run."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    values = table.column("sums").combine_chunks()
    total = 0
    for k in order.tolist():
        total = total + np.frombuffer(values[k].as_buffer(), np.float64)
    return total


def _added(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"model": [key[0].as_py()], "part": [key[1].as_py()], "sums": pa.array([_total(table).tobytes()], pa.binary())})


SPLIT = "model long, node long, feature long, cut long, missing_left boolean, gain double, value double, left double, right double"


def _chosen(shared, level: int, active: np.ndarray):
    """Of some models' partial histograms the best split of each node: a row per model and node, whatever the number of rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        s: Shared = shared.value
        first, total, lo = key[0].as_py() * TOGETHER, _total(table), 0
        out: dict[str, list] = {c: [] for c in ("model", "node", "feature", "cut", "missing_left", "gain", "value", "left", "right")}
        for model in active[first : first + TOGETHER].tolist():
            histograms = []
            for b in s.missing.astype(np.int64) + 1:
                n = 2**level * b * 2
                histograms.append(total[lo : lo + n].reshape(2**level, b, 2))
                lo += n
            for node, f in enumerate(best_splits(histograms, s.models[model][0])):
                for c, v in {"model": model, "node": node, **f}.items():
                    out[c].append(v)
        return pa.table(out)

    return run


def _updated(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Shared = shared.value
        for batch in _slices(batches, len(s.models)):
            *_, margins = s.read(batch)
            columns = [batch.column(c) for c in ("fold", "cell", "n", "pos")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in margins], pa.binary())], ["fold", "cell", "n", "pos", "margins"])

    return run


def _tested(shared):
    """Per partition and model: rows of its test fold, and how many of them it tells right (margin over 0: positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Shared = shared.value
        until = np.array([f for _, f in s.models])
        n_all, right = np.zeros(len(until), np.int64), np.zeros(len(until), np.int64)
        for batch in _slices(batches, len(until)):
            fold, _, n, pos, margins = s.read(batch)
            own = fold[:, None] == until
            n_all += (n[:, None] * own).sum(axis=0)
            right += (np.where(margins > 0, pos[:, None], (n - pos)[:, None]) * own).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(until))), pa.array(n_all), pa.array(right)], ["model", "n", "right"])

    return run


@dataclass
class Boosted:
    models: list[tuple[Setting, int]]
    names: list[str]
    rounds: list[Trees]
    #: By round asked for: the rows of each model's test fold and those told right.
    tested: dict[int, list[tuple[int, int]]]

    def importance(self, model: int = 0) -> dict[str, tuple[float, int]]:
        """Of each feature that a split uses: the mean gain of its splits, and how many there are."""
        gain, count = np.zeros(len(self.names)), np.zeros(len(self.names), np.int64)
        for t in self.rounds:
            used = t.feature[model] >= 0
            np.add.at(gain, t.feature[model][used], t.gain[model][used])
            np.add.at(count, t.feature[model][used], 1)
        return {f: (float(gain[j] / count[j]), int(count[j])) for j, f in enumerate(self.names) if count[j]}


def _assign(trees: Trees, m: int, level: int, node: int, r: dict) -> None:
    """The split of a node of a level in the tree of model m."""
    at = 2**level - 1 + node
    if not level:
        trees.value[m, 0] = r["value"]
    elif trees.feature[m, (at - 1) // 2] < 0:
        return
    if r["feature"] >= 0:
        trees.feature[m, at], trees.cut[m, at], trees.missing_left[m, at], trees.gain[m, at] = r["feature"], r["cut"], r["missing_left"], r["gain"]
        trees.value[m, 2 * at + 1], trees.value[m, 2 * at + 2] = r["left"], r["right"]


@dataclass
class Held:
    """All cells in order of fold and bins, as arrays."""

    fold: np.ndarray
    bins: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    missing: np.ndarray

    @classmethod
    def of(cls, data: Cells) -> Held:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold, n, pos = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("fold", "n", "pos"))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (fold, n, pos, b"".join(batch.column("cell").to_pylist()))], ["fold", "n", "pos", "cell"])

        rows = data.table.mapInArrow(packed, "fold binary, n binary, pos binary, cell binary").toArrow()
        fold, n, pos = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("fold", "n", "pos"))
        bins = np.frombuffer(b"".join(rows.column("cell").to_pylist()), np.uint16).reshape(len(fold), len(data.cuts))
        order = np.lexsort((*bins.T[::-1], fold))
        return cls(fold[order].astype(np.int32), bins[order], n[order].astype(np.float64), pos[order].astype(np.float64), data.missing)

    def trained(self, s: Setting, until: int, last: int, test_at: tuple[int, ...]) -> tuple[list[Trees], list[tuple[int, int]]]:
        """The trees of a model, and of each round of test_at the rows of its test fold and those told right."""
        train, end = np.searchsorted(self.fold, until), np.searchsorted(self.fold, until, "right")
        blocks = [(lo, min(lo + BLOCK, end), min(max(train - lo, 0), BLOCK)) for lo in range(0, end, BLOCK)]
        bins, size = np.ascontiguousarray(self.bins[:end]), self.missing.astype(np.int64) + 1
        columns = [bins[:, j].astype(np.int64) for j in range(len(size))]
        margins, g, h, node = np.zeros(end), np.zeros(train), np.zeros(train), np.zeros(end, np.int64)
        place, most = np.arange(BLOCK) * len(size), int(size.max(initial=1))
        rounds, tested = [], []
        for number in range(1, last + 1):
            trees = Trees.of(1, s.depth)
            inner = len(trees.feature[0])
            node[:] = 0
            for level in range(s.depth if number <= s.rounds else 0):
                width = 2**level
                if level and (trees.feature[0, (width - 2) // 2 : width - 1] < 0).all():
                    break
                sums = [np.zeros((2, width * b)) for b in size]
                for lo, _, used in blocks:
                    at = slice(lo, lo + used)
                    if not used:
                        break
                    if not level:
                        p = 1 / (1 + np.exp(-margins[at]))
                        g[at], h[at] = self.n[at] * p - self.pos[at], self.n[at] * p * (1 - p)
                    k, u, v = node[at] - (width - 1), g[at], h[at]
                    if level and (k < 0).any():
                        on = np.flatnonzero(k >= 0)
                        k, u, v = k[on], u[on], v[on]
                    else:
                        on = slice(None)
                    for j, b in enumerate(size):
                        cell = k * b + columns[j][at][on]
                        sums[j][0] += np.bincount(cell, u, width * b)
                        sums[j][1] += np.bincount(cell, v, width * b)
                for k, r in enumerate(best_splits([x.reshape(2, width, -1).transpose(1, 2, 0) for x in sums], s)):
                    _assign(trees, 0, level, k, r)
                feature = np.concatenate([trees.feature[0], np.full(inner + 1, -1, np.int32)]).astype(np.int64)
                left = np.zeros((len(feature), most), bool)
                for k in range(width - 1, 2 * width - 1):
                    if feature[k] >= 0:
                        left[k] = np.arange(most) <= trees.cut[0, k]
                        left[k, self.missing[feature[k]]] = trees.missing_left[0, k]
                for lo, hi, _ in blocks:
                    k = node[lo:hi]
                    f = feature[k]
                    b = bins[lo:hi].reshape(-1)[place[: hi - lo] + np.maximum(f, 0)]
                    # a node of an earlier level that has split has no rows left, one that hasn't keeps its rows
                    node[lo:hi] = np.where(f >= 0, 2 * k + 2 - left.reshape(-1)[k * most + b], k)
            if number <= s.rounds:
                margins += trees.value[0][node]
            rounds.append(trees)
            if number in test_at:
                n, pos = self.n[train:end], self.pos[train:end]
                tested.append((int(n.sum()), int(np.where(margins[train:end] > 0, pos, n - pos).sum())))
        return rounds, tested


#: What a task tells of a model: the arrays of its trees, one after the other, and its tests.
PARTS = {"feature": np.int32, "cut": np.int32, "missing_left": bool, "gain": np.float64, "value": np.float64}


def _whole(data: Cells, models: list[tuple[Setting, int]], test_at: tuple[int, ...]) -> Boosted:
    """Each model in a task of its own, which holds all cells."""
    spark, last = data.table.sparkSession, max(s.rounds for s, _ in models)
    at = tuple(sorted({t for t in test_at if t <= last}))
    held = spark.sparkContext.broadcast(Held.of(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column(0).to_pylist():
                rounds, tested = held.value.trained(*models[m], last, at)
                trees = [pa.array([b"".join(getattr(t, c).tobytes() for t in rounds)], pa.binary()) for c in PARTS]
                yield pa.RecordBatch.from_arrays([pa.array([m]), *trees, pa.array([[x for pair in tested for x in pair]], pa.list_(pa.int64()))], ["model", *PARTS, "tested"])

    depth = max(s.depth for s, _ in models)
    rounds = [Trees.of(len(models), depth) for _ in range(last)]
    tested = {t: [(0, 0)] * len(models) for t in at}
    told = spark.range(0, len(models), 1, len(models)).mapInArrow(run, "model long, " + ", ".join(f"{c} binary" for c in PARTS) + ", tested array<long>")
    for r in told.toArrow().to_pylist():
        for c, kind in PARTS.items():
            each = np.frombuffer(r[c], kind).reshape(last, -1)
            for t, x in zip(rounds, each, strict=True):
                getattr(t, c)[r["model"], : len(x)] = x
        for t, pair in zip(at, zip(r["tested"][::2], r["tested"][1::2], strict=True), strict=True):
            tested[t][r["model"]] = pair
    held.destroy()
    return Boosted(models, data.names, rounds, tested)


def _boost(data: Cells, models: list[tuple[Setting, int]], test_at: tuple[int, ...]) -> Boosted:
    spark = data.table.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-data.table.count() * len(models) // (HELD // 4)))
    if parts > data.parts:  # cells are few where rows are alike, but each has a margin for every model
        data.store(data.table.repartition(parts, "fold", "cell"))
    every = STORED if len(models) <= FEW else 1
    depth, last = max(s.depth for s, _ in models), max(s.rounds for s, _ in models)
    rounds: list[Trees] = []
    recent: list[Trees] = []
    tested = {}
    held = []

    def shared(current: Trees | None):
        held.append(spark.sparkContext.broadcast(Shared(models, data.missing, list(recent), current, depth)))
        return held[-1]

    for number in range(1, last + 1):
        trees = Trees.of(len(models), depth)
        going = np.array([s.rounds >= number for s, _ in models])
        for level in range(depth):
            opened = slice(2**level - 1, 2 ** (level + 1) - 1)
            grown = (trees.feature[:, (opened.start - 1) // 2 : opened.start] >= 0).any(axis=1) if level else going
            active = np.flatnonzero(going & grown & np.array([s.depth > level for s, _ in models]))
            if not len(active):
                break
            now = shared(trees)
            parts = data.table.mapInArrow(_histograms(now, level, active), "model long, part long, sums binary")
            left = data.parts
            while left > FAN:
                left = -(-left // FAN)
                parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("model", "part").applyInArrow(_added, parts.schema)
            for r in parts.groupBy("model").applyInArrow(_chosen(now, level, active), SPLIT).toArrow().to_pylist():
                _assign(trees, r["model"], level, r["node"], r)
        rounds.append(trees)
        recent.append(trees)
        if number in test_at:
            sums = data.table.mapInArrow(_tested(shared(None)), "model long, n long, right long").groupBy("model").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
            got = {r["model"]: (r["n"], r["right"]) for r in sums.collect()}
            tested[number] = [got.get(m, (0, 0)) for m in range(len(models))]
        if len(recent) >= every and number < last:
            data.store(data.table.mapInArrow(_updated(shared(None)), data.table.schema))
            recent.clear()
            for b in held:
                b.unpersist()
            held.clear()
    return Boosted(models, data.names, rounds, tested)


def boost(data: Cells, models: list[tuple[Setting, int]], test_at: tuple[int, ...] = ()) -> Boosted:
    """Trains every (setting, fold) model on the rows of earlier folds (ALL: on all rows), and tests it on its own fold after the rounds asked for.

    A pass reads the cells once for all models: each task sums gradient and hessian by model, node, feature and bin,
    groups of at most FAN partial sums are added, and each model's total chooses its splits in a task of its own. The driver gets a
    row per model and node. Passes are as many as the deepest setting has levels, times the rounds; sizes of sums follow
    models, nodes and bins, not rows. The margin of a row starts at 0 (a probability of one half).

    On disk are the margins of two rounds at most, and the shuffle of one pass. Where passes are many and all cells fit in a task
    (at most WHOLE of them), each model is trained in a task of its own instead, with no pass, margin or shuffle.
    """
    if max(s.depth for s, _ in models) * max(s.rounds for s, _ in models) > MANY and data.table.limit(WHOLE + 1).count() <= WHOLE:
        return _whole(data, models, test_at)
    data = replace(data, home=landing_dir(data.table.sparkSession, "margins"), number=0)
    try:
        with dropped_shuffles(data.table.sparkSession):
            return _boost(data, models, test_at)
    finally:
        data.remove(data.home)


def walk_forward(rows: DataFrame, features: list[str], label: str, k: int = 3, setting: Setting = Setting()) -> DataFrame:  # noqa: B008
    """fold, n, accuracy: a model for each fold from 1 to k, trained on all earlier rows and tested on that fold. rows have fold (see stats.folds)."""
    told = boost(cells(rows, features, label), [(setting, f) for f in range(1, k + 1)], (setting.rounds,)).tested[setting.rounds]
    found = [(f, n, right / n) for f, (n, right) in enumerate(told, 1) if n]
    return rows.sparkSession.createDataFrame(found, "fold int, n long, accuracy double")


def importance(rows: DataFrame, features: list[str], label: str, setting: Setting = Setting()) -> DataFrame:  # noqa: B008
    """feature, gain, splits: the mean gain of a feature's splits over all rounds; a feature that no split uses has no row."""
    told = boost(cells(rows, features, label, fold=None), [(setting, ALL)]).importance()
    return rows.sparkSession.createDataFrame([(f, g, n) for f, (g, n) in told.items()], "feature string, gain double, splits long")


#: The settings of the search.
DEPTHS, STEPS, L2, L1, ROUNDS = (2, 3, 4), (0.01, 0.05, 0.1, 0.2), (0.1, 1.0, 5.0), (0.0, 0.1, 1.0), (30, 50, 100)


def grid_search(rows: DataFrame, features: list[str], label: str, depths=DEPTHS, steps=STEPS, l2=L2, l1=L1, rounds=ROUNDS, k: int = 3) -> DataFrame:
    """depth, step, l2, l1, rounds, accuracy of each setting: the mean accuracy of its walk-forward folds.

    Settings that differ in their rounds alone are one model, tested on the way; all models and folds go through the
    same passes.
    """
    settings = [Setting(d, s, a, b, max(rounds)) for d in depths for s in steps for a in l2 for b in l1]
    done = boost(cells(rows, features, label), [(s, f) for s in settings for f in range(1, k + 1)], tuple(rounds))
    found = []
    for r in rounds:
        told = done.tested[r]
        for i, s in enumerate(settings):
            own = [right / n for n, right in told[i * k : (i + 1) * k] if n]
            found.append((s.depth, s.step, s.l2, s.l1, r, sum(own) / len(own) if own else None))
    return rows.sparkSession.createDataFrame(found, "depth int, step double, l2 double, l1 double, rounds int, accuracy double")


def first_gains(rows: DataFrame, features: list[str], label: str, setting: Setting = Setting()) -> DataFrame:  # noqa: B008
    """feature, cut, gain: what each split of the first round's root gains, by windows over the sums of each value; null features go right.

    In the first round each row's gradient is one half less its label and its hessian one quarter, so counts say it all.
    """
    y = F.col(label).cast("boolean").cast("int")
    long_ = rows.filter(F.col(label).isNotNull()).select(y.alias("y"), F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "cut"))
    by = long_.groupBy("feature", "cut").agg((F.count("y") * 0.5 - F.sum("y")).alias("g"), (F.count("y") * 0.25).alias("h"))
    from pyspark.sql import Window

    upto, whole = Window.partitionBy("feature").orderBy("cut"), Window.partitionBy("feature")
    quality = lambda g, h: F.pow(F.greatest(F.abs(g) - setting.l1, F.lit(0.0)), 2) / (h + setting.l2)
    seen = F.col("cut").isNotNull()
    sums = by.select("feature", "cut", *[f(F.col(c)).over(w).alias(f"{c}{k}") for c in "gh" for k, w, f in ((0, whole, F.sum), (1, upto, lambda x: F.sum(F.when(seen, x))))]).filter(seen)
    rest = {c: F.col(f"{c}0") - F.col(f"{c}1") for c in "gh"}
    gain = quality(F.col("g1"), F.col("h1")) + quality(rest["g"], rest["h"]) - quality(F.col("g0"), F.col("h0"))
    return sums.filter((F.col("h1") >= setting.least) & (rest["h"] >= setting.least)).select("feature", "cut", gain.alias("gain"))
