"""Boosting by histogram aggregates against a booster over the rows themselves."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import boosting
from tidemark.operators.boosting import ALL, Setting


def gain_of(rows, s, j, cut, missing_left):
    """(gain, left rows, right rows) of a split of rows (x, g, h, ..); None if a side is too light."""
    left = [r for r in rows if (missing_left if r[0][j] is None else r[0][j] <= cut)]
    right = [r for r in rows if r not in left]
    total = lambda side: (sum(r[1] for r in side), sum(r[2] for r in side))

    def quality(side):
        g, h = total(side)
        return max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)

    if min(total(left)[1], total(right)[1]) < s.least * (1 - 1e-9):
        return None
    return quality(left) + quality(right) - quality(rows), left, right


def grow(rows, s, depth, splits):
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = -s.step * math.copysign(max(abs(g) - s.l1, 0), g) / (h + s.l2)
    best = None
    for j in range(len(rows[0][0]) if depth else 0):
        values = sorted({r[0][j] for r in rows if r[0][j] is not None})
        for missing_left in (False, True) if any(r[0][j] is None for r in rows) else (False,):
            for cut in values:
                found = gain_of(rows, s, j, cut, missing_left)
                if found and found[0] > 1e-6 and (best is None or found[0] > best[0] * (1 + 1e-9)):
                    best = (*found, j, cut, missing_left)
    if best is None:
        return lambda x: leaf
    gain, left, right, j, cut, missing_left = best
    splits.append((j, gain))
    a, b = grow(left, s, depth - 1, splits), grow(right, s, depth - 1, splits)
    return lambda x: a(x) if (missing_left if x[j] is None else x[j] <= cut) else b(x)


def brute(data, s, at):
    """margins after the rounds at, of each row, and the splits."""
    margins, splits, out = [0.0] * len(data), [], {}
    train = [k for k, r in enumerate(data) if r[3]]
    for number in range(1, s.rounds + 1):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        tree = grow([(data[k][0], p[k] - data[k][1], p[k] * (1 - p[k]), k) for k in train], s, s.depth, splits)
        margins = [m + tree(r[0]) for m, r in zip(margins, data)]
        if number in at:
            out[number] = list(margins)
    return out, splits


def table(n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(7), rng.choice([0.5, 1.5, 2.5, None]), rng.choice([None, 1.0, 2.0])
        rows.append((i, i * 4 // n, a, b, c, rng.random() < 0.2 + 0.08 * a + (0.2 if b is None else 0)))
    return rows


@pytest.mark.parametrize("s", [Setting(rounds=12), Setting(depth=3, step=0.2, l2=0.1, l1=0.0, rounds=12), Setting(depth=4, step=0.1, l2=1.0, l1=0.1, rounds=3)])
def test_boost(spark, s):
    data = table()
    frame = spark.createDataFrame(data, "id int, fold int, a int, b double, c double, y boolean").repartition(3)
    cells = boosting.cells(frame, ["a", "b", "c"], "y")
    done = boosting.boost(cells, [(s, 1), (s, 3), (s, ALL)], (2, s.rounds))
    for m, until in enumerate((1, 3, ALL)):
        out, splits = brute([((r[2], r[3], r[4]), r[5], r[0], r[1] < until) for r in data], s, (2, s.rounds))
        for number, margins in out.items():
            test = [k for k, r in enumerate(data) if r[1] == until]
            assert done.tested[number][m] == (len(test), sum((margins[k] > 0) == data[k][5] for k in test))
        want = {}
        for j, gain in splits:
            want.setdefault("abc"[j], []).append(gain)
        got = done.importance(m)
        assert set(got) == set(want)
        for f, gains in want.items():
            assert got[f][1] == len(gains) and got[f][0] == pytest.approx(sum(gains) / len(gains), rel=1e-6)


def test_partial_sums_and_search(spark, monkeypatch):
    monkeypatch.setattr(boosting, "FAN", 2)
    monkeypatch.setattr(boosting, "STORED", 2)
    data = table(120, 4)
    frame = spark.createDataFrame(data, "id int, fold int, a int, b double, c double, y boolean").repartition(7)
    found = {tuple(r)[:5]: r.accuracy for r in boosting.grid_search(frame, ["a", "b", "c"], "y", depths=(1, 3), steps=(0.2,), l2=(0.1, 5.0), l1=(0.0,), rounds=(2, 5)).collect()}
    assert len(found) == 8
    for (depth, step, l2, l1, rounds), accuracy in found.items():
        each = []
        for f in (1, 2, 3):
            out, _ = brute([((r[2], r[3], r[4]), r[5], r[0], r[1] < f) for r in data], Setting(depth, step, l2, l1, rounds), (rounds,))
            test = [k for k, r in enumerate(data) if r[1] == f]
            each.append(sum((out[rounds][k] > 0) == data[k][5] for k in test) / len(test))
        assert accuracy == pytest.approx(sum(each) / 3)


def test_first_gains(spark):
    data = table(90, 2)
    frame = spark.createDataFrame(data, "id int, fold int, a int, b double, c double, y boolean")
    s = Setting()
    rows = [((r[2], r[3], r[4]), 0.5 - r[5], 0.25, r[0]) for r in data]
    want = {}
    for j, f in enumerate("abc"):
        for cut in sorted({r[0][j] for r in rows if r[0][j] is not None}):
            if found := gain_of(rows, s, j, cut, False):
                want[(f, float(cut))] = found[0]
    got = {(r.feature, r.cut): r.gain for r in boosting.first_gains(frame, ["a", "b", "c"], "y").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_edges(spark):
    empty = spark.createDataFrame([], "fold int, a double, y boolean")
    assert boosting.walk_forward(empty, ["a"], "y").count() == 0 and boosting.importance(empty, ["a"], "y").count() == 0
    same = spark.createDataFrame([(i % 4, None, True) for i in range(40)] + [(0, 1.0, None)], "fold int, a double, y boolean")
    assert [tuple(r) for r in boosting.walk_forward(same, ["a"], "y", setting=Setting(rounds=2)).orderBy("fold").collect()] == [(f, 10, 1.0) for f in (1, 2, 3)]


def test_cut_points(spark):
    many = spark.range(5000).select(((__import__("pyspark.sql.functions").sql.functions.col("id") * 7919) % 5000).cast("double").alias("x"))
    cuts = boosting.cut_points(many, ["x"], 16)[0]
    assert len(cuts) <= 16 and cuts[-1] == 4999 and np.all(np.diff(cuts) > 0)


def test_margins_of_past_rounds_are_removed(spark, tmp_path, monkeypatch):
    """Of all rounds' margins one table at a time stands between passes, and none at the end."""
    import os

    from pyspark.sql import functions as F

    from tidemark.operators import boosting

    monkeypatch.setattr(boosting, "landing_dir", lambda _, what: f"{tmp_path}/{what}")
    seen, store = [], boosting.Cells.store

    def watched(self, table):
        store(self, table)
        if self.home.endswith("margins"):
            seen.append(len(os.listdir(f"{tmp_path}/margins")))

    monkeypatch.setattr(boosting.Cells, "store", watched)
    rows = spark.range(400).select((F.col("id") % 4).alias("fold"), (F.col("id") % 50).alias("x"), (F.col("id") % 3 == 0).alias("won"))
    models = [(boosting.Setting(depth=1, rounds=4, step=0.1 + k / 100), 1) for k in range(boosting.FEW + 1)]
    boosting.boost(boosting.cells(rows, ["x"], "won"), models)
    assert seen and set(seen) == {1}
    assert not os.path.exists(f"{tmp_path}/margins") and os.path.exists(f"{tmp_path}/cells")


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_whole_models(spark, monkeypatch, block):
    """Models trained in a task each are those of the passes, and take no job for each level."""
    data = table(150, 6)
    frame = spark.createDataFrame(data, "id int, fold int, a int, b double, c double, y boolean").repartition(3)
    models = [(Setting(depth=d, step=0.2, l2=0.1, l1=l1, rounds=r), f) for d, l1, r in ((1, 0.1, 6), (4, 0.0, 5), (3, 1.0, 6)) for f in (1, 3, ALL)]
    found = []
    monkeypatch.setattr(boosting, "BLOCK", block)
    for many in (0, 10**6):
        monkeypatch.setattr(boosting, "MANY", many)
        cells, tracker = boosting.cells(frame, ["a", "b", "c"], "y"), spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"whole {many} {block}", "")
        done = boosting.boost(cells, models, (2, 6))
        found.append((done, len(tracker.getJobIdsForGroup(f"whole {many} {block}"))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    (whole, few), (passes, more) = found
    assert whole.tested == passes.tested and few < 6 < more
    for a, b in zip(whole.rounds, passes.rounds, strict=True):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.array_equal(a.missing_left, b.missing_left)
        assert np.allclose(a.gain, b.gain) and np.allclose(a.value, b.value)


def test_many_cells_take_passes(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WHOLE", 5)
    monkeypatch.setattr(boosting, "MANY", 0)
    monkeypatch.setattr(boosting, "_whole", None)
    frame = spark.createDataFrame(table(80, 7), "id int, fold int, a int, b double, c double, y boolean")
    assert boosting.walk_forward(frame, ["a", "b", "c"], "y", setting=Setting(rounds=2)).count() == 3
