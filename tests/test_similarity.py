"""Similarity joins against every pair compared."""

import random
from difflib import SequenceMatcher

import pytest

from tidemark.operators import entity, similarity


def misspelt(rng, name):
    out = list(name)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and k < len(out) and len(out) > 2:
            del out[k]
        else:
            out.insert(k, rng.choice("abcdefgh "))
    return " ".join("".join(out).split())


def names(n, seed=1):
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfghjklmnprstvz" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    common = [word() for _ in range(12)]
    base = [" ".join(sorted(rng.choice(common) if rng.random() < 0.3 else word() for _ in range(rng.randrange(1, 4)))) for _ in range(n)]
    return base, [misspelt(rng, x) for x in base[: n // 2]] + ["a", "ab", "abc", "", "bb bb", "aaaaaaaaaaaa"]


def frame(spark, values):
    return spark.createDataFrame([(x,) for x in values] + [(None,)], "s string")


@pytest.mark.parametrize("threshold", [75.0, 80.0, 92.0, 55.0])
def test_alike(spark, threshold):
    a, b = names(220)
    b = b + ["kk", "k k", "abba", "aaaaaa"]
    want = {(x, y) for x in set(a + ["k", "aaaaaaa"]) for y in set(b) if x and y and entity.ratio(x, y) >= threshold}
    got = {(r.a, r.b) for r in similarity.alike(frame(spark, a + ["k", "aaaaaaa"]), frame(spark, b), threshold).collect()}
    assert want <= got and len(want) > 20


def test_five_thousand_names(spark):
    """Exact against all pairs of 5,000 names, of which under one in a hundred is compared."""
    a, b = names(3400, 2)
    b = b[:1600]
    want = {(x, y) for x in set(a) for y in set(b) if y and 2 * min(len(x), len(y)) >= 0.92 * (len(x) + len(y)) and entity.ratio(x, y) >= 92}
    got = {(r.a, r.b) for r in similarity.alike(frame(spark, a), frame(spark, b), 92.0).collect()}
    assert want <= got and len(got) < 0.01 * len(set(a)) * len(set(b)) and len(want) > 500


@pytest.mark.parametrize("threshold", [75.0, 90.0])
def test_alike_by_words(spark, threshold):
    a, b = names(160, 3)
    a += ["x y z w v u", "p q", "a a b"]
    b += ["x y z", "q p long words here", "b a", "z y x"]
    want = {(x, y) for x in set(a) for y in set(b) if x and y and entity.set_ratio(x, y) >= threshold}
    pairs = similarity.alike_by_words(frame(spark, a), frame(spark, b), threshold)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert want <= got and len(got) < 0.3 * len(set(a)) * len(set(b)) and len(want) > 20


def test_best_match(spark):
    a, b = names(120, 4)
    register = spark.createDataFrame([(x, float(i % 5)) for i, x in enumerate(sorted(set(a)))] + [(None, 1.0)], "name string, weight double")
    got = {r.left_name: (r.right_name, r.score) for r in entity.best_match(spark.createDataFrame([(x,) for x in b], "name string"), register, 75.0).collect()}
    want = {}
    for x in set(b):
        each = [(round(entity.sorted_ratio(x, y), 9), float(i % 5), y) for i, y in enumerate(sorted(set(a)))]
        best = max(each)
        if len(x) >= 3 and best[0] >= 75:
            want[x] = (best[2], round(best[0], 4))
    assert set(got) == set(want) and all(got[x][1] == pytest.approx(want[x][1], abs=2e-4) for x in want)


def test_tender_winners_misspelt(spark):
    rng = random.Random(5)
    a, _ = names(80, 5)
    companies = sorted(set(a))
    winners = [f"{misspelt(rng, rng.choice(companies)).title()} {rng.choice(['Ltd', 'Limited', ''])}" for _ in range(120)] + ["", "zzz"]
    got = {r.tender_id: (r.scrip_code, r.ratio) for r in entity.tender_winners(spark.createDataFrame(list(enumerate(winners)), "tender_id long, winner string"), spark.createDataFrame([(x, str(i)) for i, x in enumerate(companies)], "name string, scrip_code string")).collect()}
    clean = lambda x: x.lower().replace(" ltd", "").replace(" limited", "").strip()
    for k, w in enumerate(winners):
        ratio, code = max((SequenceMatcher(None, clean(w), clean(c)).ratio(), str(i)) for i, c in enumerate(companies))
        if ratio >= 0.8:
            assert got[k][1] == pytest.approx(ratio)
        else:
            assert k not in got


def test_resolve_companies(spark):
    companies = spark.createDataFrame([("1", "Alpha Works Ltd", "L1"), ("2", "Beta Mills", ""), ("3", "ALPHA WORKS", "L3"), ("4", "Gamma Power", "L4")], "scrip_code string, name string, cin string")
    asked = spark.createDataFrame([("anything", "4"), ("alpha works", None), ("Alpha Workz", "2"), ("Beta Mills", None), (None, "1"), (None, None)], "name string, scrip_code string")
    got = {(r.name, r.scrip_code): (r.cin, r.how) for r in entity.resolve_companies(asked, companies).collect()}
    assert got[("anything", "4")] == ("L4", "scrip") and got[("alpha works", None)] == ("L3", "exact") and got[(None, "1")] == ("L1", "scrip")
    assert got[("Alpha Workz", "2")][1] == "none" and got[("Beta Mills", None)] == (None, "none") and got[(None, None)] == (None, "none")


def test_tracked_names_plan(spark):
    """The ratios run over stored pairs: no Python under an aggregate or over the deals' rows."""
    deals = spark.createDataFrame([("Vijay Kedia",), ("x",)] * 50, "client string")
    plan = entity.tracked_names(deals, spark.createDataFrame([("nation_1",)], "name string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ArrowEvalPython" in plan
    for part in plan.split("ArrowEvalPython")[1:]:
        below = part.split("Relation")[0]
        assert "Aggregate" not in below and "Join" not in below


def test_no_side_of_names_is_sent_whole(spark):
    """Stored names are small files: no join may take that for a small side, which the driver would have to hold."""
    from pyspark.sql import functions as F

    left = similarity.stored(spark.range(3000).select(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("s")), "left")
    right = similarity.stored(spark.createDataFrame([("NATION_1",), ("CUSTOMER 7",)], "s string"), "right")
    plan = lambda pairs: pairs._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan(similarity.candidates(left, right, 75.0, 1))
    assert "BroadcastExchange" not in plan(similarity.sharing_words(left, right, 75.0))


def test_shared_words_beside_words_of_one_side(spark):
    """Words that the other side lacks weigh too, and are no reason to meet."""
    import itertools

    a = [" ".join(x) for x in itertools.permutations(["ab", "cde", "longerword", "q7", "zz"], 3)][::3] + ["only here", "ab"]
    b = [" ".join(x) for x in itertools.permutations(["ab", "cde", "elsewhere", "q7", "y"], 2)] + ["longerword", "not there", "ab cde"]
    left, right = spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "s string")
    weigh = lambda ws: sum(len(w) + 1 for w in ws)
    for threshold in (60.0, 75.0, 92.0):
        share = threshold / (200 - threshold)
        want = {(x, y) for x in a for y in b if weigh(set(x.split()) & set(y.split())) >= min(weigh(set(x.split())), weigh(set(y.split()))) * share - 1e-9}
        got = [tuple(r) for r in similarity.sharing_words(left, right, threshold).select("a", "b").collect()]
        assert sorted(got) == sorted(want)
