"""Name matching: exact, then by similarity ratios, in Arrow batches and for pairs that can reach the threshold alone."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.params import SUPERSTARS
from tidemark.functions.text import normal_name
from tidemark.operators import similarity as S


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's whole, words as sets; 100 if one's words are all in the other."""
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_x and only_y):
        return 100.0
    one, two = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


def _udf(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def indel_ratio(a: Column, b: Column) -> Column:
    return _udf(ratio)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _udf(sorted_ratio)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _udf(set_ratio)(a, b)


def block_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp, 0 to 1."""
    return _udf(lambda x, y: SequenceMatcher(None, x, y).ratio())(a, b)


# Words of an institution's name.
INSTITUTIONS = ("MUTUAL FUND", "CAPITAL", "SECURITIES", "HOLDINGS", "INVESTMENT", "ASSET MANAGEMENT", "FUND")


def _may_be(a: Column, stars: tuple[str, ...], threshold: float) -> Column:
    """Of a few fixed names those that a name can reach the threshold with, by words shared or by characters."""
    known = [(star, sorted(set(star.split()))) for star in stars]

    def those(z: Column) -> Column:
        may = []
        for star, each in known:
            text = " ".join(each)
            chars = F.split(F.lit("\1".join(f"{c}\0{text[:i].count(c) + 1}" for i, c in enumerate(text))), "\1")
            enough = F.size(F.array_intersect(z["chars"], chars)) >= F.ceil((F.size(z["chars"]) + len(text)) * (threshold / 200) - 1e-9)
            may.append(F.when((F.size(z["own"]) > 0) & (S.shares_words(z["own"], F.split(F.lit(text), " "), threshold) | enough), star))
        return F.filter(F.array(*may), lambda x: x.isNotNull())

    return S.bound(S.bound(S.words(a), lambda w: F.struct(w.alias("own"), S.grams(F.array_join(w, " "), 1).alias("chars"))), those)


def tracked_names(names: DataFrame, donors: DataFrame, stars: tuple[str, ...] = SUPERSTARS, star_score: float = 90.0, donor_score: float = 75.0) -> DataFrame:
    """client, why of the tracked among names(client), each name once: 'superstar', 'institution' or 'donor' (of donors(name)), the first that holds.

    An investor's name must be over star_score by the ratio of word sets, a donor's at least donor_score; donors are
    compared as they are written, clients in capitals. The distinct names are stored first; ratios are worked out for
    those pairs alone that can reach the score by their words or their characters.
    """
    once = names.select("client").filter("client IS NOT NULL").distinct().withColumn("a", F.upper("client"))
    seen = S.stored(once.select("client", "a", F.col("a").rlike("|".join(INSTITUTIONS)).alias("institution"), _may_be(F.col("a"), stars, star_score).alias("may")), "clients")
    star = seen.filter(F.size("may") > 0).select("client", "a", F.explode("may").alias("star")).filter(token_set_ratio(F.col("star"), F.col("a")) > star_score)
    near = S.alike_by_words(seen.filter("NOT institution").select(F.col("a").alias("s")), donors.select(F.col("name").alias("s")), donor_score)
    donor = near.filter(token_set_ratio(F.col("a"), F.col("b")) >= donor_score).select("a").distinct().withColumn("donor", F.lit("donor"))
    out = S.whole_side(seen).join(star.select("client").distinct().withColumn("star", F.lit("superstar")), "client", "left").join(S.whole_side(donor), "a", "left")
    return out.select("client", F.coalesce("star", F.when(F.col("institution"), "institution"), "donor").alias("why")).filter("why IS NOT NULL")


def tender_winners(tenders: DataFrame, companies: DataFrame, threshold: float = 0.8) -> DataFrame:
    """tenders(tender_id, winner) with scrip_code, ratio: the company whose name, both without ' ltd' and ' limited', is most like the winner's.

    A company of just that name needs no comparison. The ratio counts blocks in order, which are a common subsequence:
    only pairs that can have an Indel ratio as high are compared. Of equals the smallest scrip_code.
    """
    clean = lambda c: F.trim(F.replace(F.replace(F.lower(c), F.lit(" ltd"), F.lit("")), F.lit(" limited"), F.lit("")))
    won = tenders.select(clean(F.col("winner")).alias("a")).distinct()
    register = S.stored(companies.groupBy(clean(F.col("name")).alias("b")).agg(F.min("scrip_code").alias("scrip_code")), "register")
    exact = won.join(S.whole_side(register), F.col("a") == F.col("b")).select("a", "scrip_code", F.lit(1.0).alias("ratio"))
    pairs = S.stored(S.alike(S.whole_side(won).join(exact, "a", "left_anti").select(F.col("a").alias("s")), register.select(F.col("b").alias("s")), 100 * threshold), "pairs")
    near = pairs.withColumn("ratio", block_ratio(F.col("a"), F.col("b"))).filter(F.col("ratio") >= threshold).join(S.whole_side(register), "b")
    best = near.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "scrip_code")).alias("x")).select("a", "x.scrip_code", (-F.col("x.r")).alias("ratio"))
    return S.whole_side(tenders.withColumn("a", clean(F.col("winner")))).join(exact.unionByName(best), "a").drop("a")


def best_match(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left_name, right_name, score: for each name of left(name) its best of right(name, weight) by the ratio of sorted words, if at least threshold.

    Of equals the heaviest, then the last by name. right is a register of names, each normalised name once; names under
    three characters are left out. Pairs are found by what they share (similarity.alike), in any number.
    """
    by_words = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    a = left.select(F.col("name").alias("left_name"), normal_name(F.col("name")).alias("n")).distinct().filter(F.length("n") >= 3).select("left_name", by_words(F.col("n")).alias("a"))
    b = right.groupBy(normal_name(F.col("name")).alias("n")).agg(F.max_by("name", F.struct("weight", "name")).alias("right_name"), F.max("weight").alias("weight"))
    a, b = S.stored(a, "names"), S.stored(b.filter(F.length("n") >= 3).select("right_name", "weight", by_words(F.col("n")).alias("b")), "register")
    pairs = S.stored(S.alike(a.select(F.col("a").alias("s")), b.select(F.col("b").alias("s")), threshold), "pairs")
    scored = pairs.withColumn("score", indel_ratio(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)
    best = scored.join(S.whole_side(b), "b").groupBy("a").agg(F.max(F.struct("score", "weight", "right_name")).alias("x"))
    return S.whole_side(a).join(best, "a").select("left_name", "x.right_name", F.round("x.score", 4).alias("score"))


def resolve(names: DataFrame, register: DataFrame, threshold: float = 92.0) -> DataFrame:
    """name, match, how ('exact', 'fuzzy' or 'none'): exact on the normalised name first, the rest by similarity.

    Of register(name, weight, seq) names that are the same when normalised, the one with the last seq stands.
    """
    reg = register.groupBy(normal_name(F.col("name")).alias("n")).agg(F.max_by("name", "seq").alias("match"))
    tier = S.stored(names.select("name", normal_name(F.col("name")).alias("n")).distinct().join(S.whole_side(reg), "n", "left"), "tier")
    rest = best_match(tier.filter("match IS NULL").select("name"), register, threshold)
    out = S.whole_side(tier).join(rest.select(F.col("left_name").alias("name"), "right_name"), "name", "left")
    how = F.when(F.col("match").isNotNull(), "exact").when(F.col("right_name").isNotNull(), "fuzzy").otherwise("none")
    return out.select("name", F.coalesce("match", "right_name").alias("match"), how.alias("how"))


def resolve_companies(asked: DataFrame, companies: DataFrame, threshold: float = 92.0) -> DataFrame:
    """asked(name, scrip_code) with cin, how ('scrip', 'exact', 'fuzzy' or 'none'): by the code first, then by name among companies(scrip_code, name, cin).

    A company without a cin ('' counts as none) tells nothing. Of companies of one normalised name the last code stands.
    """
    known = companies.filter("cin <> ''")
    codes = known.groupBy("scrip_code").agg(F.max("cin").alias("by_code"))
    coded = S.stored(asked.select("name", "scrip_code").join(S.whole_side(codes), "scrip_code", "left"), "coded")
    register = known.select("name", F.lit(1.0).alias("weight"), F.col("scrip_code").alias("seq"))
    told = resolve(coded.filter("by_code IS NULL AND name IS NOT NULL").select("name"), register, threshold)
    cins = known.groupBy(F.col("name").alias("match")).agg(F.max_by("cin", "scrip_code").alias("by_name"))
    out = S.whole_side(coded).join(S.whole_side(told).join(cins, "match", "left"), "name", "left")
    how = F.when(F.col("by_code").isNotNull(), "scrip").otherwise(F.coalesce("how", F.lit("none")))
    return out.select("name", "scrip_code", F.coalesce("by_code", "by_name").alias("cin"), how.alias("how"))
