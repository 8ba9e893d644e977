"""Joins of names that are alike: what they have to share is joined on and counted in the JVM, and only pairs that pass are compared."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.landing import landing_dir


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once: what is worked out twice from it, or is dear to filter, has one form."""
    path = landing_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts both: stored names look far smaller by their files than they are, and a side that Spark takes to be small goes through the driver to every task."""
    return df.hint("merge")


def bound(value: Column, then) -> Column:
    """then(value), with value worked out once: a lambda that names an expression works it out for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def grams(text: Column, q: int) -> Column:
    """The strings of q characters in a text, as a set: the k-th of equal ones is another element than the first."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    each = F.when(F.length(text) >= q, each).otherwise(F.array().cast("array<string>"))
    number = lambda e, g, i: F.size(F.filter(F.slice(e, F.lit(1), i + 1), lambda x: x == g)).cast("string")
    return bound(each, lambda e: F.transform(e, lambda g, i: F.concat(g, F.lit("\0"), number(e, g, i))))


class Shared:
    """How many q-grams two texts have to share for a ratio 200 * LCS / (length + length) of at least threshold.

    With S the sum of their lengths and t = threshold / 200, the common subsequence has t * S characters, so that the
    longer way from one to the other deletes and inserts (1 - 2t) * S of them; a deletion costs q grams at most, an
    insertion q - 1. What stays is (t * (2q - 1) - (q - 1)) * S - (q - 1).
    """

    def __init__(self, threshold: float, q: int):
        self.q, self.part = q, threshold / 200
        self.slope, self.less = self.part * (2 * q - 1) - (q - 1), q - 1

    def least(self, both: Column) -> Column:
        return F.ceil(both * self.slope - self.less - 1e-9)

    @property
    def from_length(self) -> int:
        """The sum of lengths from which on at least one gram has to be shared."""
        return math.ceil((1 + self.less) / self.slope - 1e-9)

    def shortest(self, length: Column) -> Column:
        """The least length of a partner."""
        return F.ceil(length * (self.part / (1 - self.part)) - 1e-9)


def _prefixes(names: DataFrame, order: DataFrame, rule: Shared) -> DataFrame:
    """s, n, size, at, gram: each text's grams by frequency, rare first, as many as any partner has to share one of."""
    each = names.select("s", F.length("s").alias("n"), F.explode(grams(F.col("s"), rule.q)).alias("gram"))
    each = each.join(F.broadcast(order), "gram") if rule.q == 1 else whole_side(each).join(order, "gram")  # characters are as many as an alphabet has
    w = Window.partitionBy("s").orderBy("f", "gram")
    each = each.withColumn("at", F.row_number().over(w)).withColumn("size", F.count("gram").over(Window.partitionBy("s")))
    least = F.greatest(rule.least(F.col("n") + rule.shortest(F.col("n"))), F.lit(1))
    return each.filter(F.col("at") <= F.col("size") - least + 1).select("s", "n", "size", "at", "gram")


def candidates(left: DataFrame, right: DataFrame, threshold: float, q: int, both_from: int = 0, both_to: int = 1 << 30) -> DataFrame:
    """a, b: the pairs of left(s) and right(s) that share as many q-grams as the threshold asks for; sums of lengths from both_from to below both_to.

    left and right are distinct, and cheap to read again. A pair meets on a gram of both prefixes whose places differ by no more than
    the edits allow; the matches counted and the places after the last one bound what it can share, and pairs that pass
    have their whole grams counted.
    """
    rule = Shared(threshold, q)
    short = lambda d: d.filter(F.length("s") < both_to) if both_to < 1 << 30 else d
    left, right = short(left), short(right)
    gram = lambda d: d.select(F.explode(grams(F.col("s"), q)).alias("gram"))
    order = gram(left).unionByName(gram(right)).groupBy("gram").agg(F.count("gram").alias("f"))
    x = _prefixes(left, order, rule).toDF("a", "na", "ga", "i", "gram")
    y = _prefixes(right, order, rule).toDF("b", "nb", "gb", "j", "gram")
    both = F.col("na") + F.col("nb")
    fits = (2 * F.least("na", "nb") >= both * (2 * rule.part) - 1e-9) & (both >= both_from) & (both < both_to)
    met = x.join(y, "gram").filter(fits).groupBy("a", "b", both.alias("both")).agg(F.count("gram").alias("m"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("ga").alias("ga"), F.first("gb").alias("gb"))
    met = met.filter(F.col("m") + F.least(F.col("ga") - F.col("i"), F.col("gb") - F.col("j")) >= rule.least(F.col("both")))
    whole = lambda d, name: d.select(F.col("s").alias(name), grams(F.col("s"), q).alias(f"{name}q"), grams(F.col("s"), 1).alias(f"{name}1"))
    met = met.select("a", "b", "both").join(whole_side(whole(left, "a")), "a").join(whole_side(whole(right, "b")), "b")
    common = lambda k: F.size(F.array_intersect(f"a{k}", f"b{k}"))
    return met.filter((common("q") >= rule.least(F.col("both"))) & (common(1) >= F.ceil(F.col("both") * rule.part - 1e-9))).select("a", "b")


def fitting_q(threshold: float) -> int:
    """The longest grams that still leave a pair a quarter of its characters to share."""
    return next(q for q in (3, 2, 1) if q == 1 or Shared(threshold, q).slope >= 0.12)


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: every pair of left(s) and right(s), each name once, that can have an Indel ratio of at least threshold (over 0).

    Pairs too short to have to share a longer gram are found by their characters. Null and empty names are like nothing.
    """
    named = lambda d, what: stored(d.filter("s <> ''").select("s").distinct(), what)
    left, right = named(left, "left"), named(right, "right")
    q = fitting_q(threshold)
    if q == 1:
        return candidates(left, right, threshold, 1)
    start = Shared(threshold, q).from_length
    return candidates(left, right, threshold, q, both_from=start).unionByName(candidates(left, right, threshold, 1, both_to=start))


# White space, as Python splits on it.
BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def words(text: Column) -> Column:
    """The distinct words of a text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, BLANK), lambda w: w != "")))


def weight(of: Column) -> Column:
    """Characters of words, and one more for each."""
    return F.aggregate(of, F.lit(0), lambda t, w: t + F.length(w) + 1)


def share_of(threshold: float) -> float:
    """The part of a side's weight that has to be shared for the shared words and that side's whole to have a ratio of threshold."""
    return threshold / (200 - threshold)


def shares_words(a: Column, b: Column, threshold: float) -> Column:
    """Whether the words that both sets have are enough of one of them."""
    return weight(F.array_intersect(a, b)) >= F.least(weight(a), weight(b)) * share_of(threshold) - 1e-9


def sharing_words(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of left(s) and right(s) whose shared words are enough of one of them (share_of).

    Words that one side alone has can't be shared, and go first. Of the others a side's prefix is its rarest, up to the
    point where the rest weighs less than that share; a pair that qualifies by that side has a word of the prefix in
    common. Pairs meet on it, and are then weighed.
    """
    share = share_of(threshold)
    word = lambda d, name: d.select(F.col("s").alias(name), weight(words(F.col("s"))).alias("whole"), F.explode(words(F.col("s"))).alias("w"))
    count = lambda d, f: word(d, "s").groupBy("w").agg(F.count("w").alias(f))
    order = stored(whole_side(count(left, "f")).join(count(right, "g"), "w").select("w", (F.col("f") + F.col("g")).alias("f")), "words")
    known = lambda d, name: whole_side(word(d, name)).join(order, "w")

    def prefix(d: DataFrame, name: str) -> DataFrame:
        after = Window.partitionBy(name).orderBy(F.desc("f"), F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)
        each = known(d, name).select(name, "w", F.sum(F.length("w") + 1).over(after).alias("rest"), "whole")
        return each.filter(F.col("rest") >= F.col("whole") * share - 1e-9).select(name, "w")

    both = lambda x, y: whole_side(x).join(y, "w").select("a", "b")
    met = both(prefix(left, "a"), known(right, "b").select("b", "w")).unionByName(both(known(left, "a").select("a", "w"), prefix(right, "b")))
    return met.distinct().filter(shares_words(words(F.col("a")), words(F.col("b")), threshold))


def alike_by_words(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: every pair of left(s) and right(s) that can have a ratio of word sets of at least threshold; stored.

    Either the shared words make the ratio (sharing_words), or both wholes are alike in an order that depends on the
    pair: they then share as many characters, whatever the order.
    """
    named = lambda d: d.filter("s <> ''").select("s").distinct().withColumn("k", F.array_join(words(F.col("s")), " ")).filter("k <> ''")
    left, right = named(left), named(right)
    key = lambda d: d.select(F.col("k").alias("s")).distinct()
    whole = candidates(key(left), key(right), threshold, 1).toDF("ka", "kb")
    whole = whole.join(whole_side(left.toDF("a", "ka")), "ka").join(whole_side(right.toDF("b", "kb")), "kb").select("a", "b")
    return stored(sharing_words(left.select("s"), right.select("s"), threshold).unionByName(whole).distinct(), "alike")
