"""Tests, regressions and walk-forward validation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.sources.landing import landing_dir


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return 1.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + k * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + k / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided, of a t statistic; 1 without degrees of freedom. A row per test, so Python costs nothing here."""
    return pd.Series([1.0 if pd.isna(a) or pd.isna(b) else t_tail(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical(df: pd.Series, level: pd.Series) -> pd.Series:
    """The t that is exceeded, on either side, with probability level; by bisection."""

    def solve(n: float, p: float) -> float:
        lo, hi = 0.0, 1.0
        while t_tail(hi, n) > p:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if t_tail(mid, n) > p else (lo, mid)
        return lo

    return pd.Series([solve(float(n), float(p)) if n > 0 else float("nan") for n, p in zip(df, level, strict=True)], dtype="float64")


def welch(rows: DataFrame, group: str, flag: str, value: str) -> DataFrame:
    """group, n1, n0, mean1, mean0, t, df: Welch's test of rows with flag against those without; t is 0 with fewer than two on a side."""
    one, two = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    s = rows.groupBy(group).agg(*[x for k, v in (("1", one), ("0", two)) for x in (F.count(v).alias(f"n{k}"), F.avg(v).alias(f"mean{k}"), F.var_samp(v).alias(f"v{k}"))])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    enough = (F.col("n1") >= 2) & (F.col("n0") >= 2) & (a + b > 0)
    t = F.when(enough, (F.col("mean1") - F.col("mean0")) / F.sqrt(a + b)).otherwise(0.0)
    df = F.when(enough, (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)))
    return s.select(group, "n1", "n0", "mean1", "mean0", t.alias("t"), df.alias("df"))


def one_sample(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, df, t against 0; t is 0 with fewer than two rows."""
    s = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return s.select(group, "n", "mean", F.when((F.col("n") >= 2) & (F.col("sd") > 0), (F.col("n") - 1).cast("double")).alias("df"), F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0).alias("t"))


def ols2(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """One row n, b0, b1, b2, r2: least squares on two regressors, from sums about the means in one aggregate."""
    f = lambda a, b: F.covar_pop(a, b)
    s = rows.agg(F.count(y).alias("n"), f(x1, x1).alias("s11"), f(x2, x2).alias("s22"), f(x1, x2).alias("s12"), f(x1, y).alias("s1y"), f(x2, y).alias("s2y"), f(y, y).alias("syy"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det
    b2 = (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det
    s = s.withColumn("b1", b1).withColumn("b2", b2)
    return s.select("n", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2", ((F.col("b1") * F.col("s1y") + F.col("b2") * F.col("s2y")) / F.col("syy")).alias("r2"))


def ols2_inference(rows: DataFrame, y: str, x1: str, x2: str, level: float = 0.05) -> DataFrame:
    """term ('const', x1, x2), coef, se, t, p, low, high, n, r2, adj_r2, f, f_p of least squares on two regressors.

    All come from one aggregate of sums about the means; the interval is that of level. The p-value of F with two
    degrees of freedom has a closed form. At least four rows are needed, and regressors that aren't collinear.
    """
    f = lambda a, b: F.covar_pop(a, b)
    s = rows.agg(F.count(y).cast("double").alias("n"), f(x1, x1).alias("s11"), f(x2, x2).alias("s22"), f(x1, x2).alias("s12"), f(x1, y).alias("s1y"), f(x2, y).alias("s2y"), f(y, y).alias("syy"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"))
    s = s.withColumn("det", F.expr("s11 * s22 - s12 * s12")).withColumn("df", F.col("n") - 3)
    s = s.withColumn("b1", F.expr("(s1y * s22 - s2y * s12) / det")).withColumn("b2", F.expr("(s2y * s11 - s1y * s12) / det"))
    s = s.withColumn("r2", F.expr("(b1 * s1y + b2 * s2y) / syy")).withColumn("sigma2", F.expr("n * syy * (1 - r2) / df"))
    term = lambda name, coef, var: F.struct(F.lit(name).alias("term"), F.expr(coef).alias("coef"), F.sqrt(F.expr(f"sigma2 * ({var})")).alias("se"))
    terms = F.array(term("const", "my - b1 * m1 - b2 * m2", "(1 + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det) / n"), term(x1, "b1", "s22 / (n * det)"), term(x2, "b2", "s11 / (n * det)"))
    ratio = F.expr("(r2 / 2) / ((1 - r2) / df)")
    s = s.select("n", "df", "r2", F.expr("1 - (1 - r2) * (n - 1) / df").alias("adj_r2"), ratio.alias("f"), F.pow(1 + 2 * ratio / F.col("df"), -F.col("df") / 2).alias("f_p"), F.explode(terms).alias("x"))
    s = s.select("x.*", (F.col("x.coef") / F.col("x.se")).alias("t"), "df", F.col("n").cast("long").alias("n"), "r2", "adj_r2", "f", "f_p")
    reach = t_critical(F.col("df"), F.lit(level)) * F.col("se")
    return s.select("term", "coef", "se", "t", p_value("t", "df").alias("p"), (F.col("coef") - reach).alias("low"), (F.col("coef") + reach).alias("high"), "n", "r2", "adj_r2", "f", "f_p")


def verdict(base_meaningful: Column, win_viable: Column, model_viable: Column) -> Column:
    """What the tests come to; an unknown outcome counts as failed."""
    base, win, model = (F.coalesce(c, F.lit(False)) for c in (base_meaningful, win_viable, model_viable))
    # The three outcomes.
    return F.when(base & win & model, "SIGNAL VALIDATED (ML APPROVED)").when(base & win, "SIGNAL VALIDATED (RULES ONLY)").otherwise("SIGNAL NEEDS REVIEW")


def folds(rows: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """rows with fold: walk-forward, k equal test blocks at the end (1 to k) and what comes before them (0). Fold f is trained on all before f.

    The order is over all rows, and has to tell any two apart; they are numbered by ranges, each in its own task, not in
    one. The ranges are stored, so that counting and numbering see the same ones.
    """
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    path = landing_dir(spark, "ranges")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("__p").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__q")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("__before"))
    total = counts.agg(F.sum("count").alias("__n"))
    rn = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) + F.col("__before")
    size = F.floor(F.col("__n") / (k + 1))
    first = F.col("__n") - k * size
    out = ranged.join(F.broadcast(before), F.col("__p") == F.col("__q")).crossJoin(F.broadcast(total)).withColumn("__rn", rn)
    return out.withColumn("fold", F.when(F.col("__rn") <= first, 0).otherwise(F.floor((F.col("__rn") - first - 1) / size) + 1).cast("int")).drop("__p", "__q", "__before", "__n", "__rn")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows in the order of a hash of the key: the same on every run."""
    return rows.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
