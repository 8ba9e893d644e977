"""Price and volume indicators: window expressions over (scrip_code, trade_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, DAY = "scrip_code", "trade_date"
#: Rows of a series over which an average's weights are prefix sums; far fewer than overflow a double.
BLOCK = 1000


def by_day(last: int | None = None):
    w = Window.partitionBy(KEY).orderBy(DAY)
    return w if last is None else w.rowsBetween(1 - last, 0)


def full_window(value: Column, rows: int, how=F.avg) -> Column:
    """A moving aggregate, null until the window is full."""
    w = by_day(rows)
    return F.when(F.count(value).over(w) == rows, how(value).over(w))


def numbered(prices: DataFrame) -> DataFrame:
    return prices.withColumn("rn", F.row_number().over(by_day()))


def blocked(rows: DataFrame) -> DataFrame:
    """Adds __b and __i, a row's block and its place there (rows have rn): averages that share them share one sort."""
    return rows.withColumn("__b", F.floor((F.col("rn") - 1) / BLOCK)).withColumn("__i", (F.col("rn") - 1) % BLOCK)


def ema(rows: DataFrame, source: str, name: str, alpha: float, adjust: bool = False) -> DataFrame:
    """Exponential average of source as column name; rows have rn. adjust weighs as if nothing came before the first row.

    y[t] = a x[t] + (1 - a) y[t-1] is a prefix sum of x[i] (1 - a) ** -i, taken per BLOCK rows so that the weights stay
    small; what came before a block reaches it through the block before it (older ones weigh under (1 - a) ** BLOCK).
    Nulls are skipped as zeros of no weight only where adjust is set. Rows that are blocked already stay so.
    """
    decay = 1.0 - alpha
    own = () if "__b" in rows.columns else ("__b", "__i")
    rows = blocked(rows) if own else rows
    block = Window.partitionBy(KEY, "__b").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(KEY).orderBy("__b").rangeBetween(-1, -1)
    scale, down = F.pow(F.lit(decay), -F.col("__i")), F.pow(F.lit(decay), F.col("__i"))
    x = F.col(source)
    weight = F.lit(1.0) if adjust else F.when(F.col("rn") == 1, 1.0).otherwise(alpha)
    rows = rows.withColumn("__s", down * F.sum(weight * x * scale).over(block))
    rows = rows.withColumn("__p", F.max_by("__s", "rn").over(before))
    total = F.col("__s") + F.coalesce(F.col("__p"), F.lit(0.0)) * F.pow(F.lit(decay), F.col("__i") + 1)
    if adjust:
        rows = rows.withColumn("__w", down * F.sum(F.when(x.isNotNull(), scale)).over(block))
        rows = rows.withColumn("__q", F.max_by("__w", "rn").over(before))
        weights = F.col("__w") + F.coalesce(F.col("__q"), F.lit(0.0)) * F.pow(F.lit(decay), F.col("__i") + 1)
        return rows.withColumn(name, total / weights).drop(*own, "__s", "__p", "__w", "__q")
    return rows.withColumn(name, total).drop(*own, "__s", "__p")


def rsi(prices: DataFrame, span: int = 14) -> DataFrame:
    """Adds rsi; null before row span, and where nothing was lost."""
    rows = numbered(prices).withColumn("__d", F.col("close") - F.lag("close").over(by_day()))
    rows = rows.withColumn("__g", F.greatest(F.coalesce("__d", F.lit(0.0)), F.lit(0.0))).withColumn("__l", F.greatest(-F.coalesce("__d", F.lit(0.0)), F.lit(0.0)))
    rows = ema(ema(blocked(rows), "__g", "__ag", 1 / span, adjust=True), "__l", "__al", 1 / span, adjust=True)
    rs = F.col("__ag") / F.nullif(F.col("__al"), F.lit(0.0))
    return rows.withColumn("rsi", F.when(F.col("rn") >= span, 100 - 100 / (1 + rs))).drop("__d", "__g", "__l", "__ag", "__al", "__b", "__i")


def macd(prices: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds macd, macd_signal and macd_hist."""
    rows = ema(ema(blocked(numbered(prices)), "close", "__f", 2 / (fast + 1)), "close", "__s2", 2 / (slow + 1))
    rows = ema(rows.withColumn("macd", F.col("__f") - F.col("__s2")).drop("__f", "__s2"), "macd", "macd_signal", 2 / (signal + 1))
    return rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__b", "__i")


def macd_bullish(rows: DataFrame) -> DataFrame:
    """Adds macd_bullish: a positive histogram that was none two rows ago, or that grows."""
    one, two = F.lag("macd_hist", 1).over(by_day()), F.lag("macd_hist", 2).over(by_day())
    return rows.withColumn("macd_bullish", F.coalesce((F.col("macd_hist") > 0) & ((two <= 0) | (F.col("macd_hist") > one)) & two.isNotNull(), F.lit(False)))


def obv(prices: DataFrame) -> DataFrame:
    """Adds obv: volume summed with the sign of the day's change."""
    step = F.coalesce(F.col("volume") * F.signum(F.col("close") - F.lag("close").over(by_day())), F.lit(0.0))
    return prices.withColumn("__v", step).withColumn("obv", F.sum("__v").over(by_day().rowsBetween(Window.unboundedPreceding, 0))).drop("__v")


def obv_slope(rows: DataFrame, last: int = 10) -> DataFrame:
    """Adds obv_slope: the least-squares slope of the last rows of obv, from its sums (rows have rn)."""
    w = by_day(last)
    x, y = F.col("rn") - F.max("rn").over(w), F.col("obv")
    rows = rows.withColumn("__n", F.count(y).over(w))
    sx, sxx = -(F.col("__n") - 1) * F.col("__n") / 2, (F.col("__n") - 1) * F.col("__n") * (2 * F.col("__n") - 1) / 6
    sy = F.sum(y).over(w)
    sxy = F.sum(F.col("rn") * y).over(w) - F.col("rn") * sy
    slope = (F.col("__n") * sxy - sx * sy) / (F.col("__n") * sxx - sx * sx)
    return rows.withColumn("obv_slope", F.when(F.col("__n") >= last, slope)).drop("__n")


def atr(prices: DataFrame, span: int = 14) -> DataFrame:
    """Adds atr and atr_stop (close less two of it)."""
    prev = F.lag("close").over(by_day())
    rows = numbered(prices).withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return ema(rows, "__tr", "atr", 2 / (span + 1)).drop("__tr").withColumn("atr_stop", F.col("close") - 2 * F.col("atr"))


def vwap(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Adds vwap over a full window; null without volume."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return prices.withColumn("__tv", typical * F.col("volume")).withColumn("vwap", full_window(F.col("__tv"), rows, F.sum) / F.nullif(full_window(F.col("volume"), rows, F.sum), F.lit(0.0))).drop("__tv")


def volume_spike(prices: DataFrame, rows: int = 14, z: float = 3.0) -> DataFrame:
    """Each scrip's last day against the rows before it: z_score by the population deviation, 0 where that is 0."""
    w = by_day().rowsBetween(-rows, -1)
    out = prices.select(KEY, DAY, "volume", F.avg("volume").over(w).alias("mean"), F.stddev_pop("volume").over(w).alias("dev"), F.count("volume").over(w).alias("n"), F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(DAY))).alias("back"))
    out = out.filter(f"back = 1 AND n = {rows}")
    score = F.when(F.col("dev") > 0, (F.col("volume") - F.col("mean")) / F.col("dev")).otherwise(0.0)
    return out.select(KEY, DAY, "volume", score.alias("z_score"), (score > z).alias("is_spike"))


#: Rows from which a last day's averages are worked out: what comes before weighs under (25 / 27) ** REACH of it.
REACH = 1200
#: One row more in the running averages of a series: what has come so far (a) and the row (x).
STEP = """named_struct(
  'c', x.close,
  'fast', a.fast + 2D / 13 * (x.close - a.fast),
  'slow', a.slow + 2D / 27 * (x.close - a.slow),
  'sig', a.sig + 0.2D * ((a.fast + 2D / 13 * (x.close - a.fast)) - (a.slow + 2D / 27 * (x.close - a.slow)) - a.sig),
  'h', (a.fast + 2D / 13 * (x.close - a.fast) - a.slow - 2D / 27 * (x.close - a.slow) - a.sig) * 0.8D,
  'h1', a.h, 'h2', a.h1,
  'gain', a.gain * 13D / 14 + greatest(x.close - a.c, 0D),
  'loss', a.loss * 13D / 14 + greatest(a.c - x.close, 0D),
  'weight', a.weight * 13D / 14 + 1,
  'atr', a.atr + 2D / 15 * (greatest(x.high - x.low, abs(x.high - a.c), abs(x.low - a.c)) - a.atr))"""
FIRST = """named_struct('c', rows[0].close, 'fast', rows[0].close, 'slow', rows[0].close, 'sig', 0D, 'h', 0D, 'h1', CAST(NULL AS DOUBLE), 'h2', CAST(NULL AS DOUBLE),
  'gain', 0D, 'loss', 0D, 'weight', 1D, 'atr', rows[0].high - rows[0].low)"""
LAST = {
    "sma50": "IF(size(rows) >= 50, aggregate(slice(rows, -50, 50), 0D, (t, x) -> t + x.close) / 50, NULL)",
    "sma200": "IF(size(rows) >= 200, aggregate(slice(rows, -200, 200), 0D, (t, x) -> t + x.close) / 200, NULL)",
    "vwap": "IF(size(rows) >= 20, aggregate(slice(rows, -20, 20), 0D, (t, x) -> t + (x.high + x.low + x.close) / 3 * x.volume) / nullif(aggregate(slice(rows, -20, 20), 0D, (t, x) -> t + x.volume), 0D), NULL)",
    # the slope of the last ten rows of on-balance volume, which doesn't depend on where it starts: a step counts for all rows from its own on
    "obv_slope": "IF(size(rows) >= 10, aggregate(sequence(1, 9), 0D, (t, i) -> t + i * (10 - i) / 2D * coalesce(element_at(rows, i - 10).volume * signum(element_at(rows, i - 10).close - element_at(rows, i - 11).close), 0D)) / 82.5D, NULL)",
}


def technical_score(prices: DataFrame) -> DataFrame:
    """Each scrip's last day: rsi, macd_hist, ta_score (0 to 10), ta_signal and ta_adjustment.

    One aggregate gathers a scrip's days (a calendar's at most); the averages of the last REACH are then one fold over
    them, and no window is worked out for days that aren't asked for.
    """
    day = F.struct(DAY, *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low", "volume")])
    rows = prices.groupBy(KEY).agg(F.array_sort(F.collect_list(day)).alias("rows")).withColumn("rn", F.size("rows"))
    rows = rows.withColumn("rows", F.slice("rows", F.greatest(F.lit(1), F.col("rn") - REACH), F.lit(REACH + 1)))
    rows = rows.withColumn("f", F.expr(f"aggregate(slice(rows, 2, {REACH}), {FIRST}, (a, x) -> {STEP})"))
    rows = rows.select(KEY, "rn", F.element_at("rows", -1)[DAY].alias(DAY), F.col("f.c").alias("close"), "f.h", "f.h1", "f.h2", "f.gain", "f.loss", "f.atr", *[F.expr(x).alias(c) for c, x in LAST.items()])
    rows = rows.withColumn("rsi", F.when(F.col("rn") >= 14, 100 - 100 / (1 + F.col("gain") / F.nullif(F.col("loss"), F.lit(0.0))))).withColumn("macd_hist", F.col("h")).withColumn("atr_stop", F.col("close") - 2 * F.col("atr"))
    bullish = F.coalesce((F.col("h") > 0) & ((F.col("h2") <= 0) | (F.col("h") > F.col("h1"))) & F.col("h2").isNotNull(), F.lit(False))
    golden = F.coalesce(F.col("sma50") > F.col("sma200"), F.lit(False))
    parts = [
        F.when(F.col("rsi") < 30, 2.0).when(F.col("rsi") < 40, 1.5).when(F.col("rsi") < 55, 1.0).when(F.col("rsi") < 70, 0.5).otherwise(0.0),
        F.when(bullish, 2.0).when(F.col("macd_hist") > 0, 1.0).otherwise(0.0),
        F.when(golden & (F.col("close") > F.col("sma50")), 2.0).when(golden, 1.0).when(F.col("close") > F.col("sma200"), 0.5).otherwise(0.0),
        F.when(F.col("obv_slope") > 0, 2.0).otherwise(0.0),
        F.when(F.col("close") > F.col("vwap"), 2.0).otherwise(0.0),
    ]
    rows = rows.withColumn("ta_score", sum(parts[1:], parts[0]))
    signal = F.when(F.col("ta_score") >= 8, "STRONG_BUY").when(F.col("ta_score") >= 6, "BUY").when(F.col("ta_score") >= 4, "NEUTRAL").otherwise("AVOID")
    adjust = F.when(F.col("ta_score") >= 8, 2.5).when(F.col("ta_score") >= 6, 1.0).when(F.col("ta_score") >= 4, 0.0).otherwise(-1.5)
    return rows.select(KEY, DAY, "close", "rsi", "macd_hist", "atr_stop", "ta_score", signal.alias("ta_signal"), adjust.alias("ta_adjustment"))
