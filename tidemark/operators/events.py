"""As-of returns and abnormal-return event studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event windows in trading days around the event.
CAR_WINDOWS = ((-1, 1), (-5, 5), (-10, 10), (0, 5), (0, 10), (0, 30))
RETURN_DAYS = (30, 60, 90, 180, 360)
EVENT = ("id", "scrip_code", "event_date")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def forward_returns(events: DataFrame, prices: DataFrame, days=RETURN_DAYS) -> DataFrame:
    """id, scrip_code, event_date, days, ret: from the first close on or after the event to the last within that many calendar days of it, in per cent.

    Prices are gathered by scrip and month first, one sorted row for each; an event meets the months it reaches, not
    its scrip's whole history, by keys that spread a scrip with very many events or prices. In an event's months the
    as-of rows are then looked up. An event with no price in its reach drops out; a series that ends early counts up to
    its end.
    """
    reach = max(days) + 40
    months = prices.groupBy(F.col("scrip_code").alias("k"), _month(F.col("trade_date")).alias("m")).agg(F.array_sort(F.collect_list(F.struct("trade_date", "close"))).alias("days"))
    asked = events.select(*EVENT, F.explode(F.sequence(_month(F.col("event_date")), _month(F.date_add("event_date", reach)))).alias("at"))
    met = asked.join(months, (F.col("scrip_code") == F.col("k")) & (F.col("at") == F.col("m")))
    rows = met.groupBy(*EVENT).agg(F.array_sort(F.collect_list(F.struct("m", "days"))).alias("months"))
    within = lambda x: (x["trade_date"] >= F.col("event_date")) & (x["trade_date"] <= F.date_add("event_date", reach))
    # the first day is in the first month that has days, or, where they all come before the event, in the next
    near = F.flatten(F.transform(F.slice("months", 1, 2), lambda m: F.filter(m["days"], within)))
    rows = rows.withColumn("base", F.get(near, F.lit(0))).filter("base IS NOT NULL")
    rows = rows.withColumn("end", F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.least(F.date_add("base.trade_date", d), F.date_add("event_date", reach)).alias("until")) for d in days])))
    last = F.element_at(F.filter("months", lambda m: F.get(m["days"], F.lit(0))["trade_date"] <= F.col("end.until")), -1)
    close = F.element_at(F.filter(last["days"], lambda x: x["trade_date"] <= F.col("end.until")), -1)["close"]
    return rows.select(*EVENT, "end.days", F.round((close / F.col("base.close") - 1) * 100, 2).alias("ret"))


def daily_returns(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """scrip_code, trade_date, r, m, rn, n and running sums cr, cm, crm, cmm: a scrip's and the benchmark's daily returns on days that both have.

    rn numbers a scrip's rows, n is how many it has, and the sums are of r, m, r * m and m * m up to and with a row; all
    come from one sort. The benchmark is one series of some thousand days; its own window has no key, which is bounded
    by the calendar.
    """
    own = prices.select("scrip_code", "trade_date", (F.col("close") / F.lag("close").over(Window.partitionBy("scrip_code").orderBy("trade_date")) - 1).alias("r"))
    market = benchmark.select("trade_date", (F.col("close") / F.lag("close").over(Window.orderBy("trade_date")) - 1).alias("m"))
    both = own.join(market, "trade_date").filter("r IS NOT NULL AND m IS NOT NULL")
    by = Window.partitionBy("scrip_code").orderBy("trade_date")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"cr": F.col("r"), "cm": F.col("m"), "crm": F.col("r") * F.col("m"), "cmm": F.col("m") * F.col("m")}
    return both.select("*", F.row_number().over(by).alias("rn"), F.count("r").over(Window.partitionBy("scrip_code")).alias("n"), *[F.sum(x).over(upto).alias(c) for c, x in sums.items()])


def car_windows(events: DataFrame, returns: DataFrame, windows=CAR_WINDOWS, estimation=(-120, -11), least: int = 20) -> DataFrame:
    """id, scrip_code, pre, post, car: cumulative abnormal returns in per cent, by a market model fitted on rows pos-120 to pos-12.

    With fewer than least estimation rows the benchmark's own return is taken off. A window that the series doesn't hold
    two rows of is left out, and so are scrips of under 30 rows and events after the last row.

    An event finds its row among those of the three months from its day on, by scrip and month. Each window, and the
    fit, is then the difference of two rows of running sums (daily_returns), which are looked up by scrip and number: ten rows an
    event, whatever the windows hold.
    """
    known = returns.filter("n >= 30")
    months = known.groupBy(F.col("scrip_code").alias("k"), _month(F.col("trade_date")).alias("m")).agg(F.array_sort(F.collect_list(F.struct("trade_date", "rn", "n"))).alias("days"))
    asked = events.select(*EVENT, F.explode(F.sequence(_month(F.col("event_date")), _month(F.date_add("event_date", 60)))).alias("at"))
    met = asked.join(months, (F.col("scrip_code") == F.col("k")) & (F.col("at") == F.col("m")))
    within = F.filter("days", lambda x: (x["trade_date"] >= F.col("event_date")) & (x["trade_date"] <= F.date_add("event_date", 60)))
    at = met.select(*EVENT, F.get(within, F.lit(0)).alias("d")).filter("d IS NOT NULL").groupBy(*EVENT).agg(F.min(F.struct("d.rn", "d.n")).alias("d")).select(*EVENT, F.col("d.rn").alias("pos"), "d.n")
    ends = sorted({estimation[0] - 1, estimation[1] - 1} | {x for a, b in windows for x in (a - 1, b)})
    row = lambda o: F.least(F.col("n"), F.col("pos") + o)  # noqa: E731  0 and less: before the series
    asked = at.select(*EVENT, "pos", "n", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), row(o).alias("x")) for o in ends])).alias("e")).select(*EVENT, "pos", "n", "e.o", "e.x")
    sums = known.select(F.col("scrip_code").alias("k"), F.col("rn").alias("x"), F.struct("cr", "cm", "crm", "cmm").alias("s"))
    found = asked.filter("x > 0").join(sums.withColumnRenamed("x", "y"), (F.col("scrip_code") == F.col("k")) & (F.col("x") == F.col("y")))
    found = found.groupBy(*EVENT, "pos", "n").agg(F.map_from_entries(F.collect_list(F.struct("o", "s"))).alias("sums"))
    upto = lambda o, c: F.coalesce(F.try_element_at("sums", F.lit(o))[c], F.lit(0.0))
    within = lambda a, b, c: upto(b, c) - upto(a - 1, c)
    count = lambda a, b: F.greatest(row(b), F.lit(0)) - F.greatest(row(a - 1), F.lit(0))
    a, b = estimation[0], estimation[1] - 1
    fit = found.select("*", count(a, b).alias("rows"), *[within(a, b, c).alias(c) for c in ("cr", "cm", "crm", "cmm")])
    spread = F.col("cmm") - F.col("cm") * F.col("cm") / F.col("rows")
    fit = fit.withColumn("beta", F.when((F.col("rows") > 0) & (spread > F.col("cmm") * 1e-14), (F.col("crm") - F.col("cr") * F.col("cm") / F.col("rows")) / spread))
    fit = fit.withColumn("alpha", F.when(F.col("rows") > 0, (F.col("cr") - F.col("beta") * F.col("cm")) / F.col("rows")))
    parts = [F.struct(F.lit(x).alias("pre"), F.lit(y).alias("post"), within(x, y, "cr").alias("r"), within(x, y, "cm").alias("m"), count(x, y).alias("k")) for x, y in windows]
    long_ = fit.select("id", "scrip_code", "rows", "alpha", "beta", F.explode(F.array(*parts)).alias("w")).filter("w.k > 1")
    model = F.when(F.col("rows") >= least, F.col("w.k") * F.col("alpha") + F.col("beta") * F.col("w.m")).otherwise(F.col("w.m"))
    return long_.select("id", "scrip_code", "w.pre", "w.post", F.round((F.col("w.r") - model) * 100, 4).alias("car"))
