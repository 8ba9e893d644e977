"""Boosted trees over the panel of contract events, and what the tests come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import boosting, events, graph, indicators, stats
from tidemark.plans.catalog import CONNECTIONS, G_, RET, TOP, _connections, _soon, query
from tidemark.sources.landing import Landed, dropped_shuffles, landing_dir

FEATURES = ["alpha_score", "materiality_pct", "vol_z_score", "election_mult"]
#: Contract events with a 90-day return: their connection, size, the day's volume against the 14 rows before, the election, and whether they gained.
PANEL = f"""WITH {CONNECTIONS}{TOP}, {RET}, vz AS (SELECT scrip_code, trade_date, CASE WHEN n = 14 AND d > 0 THEN round((volume - m) / d, 2) END AS z FROM (
  SELECT scrip_code, trade_date, volume, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS d, count(*) OVER w AS n FROM prices WINDOW w AS (PARTITION BY scrip_code ORDER BY trade_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))),
panel AS (SELECT ret.id, ret.event_date, ret.ret > 0 AS won, coalesce(top.score, 0)::DOUBLE AS alpha_score, CASE WHEN market_cap > 0 THEN round(a.value / market_cap * 100, 1) END AS materiality_pct, vz.z AS vol_z_score, CASE WHEN s.party IS NOT NULL THEN 1.5 ELSE 1 END::DOUBLE AS election_mult
  FROM ret JOIN announcements a ON a.id = ret.id JOIN companies c ON c.scrip_code = ret.scrip_code LEFT JOIN top ON top.scrip_code = ret.scrip_code LEFT JOIN soon s ON s.party = top.party LEFT JOIN vz ON vz.scrip_code = ret.scrip_code AND vz.trade_date = ret.event_date WHERE days = 90)"""


class Steps:
    """Contract events, prices, the events' returns after 90 days and each company's best connection, each stored by itself."""

    def __init__(self, t):
        self.at = Landed(t.spark, "steps")
        self.contracts, self.prices = self.at.stored(t.announcements.filter("is_contract")), self.at.stored(t.prices)
        ret = events.forward_returns(self.contracts, self.prices, (30, 60, 90, 180, 360)).filter("days = 90").drop("days")
        self.ret, self.top = self.at.stored(ret), self.at.stored(graph.top_connections(_connections(t)).select("scrip_code", "score", "party"))


def panel(t, steps: Steps | None = None) -> DataFrame:
    """Stored, as training reads it again and again. steps: where the caller has them; it removes them."""
    own = steps or Steps(t)
    contracts, ret, top = own.contracts, own.ret, own.top
    ret = ret.select("id", "scrip_code", "event_date", (F.col("ret") > 0).alias("won"))
    top = top.join(F.broadcast(_soon(t).withColumn("boosted", F.lit(1.5))), "party", "left").drop("party")
    w = indicators.by_day().rowsBetween(-14, -1)
    z = F.when((F.count("volume").over(w) == 14) & (F.stddev_pop("volume").over(w) > 0), F.round((F.col("volume") - F.avg("volume").over(w)) / F.stddev_pop("volume").over(w), 2))
    spikes = own.prices.select("scrip_code", F.col("trade_date").alias("event_date"), z.alias("vol_z_score"))
    rows = ret.join(contracts.select("id", "value"), "id").join(t.companies.select("scrip_code", "market_cap"), "scrip_code").join(top, "scrip_code", "left").join(spikes, ["scrip_code", "event_date"], "left")
    size = F.when(F.col("market_cap") > 0, F.round(F.col("value") / F.col("market_cap") * 100, 1))
    rows = rows.select("id", "event_date", "won", F.coalesce("score", F.lit(0.0)).alias("alpha_score"), size.alias("materiality_pct"), "vol_z_score", F.coalesce("boosted", F.lit(1.0)).alias("election_mult"))
    path = landing_dir(t.spark, "panel")
    with dropped_shuffles(t.spark):
        rows.write.parquet(path)
    if not steps:
        own.at.remove()
    return t.spark.read.schema(rows.schema).parquet(path)


def _folds(t) -> DataFrame:
    return stats.folds(panel(t), ["event_date", "id"])


@query(f"{PANEL} SELECT id, event_date, won, alpha_score, materiality_pct, vol_z_score, election_mult FROM panel", G_)
def training_panel(t):
    return panel(t)


@query(
    f"""{PANEL}, x AS (SELECT won::INT AS y, unnest(['alpha_score', 'materiality_pct', 'vol_z_score', 'election_mult']) AS feature, unnest([alpha_score, materiality_pct, vol_z_score, election_mult]) AS cut FROM panel),
b AS (SELECT feature, cut, 0.5 * count(*) - sum(y) AS g, 0.25 * count(*) AS h FROM x GROUP BY 1, 2), t AS (SELECT feature, sum(g) AS g0, sum(h) AS h0 FROM b GROUP BY 1),
s AS (SELECT feature, cut, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM b WHERE cut IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY cut)),
r AS (SELECT feature, cut, gl, hl, g0, h0, g0 - gl AS gr, h0 - hl AS hr FROM s JOIN t USING (feature))
SELECT feature, cut, round(pow(greatest(abs(gl) - 1, 0), 2) / (hl + 5) + pow(greatest(abs(gr) - 1, 0), 2) / (hr + 5) - pow(greatest(abs(g0) - 1, 0), 2) / (h0 + 5), 6) AS gain FROM r WHERE hl >= 1 AND hr >= 1""",
    G_,
)
def split_gains(t):
    """Every split that the first tree's root may take, with its gain under both penalties."""
    return boosting.first_gains(panel(t), FEATURES, "won").withColumn("gain", F.round("gain", 6))


@query()
def gbt_walk_forward(t):
    return boosting.walk_forward(_folds(t), FEATURES, "won").withColumn("accuracy", F.round("accuracy", 6))


@query()
def gbt_importance(t):
    return boosting.importance(panel(t), FEATURES, "won").withColumn("gain", F.round("gain", 4))


@query()
def grid_search(t):
    """All 324 settings."""
    return boosting.grid_search(_folds(t), FEATURES, "won").withColumn("accuracy", F.round("accuracy", 6))


SECTORS = f"""WITH {CONNECTIONS}{TOP}, {RET}, b AS (SELECT sector, 100.0 * avg(CASE WHEN coalesce(score >= 0.75, false) THEN 1.0 ELSE 0 END) FILTER (NOT in_watchlist) AS control FROM companies LEFT JOIN top USING (scrip_code) GROUP BY 1),
v AS (SELECT sector, 100.0 * avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS won FROM ret JOIN companies USING (scrip_code) WHERE days = 90 GROUP BY 1)"""


@query(
    f"""{SECTORS} SELECT sector, round(control, 4) AS control_rate, round(won, 4) AS win_rate, CASE WHEN coalesce(control < 50, false) AND coalesce(won >= 55, false) THEN 'SIGNAL VALIDATED (RULES ONLY)' ELSE 'SIGNAL NEEDS REVIEW' END AS verdict FROM b LEFT JOIN v USING (sector)""",
    G_,
)
def verdicts(t):
    """By sector, from its own base rate and win rate; no model is trained for a sector alone, which counts as failed."""
    top = graph.top_connections(_connections(t)).select("scrip_code", (F.col("score") >= 0.75).alias("linked"))
    control = t.companies.join(top, "scrip_code", "left").groupBy("sector").agg((100 * F.avg(F.when(~F.col("in_watchlist"), F.coalesce("linked", F.lit(False)).cast("double")))).alias("control"))
    ret = events.forward_returns(t.announcements.filter("is_contract"), t.prices).filter("days = 90")
    won = ret.join(t.companies.select("scrip_code", "sector"), "scrip_code").groupBy("sector").agg((100 * F.avg((F.col("ret") > 0).cast("double"))).alias("won"))
    rows = control.join(won, "sector", "left")
    return rows.select("sector", F.round("control", 4).alias("control_rate"), F.round("won", 4).alias("win_rate"), stats.verdict(F.col("control") < 50, F.col("won") >= 55, F.lit(None).cast("boolean")).alias("verdict"))


@query()
def overall_verdict(t):
    """One row: the base rate of companies that aren't watched, the win rate, the model's accuracy over its folds, and what they come to."""
    from tidemark.plans import models, state

    steps, at = Steps(t), Landed(t.spark, "verdict")
    base = at.stored(state.base_rate_differential(t, steps.top).select("control", "meaningful"))
    wins = at.stored(models.win_rate_boosted(t, steps.ret, steps.top).select("win_rate_pct", F.col("viable").alias("win_viable")))
    with dropped_shuffles(t.spark):
        told = boosting.walk_forward(stats.folds(panel(t, steps), ["event_date", "id"]), FEATURES, "won").withColumn("accuracy", F.round("accuracy", 6))
    model = told.agg(F.round(100 * F.avg("accuracy"), 2).alias("accuracy_pct"), (F.avg("accuracy") > 0.55).alias("model_viable"))
    out = base.crossJoin(F.broadcast(wins)).crossJoin(F.broadcast(model))  # a row each
    out = out.select("control", "win_rate_pct", "accuracy_pct", stats.verdict(F.col("meaningful"), F.col("win_viable"), F.col("model_viable")).alias("verdict"))
    out = t.spark.createDataFrame(out.collect(), out.schema)
    steps.at.remove()
    at.remove()
    return out
