"""Inference, model evaluation and what it all comes to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.answers import answered
from tidemark.operators import entity, graph, stats
from tidemark.operators.similarity import stored
from tidemark.plans.catalog import BM, C_, CAR, CONNECTIONS, G_, LINKED, RET, TOP, WELCH, _car, _connections, _excess, _linked, _soon, query
from tidemark.sources.landing import landing_dir
from tidemark.streaming import streams

#: The two-sided p-value of t with df degrees of freedom as a ratio of integrals of cos(x) ** (df - 1), by the midpoint rule.
P = "(SELECT sum(pow(greatest(cos(atan(abs({t}) / sqrt({df})) + (i + 0.5) * (pi() / 2 - atan(abs({t}) / sqrt({df}))) / 40000), 0), {df} - 1)) * (1 - atan(abs({t}) / sqrt({df})) * 2 / pi()) / sum(pow(cos((i + 0.5) * pi() / 80000), {df} - 1)) FROM range(40000) r(i))"


@query(
    f"""WITH {LINKED}, {RET}{BM}, x AS (SELECT days, excess, coalesce(linked, false) AS linked FROM ex LEFT JOIN link USING (scrip_code)),
s AS (SELECT days, count(*) FILTER (linked) AS n1, count(*) FILTER (NOT linked) AS n0, avg(excess) FILTER (linked) - avg(excess) FILTER (NOT linked) AS d, {WELCH[0]} AS a, {WELCH[1]} AS b FROM x GROUP BY 1),
w AS (SELECT *, n1 >= 2 AND n0 >= 2 AND coalesce(a + b > 0, false) AS ok, d / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)) AS df FROM s)
SELECT days, n1, n0, CASE WHEN ok THEN round(t, 4) ELSE 0 END AS t, CASE WHEN ok THEN round({P.format(t="w.t", df="w.df")}, 4) ELSE 1 END AS p FROM w""",
    G_,
)
def return_inference(t):
    rows = _excess(t).join(_linked(t), "scrip_code", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return stats.welch(rows, "days", "linked", "excess").select("days", "n1", "n0", F.round("t", 4).alias("t"), F.round(stats.p_value("t", "df"), 4).alias("p"))


@query(
    f"""WITH {CAR}, s AS (SELECT pre, post, count(*) AS n, avg(car) AS m, stddev_samp(car) AS d FROM car GROUP BY 1, 2), w AS (SELECT *, n >= 2 AND coalesce(d > 0, false) AS ok, m / (d / sqrt(n)) AS t FROM s)
SELECT pre, post, n, round(m, 4) AS mean, CASE WHEN ok THEN round(t, 4) ELSE 0 END AS t, CASE WHEN ok THEN round({P.format(t="w.t", df="(w.n - 1)")}, 4) ELSE 1 END AS p FROM w""",
    C_,
)
def car_inference(t):
    out = stats.one_sample(_car(t).withColumn("w", F.struct("pre", "post")), "w", "car")
    return out.select("w.pre", "w.post", "n", F.round("mean", 4).alias("mean"), F.round("t", 4).alias("t"), F.round(stats.p_value("t", "df"), 4).alias("p"))


PANEL = """x AS (SELECT excess AS y, coalesce(score, 0) AS a, CASE WHEN market_cap > 0 THEN ln(market_cap) ELSE 0 END AS b FROM ex JOIN companies USING (scrip_code) LEFT JOIN top USING (scrip_code) WHERE days = 90),
s AS (SELECT count(*)::DOUBLE AS n, covar_pop(a, a) AS s11, covar_pop(b, b) AS s22, covar_pop(a, b) AS s12, covar_pop(a, y) AS s1, covar_pop(b, y) AS s2, covar_pop(y, y) AS sy, avg(a) AS m1, avg(b) AS m2, avg(y) AS my FROM x),
c AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
r AS (SELECT *, (b1 * s1 + b2 * s2) / sy AS r2 FROM c), v AS (SELECT *, n * sy * (1 - r2) / (n - 3) AS s2e, (r2 / 2) / ((1 - r2) / (n - 3)) AS f FROM r),
terms AS (SELECT 'const' AS term, my - b1 * m1 - b2 * m2 AS coef, sqrt(s2e / n * (1 + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS se, n, r2, f FROM v
  UNION ALL SELECT 'a', b1, sqrt(s2e * s22 / (n * det)), n, r2, f FROM v UNION ALL SELECT 'b', b2, sqrt(s2e * s11 / (n * det)), n, r2, f FROM v)"""


@query(
    f"""WITH {LINKED}, {RET}{BM}, {PANEL} SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 3) AS t, round({P.format(t="(terms.coef / terms.se)", df="(terms.n - 3)")}, 3) AS p,
n::BIGINT AS n, round(r2, 4) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 4) AS adj_r2, round(f, 3) AS f, round(pow(1 + 2 * f / (n - 3), -(n - 3) / 2), 4) AS f_p FROM terms""",
    G_,
)
def ols_inference(t):
    rows = _excess(t).filter("days = 90").join(t.companies, "scrip_code").join(graph.top_connections(_connections(t)).select("scrip_code", "score"), "scrip_code", "left")
    rows = rows.select(F.col("excess").alias("y"), F.coalesce("score", F.lit(0.0)).alias("a"), F.when(F.col("market_cap") > 0, F.log("market_cap")).otherwise(0.0).alias("b"))
    out = stats.ols2_inference(rows, "y", "a", "b")
    return out.select("term", *[F.round(c, k).alias(c) for c, k in (("coef", 4), ("se", 4), ("t", 3), ("p", 3))], "n", *[F.round(c, k).alias(c) for c, k in (("r2", 4), ("adj_r2", 4), ("f", 3), ("f_p", 4))])


@query(
    f"""WITH {CONNECTIONS}{TOP}, {RET}, w AS (SELECT ret > 0 AS won, s.party IS NOT NULL AS boosted FROM ret LEFT JOIN top USING (scrip_code) LEFT JOIN soon s ON s.party = top.party WHERE days = 90)
SELECT count(*) AS signals, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, count(*) FILTER (won AND boosted) AS boosted_wins, round(100.0 * count(*) FILTER (won) / count(*), 1) AS win_rate_pct, 100.0 * count(*) FILTER (won) / count(*) >= 55 AS viable FROM w""",
    G_,
)
def win_rate_boosted(t, ret=None, top=None):
    """ret, top: the returns after 90 days and the best connections, where the caller has them."""
    from tidemark.operators import events

    rows = ret or events.forward_returns(t.announcements.filter("is_contract"), t.prices).filter("days = 90")
    top = (top or graph.top_connections(_connections(t))).select("scrip_code", "party").join(F.broadcast(_soon(t).withColumn("boosted", F.lit(True))), "party", "left").select("scrip_code", "boosted")
    rows = rows.join(top, "scrip_code", "left").select((F.col("ret") > 0).alias("won"), F.coalesce("boosted", F.lit(False)).alias("boosted"))
    wins = F.count_if("won")
    rate = 100.0 * wins / F.count("won")
    return rows.agg(F.count("won").alias("signals"), wins.alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.count_if(F.col("won") & F.col("boosted")).alias("boosted_wins"), F.round(rate, 1).alias("win_rate_pct"), (rate >= 55).alias("viable"))


@query(
    """WITH r AS (SELECT c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'C' || c_custkey::VARCHAR END AS cin FROM customer)
SELECT d.donor_name, count(*) AS n, count(coalesce(r.cin, d.donor_cin)) AS with_cin FROM donors d JOIN r ON r.c_name = d.donor_name GROUP BY 1""",
    ("donors",),
)
def donors_resolved(t):
    """Every donor's company by its name, written back: a company without a cin leaves the donor's own."""
    register = t.customer.select(F.col("c_name").alias("name"), F.lit(1.0).alias("weight"), F.col("c_custkey").alias("seq"))
    told = entity.resolve(t.donors.select(F.col("donor_name").alias("name")).distinct(), register)
    cins = t.customer.select(F.col("c_name").alias("match"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("cin"))
    found = told.join(cins, "match").select(F.col("name").alias("donor_name"), "cin")
    rows = t.donors.join(found, "donor_name", "left").withColumn("donor_cin", F.coalesce("cin", "donor_cin"))
    return rows.groupBy("donor_name").agg(F.count("seq").alias("n"), F.count("donor_cin").alias("with_cin"))


# --- streams and models ----------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT scrip_code, event_date, id, CASE WHEN event_date - lag(event_date) OVER w <= 180 THEN 0 ELSE 1 END AS f FROM announcements WHERE is_contract WINDOW w AS (PARTITION BY scrip_code ORDER BY event_date, id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY scrip_code ORDER BY event_date, id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT scrip_code, min(event_date)::TIMESTAMP AS since, max(event_date)::TIMESTAMP + INTERVAL 180 DAY AS expires, count(*) AS alerts FROM g GROUP BY scrip_code, s""",
    ("announcements",),
)
def held_spans(t):
    return streams.held_spans(t.announcements.filter("is_contract").select("scrip_code", F.col("event_date").cast("timestamp").alias("ts")))


@query("SELECT event_type, count(*) AS n, 'first' AS poll FROM events GROUP BY 1 UNION ALL SELECT 'never', 0, 'first' UNION ALL SELECT DISTINCT event_type, 0, 'second' FROM events UNION ALL SELECT 'never', 0, 'second'")
def poll_heartbeat(t):
    """Two polls of the landed events: the second finds nothing new, and says so."""
    home = landing_dir(t.spark, "heartbeat")
    kinds = t.events.select("event_type").distinct().unionByName(t.spark.createDataFrame([("never",)], "event_type string"))
    for _ in range(2):
        streams.polled(streams.landed(t.spark, t.sf_dir, "events"), kinds, "event_type", f"{home}/out", f"{home}/state")
    rows = streams.stored_batches(t.spark, f"{home}/out", "event_type string, n long, batch long")
    return rows.groupBy("event_type", F.when(F.col("batch") < 0, "second").otherwise("first").alias("poll")).agg(F.sum("n").alias("n"))


@query("SELECT id, value > 250000 AS material, CASE WHEN value > 250000 THEN round(value / 1000, 2) ELSE 0 END AS crore FROM announcements WHERE is_contract", ("announcements",))
def model_answers(t):
    """A rule in the place of a model: it answers in fenced JSON, and says nothing of small contracts."""

    def model(prompts: list[str]) -> list[str | None]:
        return [f'```json\n{{"material": true, "crore": {float(p) / 1000}}}\n```' if float(p) > 250000 else None for p in prompts]

    rows = t.announcements.filter("is_contract").select("id", F.col("value").cast("string").alias("prompt"))
    told = answered(rows, "prompt", model, "material boolean, crore double", '{"material": false, "crore": 0.0}')
    return told.select("id", "answer.material", F.round("answer.crore", 2).alias("crore"))


@query(
    """WITH e AS (SELECT scrip_code, event_date, CASE WHEN event_date - lag(event_date) OVER w <= 180 THEN 0 ELSE 1 END AS f FROM announcements WHERE is_contract WINDOW w AS (PARTITION BY scrip_code ORDER BY event_date, id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY scrip_code ORDER BY event_date ROWS UNBOUNDED PRECEDING) AS s FROM e),
h AS (SELECT scrip_code, min(event_date)::TIMESTAMP AS since, max(event_date)::TIMESTAMP + INTERVAL 180 DAY AS expires, count(*) AS alerts FROM g GROUP BY scrip_code, s)
SELECT * FROM h WHERE expires < (SELECT max(event_date) FROM announcements WHERE is_contract)""",
    ("announcements",),
)
def held_stream(t):
    """Contract announcements landed by year, read as a stream of a batch a year, stopped half-way and started anew: what has run out by the newest one."""
    from tidemark.streaming import held

    home = landing_dir(t.spark, "held")
    rows = t.announcements.filter("is_contract").select("scrip_code", F.col("event_date").cast("timestamp").alias("ts"))
    rows = stored(rows, "alerts")  # read for each year
    first, last = rows.agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, held.PROVIDER)
    try:
        half = (first + last) // 2
        for years in (range(first, half + 1), range(half + 1, last + 1)):
            for y in years:
                rows.filter(F.year("ts") == y).coalesce(1).write.mode("append").parquet(f"{home}/in")
            stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
            streams.drained(held.expiring(stream), f"{home}/out", f"{home}/state")
    finally:
        t.spark.conf.set(name, before)
    return t.spark.read.schema("scrip_code string, since timestamp, expires timestamp, alerts long").parquet(f"{home}/out")
