"""Tables that change from run to run: upserts, held positions, flags, closed trades; each result is the new table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import graph, keyed, portfolio, signals, tables
from tidemark.plans.catalog import CHAIN, CONNECTIONS, GRAPH, TOP, _connections, _graph, query
from tidemark.sources.landing import landing_dir

TODAY = "2001-11-04"


def _day():
    return F.lit(TODAY).cast("date")

KEYS = ["donor_name", "trust_name", "donated", "source"]


#: The donors as they were: of seven rows four, the amounts smaller, the party and the cin others where they are known, one of three rows of another source.
DONORS_OLD = """SELECT seq, donor_name, trust_name, donated, CASE seq % 3 WHEN 0 THEN 'old' ELSE source END AS source, amount * 2 AS amount, concat('was ', party) AS party, CASE WHEN donor_cin IS NOT NULL AND seq % 2 = 0 THEN concat('was ', donor_cin) END AS donor_cin
FROM {donors} WHERE seq % 7 < 4"""


@query(
    f"""WITH od AS ({DONORS_OLD.format(donors="donors")}), al AS (SELECT 0 AS age, * FROM od UNION ALL SELECT 1, seq, donor_name, trust_name, donated, source, amount, party, donor_cin FROM donors)
SELECT donor_name, trust_name, donated, source, arg_max(amount, (age, seq)) AS amount, arg_max(party, (age, seq)) AS party, arg_max(donor_cin, (age, seq)) FILTER (donor_cin IS NOT NULL) AS donor_cin FROM al WHERE trust_name IS NOT NULL GROUP BY 1, 2, 3, 4
UNION ALL SELECT donor_name, trust_name, donated, source, amount, party, donor_cin FROM al WHERE trust_name IS NULL""",
    ("donors",),
)
def donor_upsert(t):
    """New rows over old ones that differ in value: the last amount and party stand, a cin that is missing now stays as it was, a null trust matches nothing."""
    old = t.spark.sql(DONORS_OLD, donors=t.donors)
    return tables.merge_null_never_equal(old, t.donors, KEYS, "seq", coalesced=("donor_cin",)).drop("seq")


@query(
    f"""WITH od AS ({DONORS_OLD.format(donors="donors")}), al AS (SELECT 0 AS age, * FROM od UNION ALL SELECT 1, seq, donor_name, trust_name, donated, source, amount, party, donor_cin FROM donors WHERE donor_name IN (SELECT max(donor_name) FROM donors) OR seq = (SELECT min(seq) FROM donors))
SELECT donor_name, trust_name, donated, source, arg_max(amount, (age, seq)) AS amount, arg_max(party, (age, seq)) AS party FROM al WHERE trust_name IS NOT NULL GROUP BY 1, 2, 3, 4 UNION ALL SELECT donor_name, trust_name, donated, source, amount, party FROM al WHERE trust_name IS NULL""",
    ("donors",),
)
def donor_merge(t):
    """One donor's new rows, and the first donation's, merged into a stored table in buckets, of which only theirs are read and written."""
    table = keyed.Keyed(t.spark, landing_dir(t.spark, "donors"), KEYS)
    one = lambda old, new: tables.merge_null_never_equal(old, new, KEYS, "seq", coalesced=("donor_cin",))
    table.merge(t.spark.sql(DONORS_OLD, donors=t.donors), one)
    last = t.donors.agg(F.max("donor_name").alias("n"), F.min("seq").alias("s"))
    new = t.donors.join(F.broadcast(last), (F.col("donor_name") == F.col("n")) | (F.col("seq") == F.col("s")), "left_semi")
    table.merge(new, one)
    return table.read(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.donors.schema.fields)).select("donor_name", "trust_name", "donated", "source", "amount", "party")


@query("SELECT din, count(*) AS n, min(name) AS name FROM (SELECT CASE WHEN l_partkey % 10 = 0 THEN '' ELSE l_partkey::VARCHAR END AS din, l_suppkey::VARCHAR || ' ' || l_linenumber::VARCHAR AS name, l_suppkey AS cin FROM lineitem) WHERE din <> '' GROUP BY 1")
def director_rows_with_din(t):
    rows = t.lineitem.select(F.when(F.col("l_partkey") % 10 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("din"), F.concat_ws(" ", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"))
    return rows.filter("din <> ''").groupBy("din").agg(F.count("name").alias("n"), F.min("name").alias("name"))


# --- held positions --------------------------------------------------------------------------------------------------

HELD = """h AS (SELECT scrip_code, alpha_score, alert_date, alert_date + 180 AS expires FROM held),
al AS (SELECT scrip_code, max(value) / 100000 AS alpha_score, max(event_date) AS alert_date FROM announcements WHERE is_contract GROUP BY 1),
hp AS (SELECT coalesce(al.scrip_code, h.scrip_code) AS scrip_code, CASE WHEN al.scrip_code IS NOT NULL THEN al.alpha_score ELSE h.alpha_score END AS alpha_score,
  CASE WHEN al.scrip_code IS NOT NULL THEN al.alert_date ELSE h.alert_date END AS alert_date, CASE WHEN al.scrip_code IS NOT NULL THEN al.alert_date + 180 ELSE h.expires END AS expires FROM h FULL JOIN al ON h.scrip_code = al.scrip_code)"""
H_ = ("held", "announcements")


def _held(t):
    old = t.held.select("scrip_code", "alpha_score", "alert_date", F.date_add("alert_date", 180).alias("expires"))
    new = t.announcements.filter("is_contract").groupBy("scrip_code").agg((F.max("value") / 100000).alias("alpha_score"), F.max("event_date").alias("alert_date"))
    return tables.hold(old, new)


@query(f"WITH {HELD} SELECT scrip_code, round(alpha_score, 6) AS alpha_score, alert_date, expires::DATE AS expires FROM hp", H_)
def held_upsert(t):
    return _held(t).select("scrip_code", F.round("alpha_score", 6).alias("alpha_score"), "alert_date", "expires")


@query(f"WITH {HELD} SELECT scrip_code FROM hp WHERE expires > DATE '{TODAY}'", H_)
def held_current(t):
    return tables.expired(_held(t), _day())[0].select("scrip_code")


@query(f"WITH {HELD} SELECT count(*) FILTER (expires <= DATE '{TODAY}') AS removed FROM hp", H_)
def held_expired_count(t):
    return tables.expired(_held(t), _day())[1]


COMMANDS = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '/exit ' || c_custkey::VARCHAR WHEN 1 THEN '/EXIT   ' || (c_custkey * 2)::VARCHAR || ' please' ELSE 'hello /exit 5' END AS text FROM customer"


@query(f"WITH {HELD}, cm AS ({COMMANDS}), x AS (SELECT split_part(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ', 2) AS scrip_code FROM cm WHERE starts_with(lower(trim(text)), '/exit')) SELECT scrip_code, expires::DATE AS expires FROM hp WHERE scrip_code NOT IN (SELECT scrip_code FROM x WHERE scrip_code <> '')", H_)
def held_exit_commands(t):
    k = F.col("c_custkey")
    said = t.customer.select(F.when(k % 3 == 0, F.concat(F.lit("/exit "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("/EXIT   "), (k * 2).cast("string"), F.lit(" please"))).otherwise("hello /exit 5").alias("text"))
    asked = said.filter(F.lower(F.trim("text")).startswith("/exit")).select(F.try_element_at(F.split(F.trim("text"), r"\s+"), F.lit(2)).alias("scrip_code")).filter("scrip_code IS NOT NULL")
    return tables.removed(_held(t), asked, ["scrip_code"]).select("scrip_code", "expires")


# --- flags and values ------------------------------------------------------------------------------------------------


@query("SELECT scrip_code, name, false AS in_watchlist FROM companies", ("companies",))
def flags_cleared(t):
    return t.companies.select("scrip_code", "name", F.lit(False).alias("in_watchlist"))


@query("SELECT id, coalesce(is_contract AND value > 200000, false) OR id % 7 = 0 AS processed FROM announcements", ("announcements",))
def announcements_processed(t):
    rows = t.announcements.select("id", (F.col("id") % 7 == 0).alias("processed"))
    return tables.marked(rows, t.announcements.filter("is_contract AND value > 200000").select("id"), "id", "processed")


@query("SELECT id, CASE WHEN is_contract THEN round(value + 1, 2) ELSE value END AS value, CASE WHEN is_contract THEN region END AS state FROM announcements JOIN companies USING (scrip_code)", ("announcements", "companies"))
def contract_values_set(t):
    rows = t.announcements.select("id", "value", F.lit(None).cast("string").alias("state"))
    changes = t.announcements.filter("is_contract").join(t.companies.select("scrip_code", "region"), "scrip_code").select("id", F.round(F.col("value") + 1, 2).alias("value"), F.col("region").alias("state"))
    return tables.updated(rows, changes, "id")


@query("SELECT a.id, c.name, c.sector, a.event_date FROM announcements a JOIN companies c USING (scrip_code) WHERE a.is_contract AND a.id % 7 <> 0 ORDER BY a.event_date DESC, a.id", ("announcements", "companies"))
def unprocessed_contracts(t):
    rows = t.announcements.filter("is_contract AND id % 7 <> 0").join(t.companies, "scrip_code")
    return rows.select("id", "name", "sector", "event_date").orderBy(F.desc("event_date"), "id")


@query("SELECT scrip_code, deal_date, client, quantity, count(*) AS n FROM (SELECT scrip_code, deal_date, client, quantity FROM deals WHERE side = 'BUY' UNION ALL SELECT scrip_code, deal_date, client, quantity FROM deals WHERE side = 'BUY' AND seq % 5 = 0) GROUP BY 1, 2, 3, 4", ("deals",))
def deals_appended(t):
    rows = t.deals.filter("side = 'BUY'").select("seq", "scrip_code", "deal_date", "client", "quantity")
    return rows.unionByName(rows.filter("seq % 5 = 0")).groupBy("scrip_code", "deal_date", "client", "quantity").agg(F.count("seq").alias("n"))


@query("SELECT tender_id, CASE WHEN tender_id % 2 = 0 THEN 'was ' || min(winner) ELSE min(winner) END AS winner FROM tenders GROUP BY 1 UNION ALL SELECT -tender_id, min(winner) FROM tenders WHERE tender_id % 5 = 0 GROUP BY 1", ("tenders",))
def tender_insert_new(t):
    """What is there stays as it is, though the new row of its id says otherwise; only new ids are added."""
    first = t.tenders.groupBy("tender_id").agg(F.min("winner").alias("winner"))
    gone = first.filter("tender_id % 5 = 0").select((-F.col("tender_id")).alias("tender_id"), "winner")
    old = first.filter("tender_id % 2 = 0").select("tender_id", F.concat(F.lit("was "), "winner").alias("winner")).unionByName(gone)
    return tables.insert_absent(old, first, ["tender_id"])


@query(
    """WITH n AS (SELECT scrip_code, pledge_date, action, max(pledged) AS pledged FROM pledges GROUP BY 1, 2, 3), o AS (SELECT scrip_code, pledge_date, action, -pledged AS pledged FROM n WHERE pledge_date < DATE '1999-01-01' UNION ALL SELECT scrip_code, pledge_date, 'Revoked', pledged FROM n WHERE action = 'Released')
SELECT scrip_code, pledge_date, action, round(pledged, 4) AS pledged FROM o UNION ALL SELECT scrip_code, pledge_date, action, round(pledged, 4) FROM n ANTI JOIN o USING (scrip_code, pledge_date, action)""",
    ("pledges",),
)
def pledge_insert_new(t):
    """The same with a key of three columns, old values of the other sign, and old rows that no new one repeats."""
    keys = ["scrip_code", "pledge_date", "action"]
    new = t.pledges.groupBy(*keys).agg(F.max("pledged").alias("pledged"))
    old = new.filter("pledge_date < DATE '1999-01-01'").withColumn("pledged", -F.col("pledged")).unionByName(new.filter("action = 'Released'").withColumn("action", F.lit("Revoked")))
    return tables.insert_absent(old, new, keys).withColumn("pledged", F.round("pledged", 4))


# --- trades ----------------------------------------------------------------------------------------------------------

SOLD = """ps AS (SELECT scrip_code, event_date AS bought, value / 1000 AS buy_price, (id % 50 + 1)::BIGINT AS quantity, value / 1000 * (id % 50 + 1) AS invested, id FROM announcements WHERE is_contract),
lp AS (SELECT scrip_code, arg_max(close, trade_date) / 8 AS price, max(trade_date) AS day FROM prices GROUP BY 1),
y AS (SELECT *, price * 0.995::DOUBLE AS ex, price * 0.995::DOUBLE * quantity AS tn FROM ps JOIN lp USING (scrip_code)),
z AS (SELECT *, round(tn * 0.001::DOUBLE, 2) AS stt, round(tn * 0.0000325::DOUBLE, 2) AS txn, round(tn * 0.000001::DOUBLE, 2) AS sebi FROM y)"""


def _sold(t):
    held = t.announcements.filter("is_contract").select("id", "scrip_code", F.col("event_date").alias("bought"), (F.col("value") / 1000).alias("buy_price"), (F.col("id") % 50 + 1).alias("quantity"), (F.col("value") / 1000 * (F.col("id") % 50 + 1)).alias("invested"))
    quote = t.prices.groupBy("scrip_code").agg((F.max_by("close", "trade_date") / 8).alias("price"), F.max("trade_date").alias("day"))
    return portfolio.close_positions(held.join(quote, "scrip_code"))


@query(f"WITH {SOLD} SELECT scrip_code, bought, day AS sold, quantity, stt, 0.0::DOUBLE AS stamp, txn, 15.93::DOUBLE AS dp, round(tn - round(stt + txn + sebi + round((txn + sebi) * 0.18::DOUBLE, 2) + 15.93::DOUBLE, 2) - invested, 0) AS pnl FROM z", ("announcements", "prices"))
def positions_closed(t):
    return _sold(t).select("scrip_code", "bought", "sold", "quantity", "stt", "stamp", "txn", "dp", F.round("pnl", 0).alias("pnl"))


@query("SELECT scrip_code, count(*) AS n FROM announcements WHERE is_contract AND scrip_code NOT IN (SELECT scrip_code FROM companies WHERE in_watchlist) GROUP BY 1", ("announcements", "companies"))
def positions_left(t):
    sold = t.companies.filter("in_watchlist").select("scrip_code")
    return tables.removed(t.announcements.filter("is_contract").select("id", "scrip_code"), sold, ["scrip_code"]).groupBy("scrip_code").agg(F.count("id").alias("n"))


@query("SELECT scrip_code, event_date, id FROM (SELECT *, row_number() OVER (ORDER BY event_date DESC, id) AS k FROM announcements WHERE is_contract) WHERE k <= 200 ORDER BY event_date DESC, id", ("announcements",))
def history_newest(t):
    return t.announcements.filter("is_contract").select("scrip_code", "event_date", "id").orderBy(F.desc("event_date"), "id").limit(200)


@query("SELECT scrip_code, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY trade_date DESC) AS k FROM prices) WHERE k <= 130", ("prices",))
def chart_bars(t):
    return tables.last_rows(t.prices, "scrip_code", [F.desc("trade_date")], 130).select("scrip_code", "trade_date", "close")


# --- lookups, sums and caps ------------------------------------------------------------------------------------------


@query("SELECT donor_name, round(amount, 2) AS amount, donated FROM donors WHERE donor_cin = 'D7'", ("donors",))
def donors_by_cin(t):
    return t.donors.filter("donor_cin = 'D7'").select("donor_name", F.round("amount", 2).alias("amount"), "donated")


@query("SELECT b.din, d.name FROM company_boards b JOIN companies c USING (scrip_code) JOIN directors d USING (din) WHERE c.cin = 'L00000003'", ("company_boards", "companies", "directors"))
def directors_by_cin(t):
    return t.company_boards.join(t.companies.filter("cin = 'L00000003'").select("scrip_code"), "scrip_code").join(t.directors, "din").select("din", "name")


@query("SELECT DISTINCT scrip_code FROM announcements WHERE scrip_code IS NOT NULL", ("announcements",))
def codes_not_null(t):
    return t.announcements.filter("scrip_code IS NOT NULL").select("scrip_code").distinct()


@query("SELECT scrip_code FROM niches JOIN companies USING (scrip_code) WHERE NOT companies.in_watchlist AND niches.cin <> '' AND market_cap BETWEEN 50 AND 9000", ("companies", "niches"))
def control_group(t):
    caps = t.companies.filter("market_cap BETWEEN 50 AND 9000").select("scrip_code")
    return t.niches.filter("NOT in_watchlist AND cin <> ''").join(caps, "scrip_code", "left_semi").select("scrip_code")


@query("SELECT scrip_code FROM companies WHERE scrip_code NOT IN (SELECT scrip_code FROM company_boards) UNION ALL SELECT scrip_code FROM company_boards WHERE scrip_code IN (SELECT scrip_code FROM companies WHERE in_watchlist) GROUP BY 1", ("companies", "company_boards"))
def second_source_only(t):
    """Of two sources of candidates, the second gives only what the first hasn't found."""
    first = t.company_boards.join(t.companies.filter("in_watchlist"), "scrip_code", "left_semi").select("scrip_code").distinct()
    return first.unionByName(t.companies.select("scrip_code").join(t.company_boards.select("scrip_code").distinct(), "scrip_code", "left_anti"))


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[.\-,()''\"/\\]', ' ', 'g'), '\b(limited|ltd|pvt|private|public|incorporated|inc|llp|company|co|corporation|corp|and|&)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' LIMITED' ELSE '' END AS name, p_retailprice AS amount FROM part), s AS (SELECT name, sum(amount) AS total FROM d GROUP BY 1)
SELECT {NORM} AS norm, round(sum(total), 2) AS total, arg_min(name, {{'t': -round(total, 4), 'n': name}}) AS spelling FROM s GROUP BY 1 HAVING length({NORM}) > 2""")
def donor_totals_spelling(t):
    from tidemark.functions.text import normal_name

    k = F.col("p_partkey") % 3
    rows = t.part.select(F.concat("p_name", F.when(k == 0, " Ltd.").when(k == 1, " LIMITED").otherwise("")).alias("name"), F.col("p_retailprice").alias("amount"))
    by = rows.groupBy("name").agg(F.sum("amount").alias("total"))
    out = by.groupBy(normal_name(F.col("name")).alias("norm")).agg(F.round(F.sum("total"), 2).alias("total"), F.min_by("name", F.struct(-F.round("total", 4), "name")).alias("spelling"))
    return out.filter(F.length("norm") > 2)


@query("SELECT count(*) AS positions, round(coalesce(sum(value), 0), 2) AS pnl, count(*) FILTER (is_contract) AS contracts FROM announcements", ("announcements",))
def kpis(t):
    return t.announcements.agg(F.count("id").alias("positions"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("pnl"), F.count_if("is_contract").alias("contracts"))


@query("WITH s AS (SELECT donor, party, sum(amount) AS total FROM donations GROUP BY 1, 2) SELECT donor, arg_max(party, {'t': round(total, 4), 'p': party}) AS party, round(max(total), 2) AS total FROM s GROUP BY 1", ("donations",))
def main_party(t):
    by = t.donations.groupBy("donor", "party").agg(F.sum("amount").alias("total"))
    return by.groupBy("donor").agg(F.max_by("party", F.struct(F.round("total", 4), "party")).alias("party"), F.round(F.max("total"), 2).alias("total"))


LINK = f"{CONNECTIONS}{TOP}, x AS (SELECT in_watchlist AS w, coalesce(score >= 0.75, false) AS l FROM companies LEFT JOIN top USING (scrip_code))"


@query(f"WITH {LINK}, r AS (SELECT 100.0 * avg(CASE WHEN l THEN 1.0 ELSE 0 END) FILTER (w) AS a, 100.0 * avg(CASE WHEN l THEN 1.0 ELSE 0 END) FILTER (NOT w) AS b FROM x) SELECT round(a, 4) AS watched, round(b, 4) AS control, round(a - b, 4) AS differential, b < 50 AS meaningful FROM r", ("companies", *CHAIN))
def base_rate_differential(t, top=None):
    """top: the best connections, where the caller has them."""
    top = (top or graph.top_connections(_connections(t))).select("scrip_code", (F.col("score") >= 0.75).alias("linked"))
    rows = t.companies.join(top, "scrip_code", "left").select("in_watchlist", F.coalesce("linked", F.lit(False)).cast("double").alias("x"))
    rate = lambda c: 100 * F.avg(F.when(c, F.col("x")))
    r = rows.agg(rate(F.col("in_watchlist")).alias("a"), rate(~F.col("in_watchlist")).alias("b"))
    return r.select(F.round("a", 4).alias("watched"), F.round("b", 4).alias("control"), F.round(F.col("a") - F.col("b"), 4).alias("differential"), (F.col("b") < 50).alias("meaningful"))


#: Boards, and each donor's last donation: directed edges.
LINKS = """SELECT concat('c', scrip_code) AS src, concat('d', CAST(din AS STRING)) AS dst FROM {boards} UNION SELECT concat('o', CAST(donor AS STRING)), concat('d', CAST(din AS STRING)) FROM {donor_boards}
UNION SELECT concat('o', CAST(donor AS STRING)), concat('t', trust) FROM (SELECT donor, max_by(trust, id) AS trust FROM {donations} GROUP BY donor)"""


@query(
    f"""WITH l AS ({LINKS.format(boards="company_boards", donor_boards="donor_boards", donations="donations")}), b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
r AS (WITH RECURSIVE p AS (SELECT DISTINCT [src] AS path, src AS last, 0 AS length FROM b WHERE src LIKE 'c%' UNION ALL SELECT list_append(path, dst), dst, length + 1 FROM p JOIN b ON src = last WHERE length < 5 AND NOT list_contains(path, dst)) SELECT * FROM p)
SELECT array_to_string(path, '>') AS path, length FROM r WHERE last LIKE 't%'""",
    CHAIN,
)
def paths_to_trusts(t):
    """Every simple path of up to five edges from a company to a trust, from both ends."""
    edges = t.spark.sql(LINKS, boards=t.company_boards, donor_boards=t.donor_boards, donations=t.donations)
    starts = t.company_boards.select(F.concat(F.lit("c"), "scrip_code").alias("id"))
    ends = t.donations.select(F.concat(F.lit("t"), "trust").alias("id"))
    return graph.paths_between(edges, starts, ends, 5).select(F.array_join("path", ">").alias("path"), "length")


@query(f"WITH {CONNECTIONS}{TOP} SELECT scrip_code, score FROM top ORDER BY score DESC, scrip_code", CHAIN)
def connections_ordered(t):
    return graph.top_connections(_connections(t)).select("scrip_code", "score").orderBy(F.desc("score"), "scrip_code")


@query("SELECT scrip_code, count(*) AS n FROM announcements WHERE is_contract GROUP BY 1 ORDER BY n DESC, scrip_code", ("announcements",))
def contract_count_order(t):
    return t.announcements.filter("is_contract").groupBy("scrip_code").agg(F.count("id").alias("n")).orderBy(F.desc("n"), "scrip_code")


@query("SELECT scrip_code FROM announcements GROUP BY 1 ORDER BY min(id) LIMIT 150", ("announcements",))
def first_150(t):
    """The cap on companies of a run, in order of arrival."""
    return t.announcements.groupBy("scrip_code").agg(F.min("id").alias("at")).orderBy("at").limit(150).select("scrip_code")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT din FROM company_boards) ORDER BY 1 LIMIT 200", ("company_boards",))
def missing_200(t):
    """The cap on look-ups of a run: of the directors without a known board the first."""
    return t.part.select("p_partkey").join(t.company_boards.select(F.col("din").alias("p_partkey")).distinct(), "p_partkey", "left_anti").orderBy("p_partkey").limit(200)


@query("SELECT DISTINCT donor_name FROM donors", ("donors",))
def donor_names(t):
    return t.donors.select("donor_name").distinct()


@query(f"WITH {CONNECTIONS} SELECT scrip_code, din, donor, trust FROM (SELECT b.scrip_code, b.din, d.donor, e.trust, row_number() OVER (PARTITION BY b.scrip_code, b.din, d.donor ORDER BY e.first_id) AS k FROM company_boards b JOIN donor_boards d USING (din) JOIN edges e USING (donor)) WHERE k = 1", CHAIN)
def paths_first_trust(t):
    """Of a director's and donor's paths over several trusts the first, by the order in which the trusts came."""
    edges = graph.last_donations(t.donations)
    rows = t.company_boards.join(t.donor_boards, "din").join(edges, "donor")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("scrip_code", "din", "donor").orderBy("first_id")))
    return first.filter("k = 1").select("scrip_code", "din", "donor", "trust")


@query("""WITH td AS (SELECT 'tender:' || tender_id AS id, strftime(awarded, '%Y-%m-%d') AS day FROM tenders), te AS (SELECT 'tender:' || tender_id AS src, 'company:' || s AS dst FROM (SELECT tender_id, (tender_id % 10)::VARCHAR AS s FROM tenders WHERE tender_id % 2 = 0)),
kept AS (SELECT id FROM td WHERE NOT (day < '1999-11-15')), v AS (SELECT id FROM kept UNION SELECT 'company:' || scrip_code FROM companies), e AS (SELECT * FROM te WHERE src IN (SELECT id FROM kept)) SELECT id FROM v WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)""", ("tenders", "companies"))
def graph_prune_tenders(t):
    """Tenders of over 24 months of 30 days go first, by their day as a string, then vertices without an edge."""
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    v = t.tenders.select(node("tender", "tender_id").alias("id"), F.lit("Tender").alias("kind"), F.date_format("awarded", "yyyy-MM-dd").alias("day"))
    v = v.unionByName(t.companies.select(node("company", "scrip_code").alias("id"), F.lit("ListedCompany").alias("kind"), F.lit("").alias("day")))
    e = t.tenders.filter("tender_id % 2 = 0").select(node("tender", "tender_id").alias("src"), F.concat(F.lit("company:"), (F.col("tender_id") % 10).cast("string")).alias("dst"), F.lit("WON").alias("kind"))
    old = v.filter(F.col("kind").eqNullSafe("Tender") & (F.col("day") != "") & (F.col("day") < F.date_format(F.date_sub(_day(), 24 * 30), "yyyy-MM-dd"))).select("id")
    v, e = v.join(old, "id", "left_anti"), e.join(old.select(F.col("id").alias("src")), "src", "left_anti").join(old.select(F.col("id").alias("dst")), "dst", "left_anti")
    return graph.pruned(v, e).select("id")


def _funnel_sql(least: int) -> str:
    return f"""WITH a AS (SELECT scrip_code, scrip_code::INT AS arrived, market_cap, 'sector' AS source, 0 AS turn FROM companies WHERE sector < 'NATION_2'
  UNION ALL SELECT scrip_code, scrip_code::INT, market_cap, 'donor', 1 FROM companies WHERE scrip_code::BIGINT IN (SELECT donor FROM donations) AND NOT sector < 'NATION_2'),
n AS (SELECT scrip_code, count(*) AS contracts FROM announcements WHERE is_contract GROUP BY 1), b AS (SELECT a.*, contracts FROM a LEFT JOIN n USING (scrip_code) WHERE market_cap BETWEEN 50 AND 1000000),
c AS (SELECT * FROM b WHERE source = 'donor' OR contracts >= {least}), d AS (SELECT * FROM c UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c))
SELECT scrip_code, source, arrived FROM d LEFT JOIN fundamentals f USING (scrip_code) WHERE NOT (coalesce(de > 5, false) OR coalesce(ocf < 0, false) OR (de IS NULL AND ocf IS NULL)) ORDER BY turn, arrived LIMIT 150"""


def _funnel(t, donors):
    candidate = lambda d: d.select("scrip_code", F.col("scrip_code").cast("int").alias("arrived"), "market_cap")
    n = t.announcements.filter("is_contract").groupBy("scrip_code").agg(F.count("id").alias("contracts"))
    return signals.watchlist(candidate(t.companies.filter("sector < 'NATION_2'")), candidate(donors), n, t.fundamentals)


@query(_funnel_sql(1), ("companies", "donations", "announcements", "fundamentals"))
def watchlist_gated(t):
    given = t.donations.select(F.col("donor").cast("string").alias("scrip_code")).distinct()
    return _funnel(t, t.companies.join(given, "scrip_code", "left_semi"))


@query(_funnel_sql(1).replace("scrip_code::BIGINT IN (SELECT donor FROM donations)", "false").replace("WHERE is_contract", "WHERE is_contract AND value < 0"), ("companies", "announcements", "fundamentals"))
def watchlist_fallback(t):
    """Nobody has a contract, so all of the band go on."""
    none = t.announcements.filter("is_contract AND value < 0").groupBy("scrip_code").agg(F.count("id").alias("contracts"))
    candidate = t.companies.filter("sector < 'NATION_2'").select("scrip_code", F.col("scrip_code").cast("int").alias("arrived"), "market_cap")
    return signals.watchlist(candidate, candidate.filter("false"), none, t.fundamentals)


@query(f"WITH {GRAPH} SELECT 'vertices' AS what, kind, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'edges', kind, count(*) FROM e GROUP BY 2", ("companies", *CHAIN))
def graph_written(t):
    """The graph stored as two tables, and read again."""
    home, told = landing_dir(t.spark, "graph"), None
    for what, rows in zip(("vertices", "edges"), _graph(t), strict=True):
        rows.write.parquet(f"{home}/{what}")
        step = t.spark.read.schema(rows.schema).parquet(f"{home}/{what}").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
        told = step if told is None else told.unionByName(step)
    return told


@query("SELECT event_type AS module, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1 UNION ALL SELECT 'run', 2, NULL")
def event_log(t):
    """Two runs append what happened to one log; nothing is replaced."""
    home = landing_dir(t.spark, "log")
    for run in range(2):
        rows = t.events.filter(F.col("event_id") % 2 == run).select(F.col("event_type").alias("module"), "event_id")
        rows.unionByName(t.spark.createDataFrame([("run", None)], "module string, event_id long")).write.mode("append").parquet(home)
    log = t.spark.read.schema("module string, event_id long").parquet(home)
    return log.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
