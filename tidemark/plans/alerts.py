"""Alerts: what happened to a company, held against its connections; and the tracked investors behind purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.params import STAR
from tidemark.operators import entity, graph, signals
from tidemark.plans.catalog import CHAIN, CONNECTIONS, NEW, STAR_NAMES, TOP, TRACKED, TRACKED_BUYS, _connections, _literal, _tracked, _values, query

LEAST = STAR.alpha_threshold


def _top(t):
    return graph.top_connections(_connections(t)).select("scrip_code", "score")


# --- tracked investors -----------------------------------------------------------------------------------------------

@query(f"WITH {TRACKED} SELECT client, why FROM tr WHERE why IS NOT NULL", ("bulk_deals",))
def tracked_clients(t):
    return _tracked(t)


@query(f"WITH {TRACKED_BUYS} SELECT scrip_code FROM tb", ("bulk_deals",))
def tracked_recent_buy(t):
    return signals.tracked_buys(t.bulk_deals, _tracked(t))


@query(f"SELECT seq, scrip_code, investor, round(holding_pct, 4) AS holding_pct FROM holdings WHERE regexp_matches(upper(investor), '{STAR_NAMES}')", ("holdings",))
def tracked_holdings(t):
    return t.holdings.filter(signals.bears_tracked_name(F.col("investor"))).select("seq", "scrip_code", "investor", F.round("holding_pct", 4).alias("holding_pct"))


@query(f"WITH {NEW} SELECT scrip_code FROM ne", ("holdings",))
def superstar_new_entry(t):
    return signals.new_entries(t.holdings)


# --- alerts ----------------------------------------------------------------------------------------------------------

A_ = ("companies", "niches", *CHAIN)
STRONG = f"{CONNECTIONS}{TOP}, strong AS (SELECT scrip_code, score FROM top WHERE score >= {LEAST})"
POLICIES = [(1, "Power ASIA"), (2, "nation_1"), (3, "rail europe"), (4, "africa nation_5 roads"), (5, "")]


def _watched(t):
    return t.niches.filter("in_watchlist AND cin <> '' AND niche <> '' AND niche <> 'unknown'").select("scrip_code", "niche")


@query(f"""WITH {STRONG} SELECT p.id::BIGINT AS id, scrip_code, score FROM {_literal(POLICIES, "id, sector")} p, niches JOIN strong USING (scrip_code) WHERE in_watchlist AND cin <> '' AND niche <> '' AND p.sector <> ''
AND (len(list_intersect(string_split(lower(p.sector), ' '), string_split(niche, ' '))) > 0 OR contains(niche, lower(p.sector)) OR contains(lower(p.sector), niche))""".replace("v(id, sector) p", "p(id, sector)"), A_)
def policy_alerts(t):
    policies = F.broadcast(_values(t, POLICIES, "id long, sector string"))  # a feed's newest ten at most
    return signals.connected(policies.join(_watched(t), signals.words_match(F.col("sector"), F.col("niche"))).select("id", "scrip_code"), _top(t), LEAST)


@query(f"""WITH {STRONG} SELECT e.id::BIGINT AS id, scrip_code, score FROM {_literal([(1, "asia"), (2, "europe")], "id, area")} e JOIN niches ON starts_with(niche, e.area) JOIN strong USING (scrip_code) WHERE in_watchlist AND cin <> '' AND niche <> ''""".replace("v(id, area) e", "e(id, area)"), A_)
def macro_alerts(t):
    """What a model says of an event and a company is a table of (event, company) that benefits; here, companies of the event's area."""
    said = t.niches.select("scrip_code", "niche").join(F.broadcast(_values(t, [(1, "asia"), (2, "europe")], "id long, area string")), F.startswith(F.col("niche"), F.col("area"))).select("id", "scrip_code")
    return signals.connected(said.join(_watched(t).select("scrip_code"), "scrip_code", "left_semi"), _top(t), LEAST)


BUDGET = [(1, "Rural Roads ASIA", 5000.0), (2, "nation_12", 2500.0), (3, "solar", 100.0)]


@query(f"""WITH {STRONG} SELECT b.id::BIGINT AS id, scrip_code, b.crore::DOUBLE AS crore, score FROM {_literal(BUDGET, "id, sector, crore")} b, niches JOIN strong USING (scrip_code) WHERE in_watchlist AND cin <> ''
AND (contains(niche, lower(b.sector)) OR contains(lower(b.sector), niche) OR len(list_filter(string_split(lower(b.sector), ' '), lambda w: contains(niche, w))) > 0)""".replace("v(id, sector, crore) b", "b(id, sector, crore)"), A_)
def budget_alerts(t):
    allocations = F.broadcast(_values(t, BUDGET, "id long, sector string, crore double"))  # one speech's allocations
    watched = t.niches.filter("in_watchlist AND cin <> ''").select("scrip_code", "niche")
    return signals.connected(allocations.join(watched, signals.sector_in_niche(F.col("sector"), F.col("niche"))).select("id", "scrip_code", "crore"), _top(t), LEAST)


@query(f"""WITH {STRONG}, nt AS (SELECT tender_id, winner, value, trim(replace(replace(lower(winner), ' ltd', ''), ' limited', '')) AS a FROM tenders WHERE NOT processed)
SELECT tender_id, n.scrip_code, round(value, 2) AS value, 1.0::DOUBLE AS ratio, score FROM nt JOIN niches n ON trim(replace(replace(lower(n.name), ' ltd', ''), ' limited', '')) = a JOIN strong USING (scrip_code) WHERE in_watchlist AND cin <> ''
AND tender_id NOT IN (SELECT tender_id FROM tenders WHERE processed)""", ("tenders", *A_))
def tender_alerts(t):
    new = t.tenders.filter("NOT processed").join(t.tenders.filter("processed").select("tender_id"), "tender_id", "left_anti")
    watched = t.niches.filter("in_watchlist").select("scrip_code", "name", "cin")
    won = entity.tender_winners(new, watched).join(watched.filter("cin <> ''").select("scrip_code"), "scrip_code", "left_semi")
    return signals.connected(won.select("tender_id", "scrip_code", F.round("value", 2).alias("value"), "ratio"), _top(t), LEAST)


@query(f"WITH {STRONG} SELECT p.scrip_code, pledge_date, seq, pct_change, score FROM pledges p JOIN strong USING (scrip_code) JOIN niches USING (scrip_code) WHERE cin <> '' AND action = 'Released' AND pct_change > 15", ("pledges", *A_))
def pledge_release_alerts(t):
    known = t.niches.filter("cin <> ''").select("scrip_code")
    rows = t.pledges.filter("action = 'Released' AND pct_change > 15").join(known, "scrip_code", "left_semi").select("scrip_code", "pledge_date", "seq", "pct_change")
    return signals.connected(rows, _top(t), LEAST)


@query(f"""WITH {STRONG}, b AS (SELECT l_orderkey AS tender_id, l_suppkey::VARCHAR AS scrip_code, l_extendedprice AS amount FROM lineitem), l AS (SELECT tender_id, arg_min(scrip_code, (amount, scrip_code)) AS scrip_code, min(amount) AS amount FROM b GROUP BY 1)
SELECT tender_id, scrip_code, round(amount, 2) AS amount, score FROM l JOIN niches USING (scrip_code) JOIN strong USING (scrip_code) WHERE in_watchlist AND cin <> ''""", A_)
def lowest_bid_alerts(t):
    """Orders are tenders, and their lines the suppliers' bids."""
    bids = t.lineitem.select(F.col("l_orderkey").alias("tender_id"), F.col("l_suppkey").cast("string").alias("scrip_code"), F.col("l_extendedprice").alias("amount"))
    won = signals.lowest_bids(bids, t.niches.filter("in_watchlist AND cin <> ''"))
    return signals.connected(won.select("tender_id", "scrip_code", F.round("amount", 2).alias("amount")), _top(t), LEAST)
