"""Rules that turn features into scores and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.params import DEFAULT, SUPERSTARS, Params
from tidemark.operators.tables import last_rows


def insider_flow(deals: DataFrame) -> DataFrame:
    """scrip_code, client, net, first_seq: shares bought less sold at market."""
    sign = F.when(F.col("side") == "BUY", F.col("quantity")).when(F.col("side") == "SELL", -F.col("quantity")).otherwise(0.0)
    return deals.filter("at_market").groupBy("scrip_code", "client").agg(F.sum(sign).alias("net"), F.min("seq").alias("first_seq"))


def insider_cluster(deals: DataFrame, whale: float = 100_000) -> DataFrame:
    """scrip_code, buyers, total_shares, top_buyers, is_cluster, is_whale of scrips with two net buyers or one whale.

    top_buyers are the first three in order of arrival; only these are gathered.
    """
    buyers = insider_flow(deals).filter("net > 0")
    early = Window.partitionBy("scrip_code").orderBy("first_seq", "client")
    three = buyers.withColumn("__k", F.row_number().over(early)).filter("__k <= 3").groupBy("scrip_code").agg(F.array_sort(F.collect_list(F.struct("first_seq", "client"))).alias("x"))
    first = buyers.groupBy("scrip_code").agg(F.count("client").alias("buyers"), F.sum("net").alias("total_shares")).join(three, "scrip_code")
    out = first.select("scrip_code", "buyers", "total_shares", F.array_join(F.transform("x", lambda s: s["client"]), ",").alias("top_buyers"), (F.col("buyers") >= 2).alias("is_cluster"), (F.col("total_shares") >= whale).alias("is_whale"))
    return out.filter("is_cluster OR is_whale")


def external_acquirers(deals: DataFrame, least: float = 5.0) -> DataFrame:
    """scrip_code with a market purchase by someone who isn't a promoter and holds at least so many per cent (or doesn't say)."""
    return deals.filter((F.col("side") == "BUY") & F.col("at_market") & ~F.col("is_promoter") & (F.col("pct").isNull() | (F.col("pct") >= least))).groupBy("scrip_code").agg(F.count("seq").alias("filings"))


def latest_pledge(deals: DataFrame) -> DataFrame:
    return deals.groupBy("scrip_code").agg(F.max_by("pct", F.struct("deal_date", "seq", "pct")).alias("pledged"))


def materiality(value: Column, market_cap: Column) -> Column:
    """Per cent of the market capitalisation; null where that isn't positive."""
    return F.when(market_cap > 0, value / market_cap * 100)


def conviction(features: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """features with conviction and breakdown. Null features add nothing; a hard filter makes the score 0."""
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = (
        ("contract", F.coalesce(F.col("materiality_pct") >= params.materiality_pct, F.lit(False)), F.lit(2.0)),
        ("buyback", F.coalesce(F.col("buyback_pct") >= params.buyback_pct, F.lit(False)), F.lit(1.5)),
        ("connection", F.coalesce(F.col("alpha_score") > 0, F.lit(False)), F.lit(0.5)),
        ("cluster", has("is_cluster"), F.lit(2.0)),
        ("acquirer", has("is_acquired"), F.lit(2.0)),
        ("bulk", has("has_bulk_buy"), F.lit(1.5)),
        ("superstar", has("has_superstar"), F.lit(1.0)),
        ("technical", F.coalesce(F.col("ta_adjustment") != 0, F.lit(False)), F.coalesce("ta_adjustment", F.lit(0.0))),
    )
    stopped = F.when(~F.coalesce(F.col("is_regional_match"), F.lit(True)), "regional").when(F.col("vix") > params.fear_level, "fear").when(F.col("pledged") >= params.pledge_cap, "pledge")
    total = F.lit(0.0)
    for _, rule, points in rules:
        total = total + F.when(rule, points).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule, _ in rules]))
    return features.withColumn("conviction", F.when(stopped.isNotNull(), 0.0).otherwise(total)).withColumn("breakdown", F.when(stopped.isNotNull(), F.concat(F.lit("stopped:"), stopped)).otherwise(F.array_join(reasons, ",")))


def fundamentals_pass(ratio: Column, cash_flow: Column, params: Params = DEFAULT) -> tuple[Column, Column]:
    """(passes, reasons): a ratio over the limit or a negative cash flow fails; what is unknown passes, but nothing known fails."""
    reasons = F.array_compact(F.array(F.when(ratio > params.max_debt_to_equity, "debt"), F.when(cash_flow < 0, "cash flow"), F.when(ratio.isNull() & cash_flow.isNull(), "no data")))
    return F.size(reasons) == 0, F.array_join(reasons, ",")


def words_match(a: Column, b: Column) -> Column:
    """Whether two names share a word or one holds the other, in any case; blanks match nothing."""
    x, y = F.lower(a), F.lower(b)
    return (x != "") & (y != "") & (F.arrays_overlap(F.split(x, r"\s+"), F.split(y, r"\s+")) | F.contains(x, y) | F.contains(y, x))


def sector_in_niche(sector: Column, niche: Column) -> Column:
    """Whether one holds the other, or the niche holds a word of the sector, in any case."""
    x, y = F.lower(sector), F.lower(niche)
    return F.contains(y, x) | F.contains(x, y) | F.exists(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w: F.contains(y, w))


def bears_tracked_name(investor: Column, names: tuple[str, ...] = SUPERSTARS) -> Column:
    """Whether a holder's name has a tracked investor's in it, in any case."""
    return F.upper(investor).rlike("|".join(names))


def new_entries(holdings: DataFrame, last: int = 5, names: tuple[str, ...] = SUPERSTARS) -> DataFrame:
    """scrip_code of scrips among whose last holdings (by quarter, then seq) a tracked investor's is new."""
    rows = last_rows(holdings, "scrip_code", [F.desc("quarter_date"), F.desc("seq")], last)
    return rows.filter(F.col("is_new") & bears_tracked_name(F.col("investor"), names)).select("scrip_code").distinct()


def tracked_buys(deals: DataFrame, tracked: DataFrame, last: int = 50) -> DataFrame:
    """scrip_code of scrips among whose last purchases (the newest by seq) one is by a client of tracked(client)."""
    rows = last_rows(deals.filter("side = 'BUY'"), "scrip_code", [F.desc("seq")], last)
    return rows.join(tracked, "client", "left_semi").select("scrip_code").distinct()


def connected(matches: DataFrame, connections: DataFrame, threshold: float) -> DataFrame:
    """The matches (with scrip_code) of companies whose best connection scores threshold or more, with that score."""
    return matches.join(connections.filter(F.col("score") >= threshold).select("scrip_code", "score"), "scrip_code")


def watchlist(sectors: DataFrame, donors: DataFrame, contracts: DataFrame, fundamentals: DataFrame, params: Params = DEFAULT, most: int = 150) -> DataFrame:
    """scrip_code, source, arrived of the companies to watch, the first most in order of arrival.

    sectors and donors: scrip_code, arrived, market_cap of candidates; donors add those that sectors lacks, and come after.
    Companies in the band of market capitalisation stay; of sector candidates those with enough contracts(scrip_code,
    contracts); if that leaves nobody, all of the band. Last, fundamentals(scrip_code, de, ocf) have to pass.
    """
    found = sectors.withColumn("source", F.lit("sector")).withColumn("turn", F.lit(0))
    found = found.unionByName(donors.join(sectors.select("scrip_code"), "scrip_code", "left_anti").withColumn("source", F.lit("donor")).withColumn("turn", F.lit(1)))
    band = found.filter(F.col("market_cap").between(params.market_cap_min, params.market_cap_max)).join(contracts, "scrip_code", "left")
    chosen = band.filter((F.col("source") == "donor") | (F.col("contracts") >= params.min_contracts))
    if chosen.isEmpty():
        chosen = band
    sound = chosen.join(fundamentals, "scrip_code", "left").filter(fundamentals_pass(F.col("de"), F.col("ocf"), params)[0])
    return sound.orderBy("turn", "arrived").limit(most).select("scrip_code", "source", "arrived")


def lowest_bids(bids: DataFrame, watched: DataFrame) -> DataFrame:
    """tender_id, scrip_code, amount: the tenders whose lowest bid is a company's of watched(scrip_code); bids are (tender_id, scrip_code, amount), of equals the first by code."""
    best = bids.filter("amount > 0").groupBy("tender_id").agg(F.min(F.struct("amount", "scrip_code")).alias("x"))
    return best.select("tender_id", "x.scrip_code", "x.amount").join(watched.select("scrip_code").distinct(), "scrip_code", "left_semi").select("tender_id", "scrip_code", "amount")
