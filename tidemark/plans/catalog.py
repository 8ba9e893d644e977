"""The registered queries over the star-schema tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.params import BOARD_CHANGE, CONTRACT, EXCLUDED, SECTOR_KEYWORDS, STAR, SUPERSTARS
from tidemark.operators import entity, events, graph, indicators, portfolio, signals, stats, tables
from tidemark.operators.similarity import whole_side
from tidemark.plans.bindings import Tables, with_views
from tidemark.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The module that each query is in.
HOME: dict[str, str] = {}
AS_OF = "2001-08-01"
YEAR = 2001


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        HOME[f.__name__] = f.__module__
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql.strip()
        return f

    return add


def _values(t: Tables, rows: list[tuple], names: str) -> DataFrame:
    return t.spark.createDataFrame(rows, names)


def _literal(rows: list[tuple], names: str) -> str:
    quote = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") v({names})"


# --- the graph -------------------------------------------------------------------------------------------------------

ELECTIONS = [("BUILDING", 2001, 10), ("MACHINERY", 1999, 1), ("HOUSEHOLD", 2002, 9)]
CHAIN = ("company_boards", "donor_boards", "donations", "directors")


def _soon(t: Tables) -> DataFrame:
    rows = _values(t, ELECTIONS, "party string, y int, m int")
    return rows.filter(X.months_until(F.col("y"), F.col("m"), F.lit(AS_OF).cast("date")).between(-2, 12)).select("party").distinct()


def _connections(t: Tables) -> DataFrame:
    return graph.connections(t.company_boards, t.donor_boards, t.donations, t.directors, YEAR, STAR, _soon(t))


CONNECTIONS = f"""
edges AS (SELECT donor, trust, arg_max(amount, id) AS amount, arg_max(donated, id) AS donated, min(id) AS first_id FROM donations GROUP BY donor, trust),
seats AS (SELECT din, count(*) AS seats FROM (
  SELECT din, 'c' || scrip_code AS a FROM company_boards UNION SELECT din, 'd' || donor FROM donor_boards) GROUP BY din),
given AS (SELECT donor, max(CASE WHEN donated >= {YEAR - STAR.max_years} THEN amount END) AS amount, arg_min(trust, first_id) AS trust FROM edges GROUP BY donor),
parties AS (SELECT trust, arg_min(party, id) AS party FROM donations GROUP BY trust),
soon AS (SELECT DISTINCT party FROM {_literal(ELECTIONS, "party, y, m")} WHERE (y - 2001) * 12 + m - 8 BETWEEN -2 AND 12),
conn AS (
  SELECT b.scrip_code, b.din, d.donor, seats, amount, g.trust, p.party,
         round((0.4::DOUBLE / greatest(seats, 1) + 0.3::DOUBLE / 3 + 0.3::DOUBLE * CASE WHEN amount >= 400000 THEN 1.0::DOUBLE WHEN amount >= 250000 THEN 0.7 ELSE 0.4 END)
           * CASE WHEN is_bureaucrat THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN s.party IS NOT NULL THEN 1.5::DOUBLE ELSE 1 END, 3) AS score
  FROM company_boards b JOIN donor_boards d USING (din) JOIN given g USING (donor) JOIN parties p USING (trust)
  JOIN seats USING (din) JOIN directors r USING (din) LEFT JOIN soon s ON s.party = p.party WHERE amount >= 100000)"""
TOP = """, top AS (SELECT scrip_code, din, donor, seats, amount, party, score FROM (
  SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY score DESC, din, donor) AS k FROM conn) WHERE k = 1)"""


@query(f"WITH {CONNECTIONS} SELECT * FROM conn", CHAIN)
def connection_all(t):
    return _connections(t)


@query(f"WITH {CONNECTIONS}{TOP} SELECT * FROM top", CHAIN)
def connection_top(t):
    return graph.top_connections(_connections(t))


@query(f"WITH {CONNECTIONS} SELECT * FROM seats", CHAIN)
def board_seats(t):
    return graph.board_seats(t.company_boards, t.donor_boards)


@query(f"WITH {CONNECTIONS} SELECT donor, trust, amount, donated FROM edges", CHAIN)
def donor_last_write(t):
    return graph.last_donations(t.donations).drop("first_id")


GRAPH = """
w AS (SELECT scrip_code FROM companies WHERE in_watchlist), b AS (SELECT * FROM company_boards WHERE scrip_code IN (SELECT scrip_code FROM w)),
v AS (SELECT 'company:' || scrip_code AS id, 'ListedCompany' AS kind FROM w UNION SELECT 'director:' || din, 'Director' FROM b
  UNION SELECT 'donor:' || donor, 'DonorCompany' FROM donations UNION SELECT 'trust:' || trust, 'ElectoralTrust' FROM donations
  UNION SELECT 'party:' || party, 'PoliticalParty' FROM donations),
e AS (SELECT 'director:' || din AS src, 'company:' || scrip_code AS dst, 'SITS_ON_BOARD' AS kind FROM b
  UNION SELECT 'director:' || din, 'donor:' || donor, 'SITS_ON_BOARD' FROM donor_boards WHERE din IN (SELECT din FROM b)
  UNION SELECT 'donor:' || donor, 'trust:' || trust, 'DONATED_TO' FROM donations UNION SELECT 'trust:' || trust, 'party:' || party, 'FUNDED' FROM donations)"""


def _graph(t):
    return graph.vertices_and_edges(t.companies, t.company_boards, t.donor_boards, t.donations, t.directors)


@query(f"WITH {GRAPH} SELECT 'vertex' AS what, kind, count(*) AS n FROM v GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind", ("companies", *CHAIN))
def graph_stats(t):
    return graph.graph_stats(*_graph(t))


@query(f"WITH {GRAPH} SELECT id, kind FROM v WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)", ("companies", *CHAIN))
def graph_prune(t):
    return graph.pruned(*_graph(t))


@query(
    """WITH one AS (SELECT 'company:' || scrip_code AS a, 'director:' || din AS b FROM company_boards),
two AS (SELECT x.a, x.b, y.a AS c FROM one x JOIN one y ON x.b = y.b AND y.a <> x.a), three AS (SELECT x.a, x.b, x.c, y.b AS d FROM two x JOIN one y ON x.c = y.a AND y.b <> x.b)
SELECT a || '>' || b AS path, 1 AS length FROM one UNION ALL SELECT a || '>' || b || '>' || c, 2 FROM two UNION ALL SELECT a || '>' || b || '>' || c || '>' || d, 3 FROM three""",
    ("company_boards",),
)
def graph_paths(t):
    """Every simple path of up to three edges from every company."""
    e = t.company_boards.select(F.concat(F.lit("director:"), "din").alias("src"), F.concat(F.lit("company:"), "scrip_code").alias("dst"))
    starts = t.company_boards.select(F.concat(F.lit("company:"), "scrip_code").alias("id")).distinct()
    return graph.paths(e, starts, 3).select(F.array_join("path", ">").alias("path"), "length")


@query(
    """WITH g AS (SELECT donor, count(*) AS n_donations, sum(amount) AS total, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM donations GROUP BY donor),
s AS (SELECT din, count(*) AS total_seats FROM (SELECT din, 'c' || scrip_code FROM company_boards UNION SELECT din, 'd' || donor FROM donor_boards) GROUP BY din)
SELECT scrip_code, din, donor, n_donations, round(total, 2) AS total_amount, ids, total_seats FROM company_boards JOIN donor_boards USING (din) JOIN g USING (donor) JOIN s USING (din) WHERE donor::VARCHAR <> scrip_code""",
    CHAIN,
)
def director_overlap(t):
    rows = graph.director_overlap(t.companies, t.company_boards, t.donor_boards, t.donations)
    return rows.withColumn("ids", F.array_join(F.transform("donated", lambda d: d["id"].cast("string")), ",")).drop("donated")


# --- the relational core ---------------------------------------------------------------------------------------------


@query("SELECT donor, round(sum(amount), 2) AS total, count(*) AS n FROM donations GROUP BY donor HAVING sum(amount) >= 1000000", ("donations",))
def donor_totals_having(t):
    return t.donations.groupBy("donor").agg(F.sum("amount").alias("s"), F.count("id").alias("n")).filter("s >= 1000000").select("donor", F.round("s", 2).alias("total"), "n")


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[.\-,()''\"/\\]', ' ', 'g'), '\b(limited|ltd|pvt|private|public|incorporated|inc|llp|company|co|corporation|corp|and|&)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT p_name AS name, p_retailprice AS amount FROM part), s AS (SELECT name, sum(amount) AS total FROM d GROUP BY name),
m AS (SELECT {NORMAL.format("name")} AS norm, sum(total) AS total, count(*) AS spellings FROM s GROUP BY 1) SELECT norm, round(total, 2) AS total, spellings FROM m WHERE length(norm) > 2"""
)
def donor_totals_normalised(t):
    named = t.part.groupBy(F.col("p_name").alias("name")).agg(F.sum("p_retailprice").alias("total"))
    out = named.groupBy(X.normal_name(F.col("name")).alias("norm")).agg(F.round(F.sum("total"), 2).alias("total"), F.count("name").alias("spellings"))
    return out.filter(F.length("norm") > 2)


@query("SELECT scrip_code, name, market_cap FROM companies WHERE in_watchlist AND market_cap BETWEEN 50 AND 1000000", ("companies",))
def marketcap_band(t):
    return t.companies.filter("in_watchlist AND market_cap BETWEEN 50 AND 1000000").select("scrip_code", "name", "market_cap")


@query("SELECT * FROM companies WHERE scrip_code = '7'", ("companies",))
def company_lookup(t):
    return t.companies.filter("scrip_code = '7'")


@query("SELECT id, donor, amount FROM donations WHERE donated >= 1999 AND amount >= 200000", ("donations",))
def donors_filtered(t):
    return t.donations.filter("donated >= 1999 AND amount >= 200000").select("id", "donor", "amount")


LINES = [(0, "Solar Modules"), (1, "Rail Equipment & Metro"), (2, "Paints"), (3, "Smart Meters"), (4, "Water Supply"), (5, "Sugar")]


@query(f"SELECT p_partkey, p_type FROM part JOIN {_literal(LINES, 'k, line')} ON k = p_partkey % 6 WHERE regexp_matches(lower(line || ' ' || p_type), '({'|'.join(SECTOR_KEYWORDS)})')")
def sector_keywords(t):
    named = t.part.join(F.broadcast(_values(t, LINES, "k long, line string")), F.col("k") == F.col("p_partkey") % 6)
    return named.filter(F.lower(F.concat_ws(" ", "line", "p_type")).rlike(f"({'|'.join(SECTOR_KEYWORDS)})")).select("p_partkey", "p_type")


@query(f"SELECT scrip_code, count(*) AS n FROM announcements WHERE is_contract AND event_date >= DATE '{AS_OF}' - 365 * 3 GROUP BY scrip_code HAVING count(*) >= 1", ("announcements",))
def contract_counts(t):
    return t.announcements.filter(F.col("is_contract") & (F.col("event_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 365 * 3))).groupBy("scrip_code").agg(F.count("id").alias("n")).filter("n >= 1")


@query("SELECT a.id, a.event_date, c.name, a.value FROM announcements a JOIN companies c USING (scrip_code) WHERE is_contract ORDER BY event_date DESC, id LIMIT 10", ("announcements", "companies"))
def recent_contracts_topk(t):
    return t.announcements.filter("is_contract").join(t.companies, "scrip_code").select("id", "event_date", "name", "value").orderBy(F.desc("event_date"), "id").limit(10)


@query(f"WITH {CONNECTIONS}{TOP} SELECT scrip_code, name, score FROM top JOIN companies USING (scrip_code) ORDER BY score DESC, scrip_code LIMIT 50", ("companies", *CHAIN))
def ranking_top50(t):
    return graph.top_connections(_connections(t)).join(t.companies, "scrip_code").select("scrip_code", "name", "score").orderBy(F.desc("score"), "scrip_code").limit(50)


@query("SELECT DISTINCT a.scrip_code, c.sector FROM announcements a JOIN companies c USING (scrip_code) WHERE is_board_change", ("announcements", "companies"))
def announced_distinct(t):
    return t.announcements.filter("is_board_change").join(t.companies, "scrip_code").select("scrip_code", "sector").distinct()


@query("SELECT b.din, b.scrip_code, c.name FROM company_boards b LEFT JOIN (SELECT * FROM companies WHERE in_watchlist) c USING (scrip_code)", ("company_boards", "companies"))
def director_boards(t):
    return t.company_boards.join(t.companies.filter("in_watchlist").select("scrip_code", "name"), "scrip_code", "left").select("din", "scrip_code", "name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.09)")
def missing_anti(t):
    held = t.lineitem.filter("l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.09").select("l_suppkey").distinct()
    return t.supplier.join(held, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey", "s_name")


@query("SELECT scrip_code, name, coalesce(nullif(i.industry, ''), 'unknown') AS industry FROM companies LEFT JOIN (SELECT n_name AS sector, min(CASE WHEN n_regionkey < 3 THEN n_name ELSE '' END) AS industry FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_name) i USING (sector)", ("companies",))
def candidates_left_industry(t):
    i = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("sector"), F.when(F.col("n_regionkey") < 3, F.col("n_name")).otherwise("").alias("industry")).dropDuplicates(["sector"])
    return t.companies.join(i, "sector", "left").select("scrip_code", "name", F.coalesce(F.nullif("industry", F.lit("")), F.lit("unknown")).alias("industry"))


@query("SELECT scrip_code FROM companies WHERE in_watchlist UNION SELECT scrip_code FROM announcements WHERE is_contract", ("companies", "announcements"))
def watchlist_union(t):
    return t.companies.filter("in_watchlist").select("scrip_code").union(t.announcements.filter("is_contract").select("scrip_code")).distinct()


@query("SELECT 'companies' AS what, count(*) AS n FROM companies UNION ALL SELECT 'watchlist', count(*) FROM companies WHERE in_watchlist UNION ALL SELECT 'directors', count(*) FROM directors UNION ALL SELECT 'donations', count(*) FROM donations UNION ALL SELECT 'announcements', count(*) FROM announcements", ("companies", "directors", "donations", "announcements"))
def table_counts(t):
    parts = {"companies": t.companies, "watchlist": t.companies.filter("in_watchlist"), "directors": t.directors, "donations": t.donations, "announcements": t.announcements}
    from functools import reduce

    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, d in parts.items()])


@query("SELECT party, round(sum(amount), 2) AS total, count(*) AS n FROM donations GROUP BY party", ("donations",))
def party_totals(t):
    return t.donations.groupBy("party").agg(F.round(F.sum("amount"), 2).alias("total"), F.count("id").alias("n"))


@query("SELECT o_orderpriority AS source, count(*) AS n FROM orders GROUP BY 1")
def source_counts(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(i), 2) AS invested, round(sum(p), 2) AS pnl, sum(CASE WHEN p > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, count(*) AS trades, round(100000 + sum(p) - sum(i), 2) AS cash, round(100.0 * sum(CASE WHEN p > 0 THEN 1 ELSE 0 END) / nullif(count(*), 0), 4) AS win_rate FROM (SELECT o_totalprice / 1000 AS i, o_totalprice / 1000 - 140 AS p FROM orders WHERE o_orderstatus = 'F')")
def portfolio_kpis(t):
    o = t.orders.filter("o_orderstatus = 'F'").select((F.col("o_totalprice") / 1000).alias("i"), (F.col("o_totalprice") / 1000 - 140).alias("p"))
    wins = F.count_if(F.col("p") > 0)
    return o.agg(F.round(F.sum("i"), 2).alias("invested"), F.round(F.sum("p"), 2).alias("pnl"), wins.alias("wins"), F.count("p").alias("trades"), F.round(100000 + F.sum("p") - F.sum("i"), 2).alias("cash"), F.round(100.0 * wins / F.nullif(F.count("p"), F.lit(0)), 4).alias("win_rate"))


@query("SELECT id, scrip_code, event_date, value FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY event_date DESC, id) AS k FROM announcements) WHERE k <= 5", ("announcements",))
def superstar_last5(t):
    return tables.last_rows(t.announcements, "scrip_code", [F.desc("event_date"), F.col("id")], 5).select("id", "scrip_code", "event_date", "value")


DEALS = ("deals",)


@query("SELECT scrip_code, count(*) AS n, round(sum(quantity), 2) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY deal_date DESC, seq DESC, client, quantity, price) AS k FROM deals WHERE side = 'BUY') WHERE k <= 50 GROUP BY scrip_code", DEALS)
def bulk_last50(t):
    order = [F.desc("deal_date"), F.desc("seq"), F.col("client"), F.col("quantity"), F.col("price")]
    return tables.last_rows(t.deals.filter("side = 'BUY'"), "scrip_code", order, 50).groupBy("scrip_code").agg(F.count("seq").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("SELECT scrip_code, name FROM companies WHERE NOT in_watchlist ORDER BY md5('7' || scrip_code), scrip_code LIMIT 10", ("companies",))
def control_sample(t):
    return stats.sampled(t.companies.filter("NOT in_watchlist"), "scrip_code", 10).select("scrip_code", "name")


# --- upserts ---------------------------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT scrip_code, upper(name) AS name, CASE WHEN market_cap < 2000 THEN NULL ELSE market_cap + 1 END AS market_cap, CASE WHEN sector < 'F' THEN '' ELSE 'x' || cin END AS cin FROM companies WHERE scrip_code::INT % 2 = 0
  UNION ALL SELECT 'new' || scrip_code, name, market_cap, cin FROM companies WHERE scrip_code::INT % 10 = 1)
SELECT coalesce(n.scrip_code, o.scrip_code) AS scrip_code, CASE WHEN n.scrip_code IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(n.market_cap, o.market_cap) AS market_cap, coalesce(nullif(n.cin, ''), o.cin) AS cin
FROM companies o FULL JOIN n ON o.scrip_code = n.scrip_code""",
    ("companies",),
)
def company_upsert(t):
    old = t.companies.select("scrip_code", "name", "market_cap", "cin")
    k = F.col("scrip_code").cast("int")
    new = old.withColumn("sector", F.lit(None).cast("string")).drop("sector").join(t.companies.select("scrip_code", "sector"), "scrip_code").filter(k % 2 == 0)
    new = new.select("scrip_code", F.upper("name").alias("name"), F.when(F.col("market_cap") >= 2000, F.col("market_cap") + 1).alias("market_cap"), F.when(F.col("sector") < "F", "").otherwise(F.concat(F.lit("x"), "cin")).alias("cin"))
    more = old.filter(k % 10 == 1).withColumn("scrip_code", F.concat(F.lit("new"), "scrip_code"))
    return tables.merge(old, new.unionByName(more), ["scrip_code"], overwrite=("name",), blank_is_null=("cin",))


@query("SELECT l_partkey AS din, l_suppkey AS cin, arg_max(l_orderkey, l_orderkey * 100 + l_linenumber) AS last_order, max(l_shipdate)::DATE AS seen FROM lineitem GROUP BY 1, 2")
def director_upsert_all(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("din"), F.col("l_suppkey").alias("cin"), F.col("l_orderkey").alias("last_order"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_shipdate").cast("date").alias("day"))
    seen = rows.groupBy("din", "cin").agg(F.max("day").alias("seen"))
    return tables.latest(rows.drop("day"), ["din", "cin"], "seq").drop("seq").join(seen, ["din", "cin"])


@query("SELECT scrip_code, event_date, min(id) AS id FROM announcements WHERE is_contract GROUP BY 1, 2 UNION ALL SELECT scrip_code, event_date, min(id) FROM announcements a WHERE is_board_change AND NOT EXISTS (SELECT 1 FROM announcements c WHERE c.is_contract AND c.scrip_code = a.scrip_code AND c.event_date = a.event_date) GROUP BY 1, 2", ("announcements",))
def announcement_insert_new(t):
    first = lambda d: d.groupBy("scrip_code", "event_date").agg(F.min("id").alias("id"))
    return tables.insert_absent(first(t.announcements.filter("is_contract")), first(t.announcements.filter("is_board_change")), ["scrip_code", "event_date"])


@query("SELECT scrip_code, coalesce(nullif(CASE WHEN scrip_code::INT % 2 = 0 THEN '' ELSE sector END, ''), region) AS sector FROM companies", ("companies",))
def backfill(t):
    gaps = t.companies.select("scrip_code", "isin", F.when(F.col("scrip_code").cast("int") % 2 == 0, "").otherwise(F.col("sector")).alias("sector"))
    return gaps.join(t.companies.select("isin", "region"), "isin", "left").select("scrip_code", F.coalesce(F.nullif("sector", F.lit("")), "region").alias("sector"))


@query("SELECT donor, trust, amount FROM (SELECT donor, trust, arg_max(amount, id) AS amount, max(donated) AS donated FROM donations GROUP BY 1, 2) WHERE donated >= 2000", ("donations",))
def expired_deleted(t):
    rows = t.donations.groupBy("donor", "trust").agg(F.max_by("amount", "id").alias("amount"), F.max("donated").alias("donated"))
    return rows.filter("donated >= 2000").select("donor", "trust", "amount")


@query("SELECT din, max(day) AS newest, date_diff('day', max(day), DATE '2001-11-04') < 90 AS is_fresh FROM (SELECT l_partkey AS din, l_shipdate::DATE AS day FROM lineitem) GROUP BY din")
def directors_fresh(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("din"), F.col("l_shipdate").cast("date").alias("day"))
    return tables.fresh(rows, "din", "day", F.lit("2001-11-04").cast("date"), 90)


# --- text ------------------------------------------------------------------------------------------------------------

TITLES = [
    "Award of Order worth Rs. 450 Cr from Indian Railways", "Receipt of LOA for metro works", "Tender Award - Supply of transformers", "Order received from NHAI", "Bagged order from Ministry of Defence",
    "New Work Order from Metro Rail Corporation", "EPC contract for solar park INR 2 billion", "Letter of Intent for water supply", "Appointment of Mr. X as Independent Director", "Resignation of Company Secretary",
    "Change in Directors", "Cessation of term of director", "Order of NCLT in the matter", "SEBI order on disclosures", "Court order regarding award", "Financial results for the quarter", "Closure of trading window",
    "Contract for supply of defence equipment to MoD", "Order book update: ₹1,250.5 crore", "Key Managerial Personnel", "Investor presentation", "Supply order rs 75,00,000 in Karnataka", "", None,
]
TITLE_ROWS = [(i, x) for i, x in enumerate(TITLES)]


#: Every order announces one of the titles.
TITLED = f"(SELECT o_orderkey AS id, title FROM orders JOIN {_literal(TITLE_ROWS, 'k, title')} ON k = o_orderkey % {len(TITLES)})"


def _titles(t):
    told = F.broadcast(_values(t, TITLE_ROWS, "k long, title string"))
    return t.orders.select(F.col("o_orderkey").alias("id")).join(told, F.col("k") == F.col("id") % len(TITLES)).select("id", "title")


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"SELECT id::BIGINT AS id, CASE WHEN regexp_matches(title, '{_re(EXCLUDED)}') THEN NULL WHEN regexp_matches(title, '{_re(CONTRACT)}') THEN 'contract' WHEN regexp_matches(title, '{_re(BOARD_CHANGE)}') THEN 'board_change' END AS kind FROM {TITLED}")
def classify_titles(t):
    return _titles(t).select("id", X.announcement_kind(F.col("title")).alias("kind"))


VALUE = r"(?i)(?:rs\.?|inr|₹)\s*([\d,.]+)\s*(crore|cr|million|billion)?"


@query(
    f"""WITH x AS (SELECT id, title, try_cast(replace(nullif(regexp_extract(title, '{VALUE}', 1), ''), ',', '') AS DOUBLE) AS v, lower(regexp_extract(title, '{VALUE}', 2)) AS u FROM {TITLED})
SELECT id::BIGINT AS id, round(CASE u WHEN 'million' THEN v / 10 WHEN 'billion' THEN v * 100 WHEN '' THEN v / 1e7 ELSE v END, 6) AS value_cr,
CASE WHEN contains(lower(coalesce(title, '')), 'karnataka') THEN 'karnataka' WHEN regexp_matches(lower(coalesce(title, '')), 'nhai|railway|defense|ministry|central') THEN 'central' ELSE 'unknown' END AS state FROM x"""
)
def contract_value_regex(t):
    return _titles(t).select("id", F.round(X.contract_value_cr(F.col("title")), 6).alias("value_cr"), X.issuing_state(F.col("title")).alias("state"))


AMOUNTS = [(i, x) for i, x in enumerate(["5.2 Crore", "52.5 Cr", "1 crore", "10 Lakh", "50 lakhs", "5,00,00,000", "₹ 10,00,000", "", None, "none", "3 lac"])]
NUM = r"(\d[\d,]*(?:\.\d+)?)"


def _each(rows: list[tuple]) -> str:
    """Every order with one of the texts."""
    return f"(SELECT o_orderkey AS id, x FROM orders JOIN {_literal(rows, 'k, x')} ON k = o_orderkey % {len(rows)})"


def _texts(t, rows: list[tuple]) -> DataFrame:
    told = F.broadcast(_values(t, rows, "k long, x string"))
    return t.orders.select(F.col("o_orderkey").alias("id")).join(told, F.col("k") == F.col("id") % len(rows)).select("id", "x")



@query(
    f"""WITH x AS (SELECT id, trim(replace(x, '₹', '')) AS a FROM {_each(AMOUNTS)})
SELECT id::BIGINT AS id, round(coalesce(try_cast(replace(nullif(regexp_extract(a, '(?i){NUM}\\s*(?:cr(?:ore)?|crores?)', 1), ''), ',', '') AS DOUBLE) * 1e7,
try_cast(replace(nullif(regexp_extract(a, '(?i){NUM}\\s*(?:lakhs?|lac)', 1), ''), ',', '') AS DOUBLE) * 1e5, try_cast(replace(nullif(regexp_extract(a, '([\\d,]+(?:\\.\\d+)?)', 1), ''), ',', '') AS DOUBLE)), 2) AS rupees FROM x"""
)
def parse_amounts(t):
    return _texts(t, AMOUNTS).select("id", F.round(X.rupees(F.col("x")), 2).alias("rupees"))


BONDS = [(0, "12-Apr-19"), (1, "03-Oct-23"), (2, "2024-01-15"), (3, "Q3-21"), (4, "n/a"), (5, None)]


@query(f"SELECT id::BIGINT AS id, coalesce(year(try_strptime(x, '%d-%b-%y')), try_cast(nullif(regexp_extract(x, '(20\\d{{2}})', 1), '') AS INT), 2000 + try_cast(nullif(regexp_extract(x, '-(\\d{{2}})$', 1), '') AS INT), 2023)::INT AS year FROM {_each(BONDS)}")
def bond_year(t):
    return _texts(t, BONDS).select("id", X.bond_year(F.col("x")).alias("year"))


@query(f"SELECT p_partkey, {NORMAL.format('p_name')} AS norm FROM part")
def normalise_names(t):
    return t.part.select("p_partkey", X.normal_name(F.col("p_name")).alias("norm"))


@query(r"SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))::BIGINT AS links FROM pages")
def page_titles(t):
    return t.pages.select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).cast("long").alias("links"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def event_props_all(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# --- indicators ------------------------------------------------------------------------------------------------------

P = ("prices",)
#: Recursive averages as prefix sums: rows r of a scrip with rn, and their weights.
N = "n AS (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY trade_date) AS rn FROM prices)"
W = "OVER (PARTITION BY scrip_code ORDER BY trade_date)"


def _ema(x: str, a: str) -> str:
    return f"pow(1 - {a}, rn) * sum((CASE WHEN rn = 1 THEN 1 ELSE {a} END) * {x} * pow(1 - {a}, -rn)) {W}"


SMA = """s AS (SELECT *, CASE WHEN count(*) OVER a = 50 THEN avg(close) OVER a END AS sma50, CASE WHEN count(*) OVER b = 200 THEN avg(close) OVER b END AS sma200 FROM prices
WINDOW a AS (PARTITION BY scrip_code ORDER BY trade_date ROWS 49 PRECEDING), b AS (PARTITION BY scrip_code ORDER BY trade_date ROWS 199 PRECEDING))"""


@query(f"WITH {SMA} SELECT scrip_code, trade_date, round(sma50, 4) AS sma50, round(sma200, 4) AS sma200, coalesce(sma50 > sma200, false) AS golden FROM s", P)
def sma_cross(t):
    rows = t.prices.select("scrip_code", "trade_date", indicators.full_window(F.col("close"), 50).alias("a"), indicators.full_window(F.col("close"), 200).alias("b"))
    return rows.select("scrip_code", "trade_date", F.round("a", 4).alias("sma50"), F.round("b", 4).alias("sma200"), F.coalesce(F.col("a") > F.col("b"), F.lit(False)).alias("golden"))


RSI = f"""{N}, d AS (SELECT *, close - lag(close) {W} AS d FROM n),
g AS (SELECT *, sum(greatest(coalesce(d, 0), 0) * pow(13.0::DOUBLE / 14, -rn)) {W} / sum(pow(13.0::DOUBLE / 14, -rn)) {W} AS ag,
  sum(greatest(-coalesce(d, 0), 0) * pow(13.0::DOUBLE / 14, -rn)) {W} / sum(pow(13.0::DOUBLE / 14, -rn)) {W} AS al FROM d),
r AS (SELECT scrip_code, trade_date, CASE WHEN rn >= 14 THEN 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi FROM g)"""


@query(f"WITH {RSI} SELECT scrip_code, trade_date, round(rsi, 4) AS rsi FROM r", P)
def rsi(t):
    return indicators.rsi(t.series).select("scrip_code", "trade_date", F.round("rsi", 4).alias("rsi"))


MACD = f"""m0 AS (SELECT *, {_ema("close", "(2.0::DOUBLE / 13)")} - {_ema("close", "(2.0::DOUBLE / 27)")} AS macd FROM n),
m AS (SELECT *, {_ema("macd", "0.2::DOUBLE")} AS sig FROM m0),
h AS (SELECT scrip_code, trade_date, macd, sig, macd - sig AS hist, lag(macd - sig) {W} AS h1, lag(macd - sig, 2) {W} AS h2 FROM m)"""


@query(f"WITH {N}, {MACD} SELECT scrip_code, trade_date, round(macd, 4) AS macd, round(sig, 4) AS macd_signal FROM h", P)
def macd(t):
    return indicators.macd(t.series).select("scrip_code", "trade_date", F.round("macd", 4).alias("macd"), F.round("macd_signal", 4).alias("macd_signal"))


@query(f"WITH {N}, {MACD} SELECT scrip_code, count(*) AS days, sum(CASE WHEN coalesce(hist > 0 AND (h2 <= 0 OR hist > h1) AND h2 IS NOT NULL, false) THEN 1 ELSE 0 END)::BIGINT AS bullish FROM h GROUP BY scrip_code", P)
def macd_bullish(t):
    return indicators.macd_bullish(indicators.macd(t.series)).groupBy("scrip_code").agg(F.count("rn").alias("days"), F.count_if("macd_bullish").alias("bullish"))


OBV = f"o0 AS (SELECT *, coalesce(volume * sign(close - lag(close) {W}), 0) AS v FROM n), o AS (SELECT scrip_code, trade_date, rn, sum(v) OVER (PARTITION BY scrip_code ORDER BY trade_date) AS obv FROM o0)"


@query(f"WITH {N}, {OBV} SELECT scrip_code, trade_date, round(obv, 2) AS obv FROM o", P)
def obv(t):
    return indicators.obv(t.prices).select("scrip_code", "trade_date", F.round("obv", 2).alias("obv"))


SLOPE = "l AS (SELECT scrip_code, CASE WHEN count(*) = 10 THEN regr_slope(obv, rn) END AS slope FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY trade_date DESC) AS k FROM o) WHERE k <= 10 GROUP BY scrip_code)"


@query(f"WITH {N}, {OBV}, {SLOPE} SELECT scrip_code, round(slope, 3) AS slope FROM l", P)
def obv_slope(t):
    rows = indicators.obv_slope(indicators.obv(indicators.numbered(t.prices)))
    return rows.groupBy("scrip_code").agg(F.round(F.max_by("obv_slope", "rn"), 3).alias("slope"))


ATR = f"""t0 AS (SELECT *, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM n),
t AS (SELECT scrip_code, trade_date, close, {_ema("tr", "(2.0::DOUBLE / 15)")} AS atr FROM t0)"""


@query(f"WITH {N}, {ATR} SELECT scrip_code, trade_date, round(atr, 4) AS atr, round(close - 2 * atr, 4) AS atr_stop FROM t", P)
def atr_stop(t):
    return indicators.atr(t.series).select("scrip_code", "trade_date", F.round("atr", 4).alias("atr"), F.round("atr_stop", 4).alias("atr_stop"))


VWAP = "v AS (SELECT scrip_code, trade_date, close, CASE WHEN count(*) OVER a = 20 THEN sum((high + low + close) / 3 * volume) OVER a / nullif(sum(volume) OVER a, 0) END AS vwap FROM prices WINDOW a AS (PARTITION BY scrip_code ORDER BY trade_date ROWS 19 PRECEDING))"


@query(f"WITH {VWAP} SELECT scrip_code, trade_date, round(vwap, 2) AS vwap FROM v", P)
def vwap(t):
    return indicators.vwap(t.prices).select("scrip_code", "trade_date", F.round("vwap", 2).alias("vwap"))


@query(
    """WITH x AS (SELECT scrip_code, trade_date, volume, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS d, count(*) OVER w AS n, row_number() OVER (PARTITION BY scrip_code ORDER BY trade_date DESC) AS k FROM prices
WINDOW w AS (PARTITION BY scrip_code ORDER BY trade_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT scrip_code, trade_date, volume, round(CASE WHEN d > 0 THEN (volume - m) / d ELSE 0 END, 4) AS z_score, CASE WHEN d > 0 THEN (volume - m) / d ELSE 0 END > 3 AS is_spike FROM x WHERE k = 1 AND n = 14""",
    P,
)
def volume_spike(t):
    return indicators.volume_spike(t.prices).withColumn("z_score", F.round("z_score", 4))


TECH = f"""{RSI}, {MACD}, {OBV}, {SLOPE}, {SMA}, {ATR}, {VWAP},
z AS (SELECT s.scrip_code, s.trade_date, s.close, rsi, hist, atr, slope, vwap,
  CASE WHEN rsi < 30 THEN 2.0 WHEN rsi < 40 THEN 1.5 WHEN rsi < 55 THEN 1.0 WHEN rsi < 70 THEN 0.5 ELSE 0 END
  + CASE WHEN coalesce(hist > 0 AND (h2 <= 0 OR hist > h1) AND h2 IS NOT NULL, false) THEN 2 WHEN hist > 0 THEN 1 ELSE 0 END
  + CASE WHEN sma50 > sma200 AND s.close > sma50 THEN 2 WHEN sma50 > sma200 THEN 1 WHEN s.close > sma200 THEN 0.5 ELSE 0 END
  + CASE WHEN slope > 0 THEN 2 ELSE 0 END + CASE WHEN s.close > vwap THEN 2 ELSE 0 END AS score
  FROM s JOIN (SELECT scrip_code, max(trade_date) AS trade_date FROM prices GROUP BY 1) USING (scrip_code, trade_date)
  JOIN r USING (scrip_code, trade_date) JOIN h USING (scrip_code, trade_date) JOIN t USING (scrip_code, trade_date) JOIN v USING (scrip_code, trade_date) JOIN l USING (scrip_code)),
tech AS (SELECT scrip_code, trade_date, close, score::DOUBLE AS ta_score, CASE WHEN score >= 8 THEN 'STRONG_BUY' WHEN score >= 6 THEN 'BUY' WHEN score >= 4 THEN 'NEUTRAL' ELSE 'AVOID' END AS ta_signal,
  CASE WHEN score >= 8 THEN 2.5 WHEN score >= 6 THEN 1.0 WHEN score >= 4 THEN 0.0 ELSE -1.5 END::DOUBLE AS ta_adjustment, close - 2 * atr AS stop FROM z)"""


#: The same slope from sums of whole numbers, which are exact: one that is 0 has no sign, which regr_slope's last digits give it.
EXACT = SLOPE.replace("regr_slope(obv, rn)", "(10 * sum(obv * rn) - sum(obv) * sum(rn)) / (10 * sum(rn * rn) - sum(rn) * sum(rn))")


@query(f"WITH {TECH.replace(SLOPE, EXACT)} SELECT scrip_code, trade_date, ta_score, ta_signal, ta_adjustment, round(stop, 4) AS atr_stop FROM tech", P)
def technical_score(t):
    return indicators.technical_score(t.prices).select("scrip_code", "trade_date", "ta_score", "ta_signal", "ta_adjustment", F.round("atr_stop", 4).alias("atr_stop"))


# --- events ----------------------------------------------------------------------------------------------------------

E_ = ("announcements", "prices")
EV = "ev AS (SELECT id, scrip_code, event_date FROM announcements WHERE is_contract)"
RET = f"""{EV}, base AS (SELECT id, ev.scrip_code, event_date, min(trade_date) AS bd, arg_min(close, trade_date) AS bc FROM ev JOIN prices p ON p.scrip_code = ev.scrip_code AND p.trade_date BETWEEN event_date AND event_date + 400 GROUP BY 1, 2, 3),
ret AS (SELECT id, base.scrip_code, event_date, days::INT AS days, round((arg_max(p.close, p.trade_date) / bc - 1) * 100, 2) AS ret FROM base, (SELECT unnest([30, 60, 90, 180, 360]) AS days), prices p
  WHERE p.scrip_code = base.scrip_code AND p.trade_date BETWEEN bd AND bd + days::INT AND p.trade_date <= event_date + 400 GROUP BY 1, 2, 3, 4, bc)"""


def _returns(t):
    return events.forward_returns(t.announcements.filter("is_contract"), t.prices)


@query(f"WITH {RET} SELECT * FROM ret", E_)
def forward_returns(t):
    return _returns(t)


BM = """, bev AS (SELECT DISTINCT event_date FROM ev), bb AS (SELECT event_date, min(trade_date) AS bd, arg_min(close, trade_date) AS bc FROM bev JOIN benchmark_prices p ON p.trade_date BETWEEN event_date AND event_date + 400 GROUP BY 1),
bret AS (SELECT event_date, days::INT AS days, round((arg_max(p.close, p.trade_date) / bc - 1) * 100, 2) AS bm FROM bb, (SELECT unnest([30, 60, 90, 180, 360]) AS days), benchmark_prices p WHERE p.trade_date BETWEEN bd AND bd + days::INT AND p.trade_date <= event_date + 400 GROUP BY 1, 2, bc),
ex AS (SELECT ret.*, round(ret - coalesce(bm, 0), 2) AS excess FROM ret LEFT JOIN bret USING (event_date, days))"""


def _excess(t):
    days = t.announcements.filter("is_contract").select("event_date").distinct().select(F.lit(0).alias("id"), F.lit("bm").alias("scrip_code"), "event_date")
    bm = events.forward_returns(days, t.benchmark_prices.withColumn("scrip_code", F.lit("bm"))).select("event_date", "days", F.col("ret").alias("bm"))
    return _returns(t).join(bm, ["event_date", "days"], "left").withColumn("excess", F.round(F.col("ret") - F.coalesce("bm", F.lit(0.0)), 2)).drop("bm")


@query(f"WITH {RET}{BM} SELECT * FROM ex", (*E_, "benchmark_prices"))
def excess_returns(t):
    return _excess(t)


CAR = f"""{EV}, own AS (SELECT scrip_code, trade_date, close / lag(close) {W} - 1 AS r FROM prices), mk AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS m FROM benchmark_prices),
dr AS (SELECT scrip_code, trade_date, r, m, row_number() {W} AS rn FROM own JOIN mk USING (trade_date) WHERE r IS NOT NULL AND m IS NOT NULL),
sz AS (SELECT scrip_code, max(rn) AS n FROM dr GROUP BY 1 HAVING max(rn) >= 30),
pos AS (SELECT id, ev.scrip_code, min(rn) AS pos, any_value(n) AS n FROM ev JOIN sz USING (scrip_code) JOIN dr d ON d.scrip_code = ev.scrip_code AND d.trade_date BETWEEN event_date AND event_date + 60 GROUP BY 1, 2),
fit AS (SELECT id, count(*) AS k, regr_slope(r, m) AS b, regr_intercept(r, m) AS a FROM pos JOIN dr d ON d.scrip_code = pos.scrip_code AND rn BETWEEN pos - 120 AND pos - 12 GROUP BY 1),
win AS (SELECT * FROM (VALUES (-1, 1), (-5, 5), (-10, 10), (0, 5), (0, 10), (0, 30)) w(pre, post)),
car AS (SELECT pos.id, pos.scrip_code, pre, post, round(sum(r - CASE WHEN coalesce(k, 0) >= 20 THEN a + b * m ELSE m END) * 100, 4) AS car
  FROM pos CROSS JOIN win LEFT JOIN fit ON fit.id = pos.id JOIN dr d ON d.scrip_code = pos.scrip_code AND d.rn BETWEEN greatest(1, pos.pos + pre) AND least(pos.n, pos.pos + post) GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)"""
C_ = (*E_, "benchmark_prices")


def _car(t):
    return events.car_windows(t.announcements.filter("is_contract"), events.daily_returns(t.prices, t.benchmark_prices))


@query(f"WITH {CAR} SELECT * FROM car", C_)
def car_windows(t):
    return _car(t)


@query(f"WITH {CAR} SELECT pre, post, count(*) AS n, round(avg(car), 3) AS mean, round(avg(car) / (stddev_samp(car) / sqrt(count(*))), 3) AS t FROM car GROUP BY 1, 2", C_)
def car_ttest(t):
    out = stats.one_sample(_car(t).withColumn("w", F.struct("pre", "post")), "w", "car")
    return out.select("w.pre", "w.post", "n", F.round("mean", 3).alias("mean"), F.round("t", 3).alias("t"))


G_ = ("companies", *CHAIN, *C_)
LINKED = f"{CONNECTIONS}{TOP}, link AS (SELECT scrip_code, max(CASE WHEN score >= 0.75 THEN 1 ELSE 0 END) = 1 AS linked FROM top GROUP BY 1)"


def _linked(t):
    return graph.top_connections(_connections(t)).select("scrip_code", (F.col("score") >= STAR.alpha_threshold).alias("linked"))


@query(f"WITH {LINKED} SELECT in_watchlist, count(*) AS n, round(100 * avg(CASE WHEN linked THEN 1.0 ELSE 0 END), 4) AS base_rate FROM companies LEFT JOIN link USING (scrip_code) GROUP BY 1", ("companies", *CHAIN))
def base_rate(t):
    rows = t.companies.join(_linked(t), "scrip_code", "left").withColumn("x", F.coalesce(F.col("linked").cast("double"), F.lit(0.0)))
    return rows.groupBy("in_watchlist").agg(F.count("x").alias("n"), F.round(100 * F.avg("x"), 4).alias("base_rate"))


@query(f"WITH {LINKED}, {RET}{BM} SELECT days, coalesce(linked, false) AS linked, count(*) AS n, round(avg(ret), 3) AS mean_ret, round(avg(excess), 3) AS mean_excess FROM ex LEFT JOIN link USING (scrip_code) GROUP BY 1, 2", G_)
def connected_returns(t):
    rows = _excess(t).join(_linked(t), "scrip_code", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return rows.groupBy("days", "linked").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 3).alias("mean_ret"), F.round(F.avg("excess"), 3).alias("mean_excess"))


@query(f"WITH {RET}{BM} SELECT count(*) AS trades, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, round(100.0 * avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 4) AS win_rate, round(100.0 * avg(CASE WHEN excess > 0 THEN 1 ELSE 0 END), 4) AS excess_win_rate, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) >= 0.55 AS viable FROM ex WHERE days = 90", C_)
def win_rate(t):
    x = _excess(t).filter("days = 90")
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return x.agg(F.count("ret").alias("trades"), F.count_if(F.col("ret") > 0).alias("wins"), F.round(100 * share("ret"), 4).alias("win_rate"), F.round(100 * share("excess"), 4).alias("excess_win_rate"), (share("ret") >= 0.55).alias("viable"))


WELCH = "(var_samp(excess) FILTER (linked)) / count(*) FILTER (linked)", "(var_samp(excess) FILTER (NOT linked)) / count(*) FILTER (NOT linked)"


@query(f"WITH {LINKED}, {RET}{BM}, x AS (SELECT days, excess, coalesce(linked, false) AS linked FROM ex LEFT JOIN link USING (scrip_code)) SELECT days, count(*) FILTER (linked) AS n1, count(*) FILTER (NOT linked) AS n0, CASE WHEN count(*) FILTER (linked) < 2 OR count(*) FILTER (NOT linked) < 2 OR NOT coalesce({WELCH[0]} + {WELCH[1]} > 0, false) THEN 0 ELSE round((avg(excess) FILTER (linked) - avg(excess) FILTER (NOT linked)) / sqrt({WELCH[0]} + {WELCH[1]}), 3) END::DOUBLE AS t FROM x GROUP BY 1", G_)
def return_ttest(t):
    rows = _excess(t).join(_linked(t), "scrip_code", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return stats.welch(rows, "days", "linked", "excess").select("days", "n1", "n0", F.round("t", 3).alias("t"))


@query(f"WITH {LINKED}, {RET}{BM}, x AS (SELECT excess AS y, coalesce(score, 0) AS a, CASE WHEN market_cap > 0 THEN ln(market_cap) ELSE 0 END AS b FROM ex JOIN companies USING (scrip_code) LEFT JOIN top USING (scrip_code) WHERE days = 90), s AS (SELECT count(*) AS n, covar_pop(a, a) AS s11, covar_pop(b, b) AS s22, covar_pop(a, b) AS s12, covar_pop(a, y) AS s1, covar_pop(b, y) AS s2 FROM x) SELECT n, round((s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12), 4) AS b1, round((s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12), 4) AS b2 FROM s", G_)
def ols_panel(t):
    rows = _excess(t).filter("days = 90").join(t.companies, "scrip_code").join(graph.top_connections(_connections(t)).select("scrip_code", "score"), "scrip_code", "left")
    rows = rows.select(F.col("excess").alias("y"), F.coalesce("score", F.lit(0.0)).alias("a"), F.when(F.col("market_cap") > 0, F.log("market_cap")).otherwise(0.0).alias("b"))
    return stats.ols2(rows, "y", "a", "b").select("n", F.round("b1", 4).alias("b1"), F.round("b2", 4).alias("b2"))


# --- signals ---------------------------------------------------------------------------------------------------------

FLOW = "f AS (SELECT scrip_code, client, sum(CASE side WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity ELSE 0 END) AS net, min(seq) AS first_seq FROM deals WHERE at_market GROUP BY 1, 2), cl AS (SELECT scrip_code, count(*) AS buyers, sum(net) AS total_shares, array_to_string(list_slice(list(client ORDER BY first_seq, client), 1, 3), ',') AS top_buyers, count(*) >= 2 AS is_cluster, sum(net) >= 100000 AS is_whale FROM f WHERE net > 0 GROUP BY 1 HAVING count(*) >= 2 OR sum(net) >= 100000)"


@query(f"WITH {FLOW} SELECT * FROM cl", DEALS)
def insider_cluster(t):
    return signals.insider_cluster(t.deals)


@query("SELECT scrip_code, count(*) AS filings FROM deals WHERE side = 'BUY' AND at_market AND NOT is_promoter AND (pct IS NULL OR pct >= 5) GROUP BY 1", DEALS)
def external_acquirer(t):
    return signals.external_acquirers(t.deals)


PLEDGE = "pl AS (SELECT scrip_code, pct AS pledged FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY deal_date DESC, seq DESC, pct DESC) AS k FROM deals) WHERE k = 1)"


@query(f"WITH {PLEDGE} SELECT scrip_code, round(pledged, 4) AS pledged FROM pl", DEALS)
def latest_pledge(t):
    return signals.latest_pledge(t.deals).withColumn("pledged", F.round("pledged", 4))


@query("SELECT id, round(value / market_cap * 100, 4) AS pct, coalesce(value / market_cap * 100 >= 5000, false) AS is_material FROM announcements JOIN companies USING (scrip_code) WHERE market_cap > 0", ("announcements", "companies"))
def materiality(t):
    rows = t.announcements.join(t.companies, "scrip_code").withColumn("p", signals.materiality(F.col("value"), F.col("market_cap"))).filter("p IS NOT NULL")
    return rows.select("id", F.round("p", 4).alias("pct"), (F.col("p") >= 5000).alias("is_material"))


STATE_PARTIES = [("ASIA", "build"), ("ASIA", "auto"), ("EUROPE", "mach"), ("AMERICA", "furn"), ("AFRICA", "house")]


@query(f"SELECT scrip_code, id, CASE WHEN region IN (SELECT s FROM {_literal(STATE_PARTIES, 's, w')}) THEN EXISTS (SELECT 1 FROM {_literal(STATE_PARTIES, 's, w')} WHERE s = region AND contains(lower(party), w)) ELSE true END AS matches FROM companies JOIN donations ON donor = scrip_code::BIGINT", ("companies", "donations"))
def regional_match(t):
    rules = _values(t, STATE_PARTIES, "s string, w string")
    rows = t.companies.join(t.donations, F.col("donor") == F.col("scrip_code").cast("bigint")).join(F.broadcast(rules), F.col("s") == F.col("region"), "left")
    # a region without rules has one row with none
    return rows.groupBy("scrip_code", "id").agg(F.bool_or(F.col("w").isNull() | F.contains(F.lower("party"), F.col("w"))).alias("matches"))


NICHES = [(1, "Power NATION_3"), (2, "nation_1"), (3, "United"), (4, "")]


@query(f"SELECT id::BIGINT AS id, scrip_code FROM {_literal(NICHES, 'id, niche')}, companies WHERE niche <> '' AND (len(list_intersect(string_split(lower(niche), ' '), string_split(lower(sector), ' '))) > 0 OR contains(lower(niche), lower(sector)) OR contains(lower(sector), lower(niche)))", ("companies",))
def niche_match(t):
    return F.broadcast(_values(t, NICHES, "id long, niche string")).join(t.companies, signals.words_match(F.col("niche"), F.col("sector"))).select("id", "scrip_code")


def lcs_sql(pairs: str) -> str:
    """The body of a CTE (a, b, n): the length of the longest common subsequence of each pair (a, b) of a query, row by row of the table of prefixes."""
    return f"""WITH RECURSIVE step AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM ({pairs})
UNION ALL SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_max(list_slice(c, 1, j + 1))) FROM (
  SELECT a, b, i, list_transform(range(0, length(b) + 1), lambda k: CASE WHEN k = 0 THEN 0 WHEN b[k] = a[i + 1] THEN greatest(r[k + 1], r[k] + 1) ELSE r[k + 1] END) AS c FROM step WHERE i < length(a)))
SELECT a, b, r[length(b) + 1] AS n FROM step WHERE i = length(a)"""


def set_ratio_sql(name: str, pairs: str) -> str:
    """CTEs that end in name(x, y, score): the ratio of word sets of each pair (x, y) of a query."""
    own = "list_sort(list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda t: t <> '')))"
    return f"""{name}w AS (SELECT x, y, {own.format("x")} AS wx, {own.format("y")} AS wy FROM ({pairs})),
{name}p AS (SELECT x, y, array_to_string(list_filter(wx, lambda t: list_contains(wy, t)), ' ') AS c, array_to_string(list_filter(wx, lambda t: NOT list_contains(wy, t)), ' ') AS ox, array_to_string(list_filter(wy, lambda t: NOT list_contains(wx, t)), ' ') AS oy FROM {name}w),
{name}q AS (SELECT *, trim(c || ' ' || ox) AS a, trim(c || ' ' || oy) AS b FROM {name}p), {name}l AS ({lcs_sql(f"SELECT DISTINCT a, b FROM {name}q")}),
{name} AS (SELECT x, y, CASE WHEN c <> '' AND (ox = '' OR oy = '') THEN 100.0 ELSE greatest(200.0::DOUBLE * n / (length(a) + length(b)), CASE WHEN c <> '' THEN greatest(200.0::DOUBLE * length(c) / (length(c) + length(a)), 200.0::DOUBLE * length(c) / (length(c) + length(b))) ELSE 0 END) END AS score FROM {name}q JOIN {name}l USING (a, b))"""


INSTITUTIONAL = "MUTUAL FUND|CAPITAL|SECURITIES|HOLDINGS|INVESTMENT|ASSET MANAGEMENT|FUND"
TRACKED = f"""clients AS (SELECT DISTINCT client, upper(client) AS x FROM bulk_deals),
{set_ratio_sql("sr", f"SELECT x, n AS y FROM (SELECT DISTINCT x FROM clients), {_literal([(x,) for x in SUPERSTARS], 'n')}")},
{set_ratio_sql("dn", "SELECT x, n_name AS y FROM (SELECT DISTINCT x FROM clients), nation")},
tr AS (SELECT client, CASE WHEN x IN (SELECT x FROM sr WHERE score > 90) THEN 'superstar' WHEN regexp_matches(x, '{INSTITUTIONAL}') THEN 'institution' WHEN x IN (SELECT x FROM dn WHERE score >= 75) THEN 'donor' END AS why FROM clients)"""
TRACKED_BUYS = f"""{TRACKED}, lastb AS (SELECT scrip_code, client FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY seq DESC) AS k FROM bulk_deals WHERE side = 'BUY') WHERE k <= 50),
tb AS (SELECT DISTINCT scrip_code FROM lastb JOIN tr USING (client) WHERE why IS NOT NULL)"""
STAR_NAMES = "|".join(SUPERSTARS)
NEW = f"""ne AS (SELECT DISTINCT scrip_code FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY quarter_date DESC, seq DESC) AS k FROM holdings)
  WHERE k <= 5 AND is_new AND regexp_matches(upper(investor), '{STAR_NAMES}'))"""


def _tracked(t):
    return entity.tracked_names(t.bulk_deals.select("client"), t.nation.select(F.col("n_name").alias("name")))


FEAT = f"""{LINKED}, {TECH}, {FLOW}, {TRACKED_BUYS}, {NEW},
mt AS (SELECT scrip_code, max(value) AS value FROM announcements WHERE is_contract GROUP BY 1), bb AS (SELECT scrip_code, max(value) AS value FROM announcements WHERE is_board_change GROUP BY 1),
acq AS (SELECT DISTINCT scrip_code FROM deals WHERE side = 'BUY' AND at_market AND NOT is_promoter AND (pct IS NULL OR pct >= 5)),
vx AS (SELECT coalesce(arg_max(close, trade_date) % 9 + 12, 15) AS vix FROM benchmark_prices),
lp AS (SELECT scrip_code, pledged FROM (SELECT *, row_number() OVER (PARTITION BY scrip_code ORDER BY pledge_date DESC, seq DESC) AS k FROM pledges) WHERE k = 1),
q AS (SELECT c.scrip_code, market_cap, vix, CASE WHEN market_cap > 0 THEN mt.value / market_cap * 100 END AS m, CASE WHEN market_cap > 0 THEN bb.value / market_cap * 100 END AS b, top.score, coalesce(is_cluster, false) AS cl, acq.scrip_code IS NOT NULL AS ac, ta_adjustment AS ta, lp.pledged, top.party IS NULL OR region NOT IN (SELECT s FROM {_literal(STATE_PARTIES, 's, w')}) OR EXISTS (SELECT 1 FROM {_literal(STATE_PARTIES, 's, w')} WHERE s = region AND contains(lower(top.party), w)) AS rm, tb.scrip_code IS NOT NULL AS bulk, ne.scrip_code IS NOT NULL AS ss
  FROM companies c CROSS JOIN vx LEFT JOIN lp USING (scrip_code) LEFT JOIN tb USING (scrip_code) LEFT JOIN ne USING (scrip_code) LEFT JOIN mt USING (scrip_code) LEFT JOIN bb USING (scrip_code) LEFT JOIN top USING (scrip_code) LEFT JOIN cl USING (scrip_code) LEFT JOIN acq USING (scrip_code) LEFT JOIN tech USING (scrip_code)),
cv AS (SELECT scrip_code, market_cap, score, CASE WHEN NOT rm OR vix > 22 OR pledged >= 25 THEN 0 ELSE CASE WHEN m >= 5 THEN 2.0 ELSE 0 END + CASE WHEN b >= 2 THEN 1.5 ELSE 0 END + CASE WHEN score > 0 THEN 0.5 ELSE 0 END + CASE WHEN cl THEN 2 ELSE 0 END + CASE WHEN ac THEN 2 ELSE 0 END + CASE WHEN bulk THEN 1.5 ELSE 0 END + CASE WHEN ss THEN 1 ELSE 0 END + coalesce(ta, 0) END::DOUBLE AS conviction,
  CASE WHEN NOT rm THEN 'stopped:regional' WHEN vix > 22 THEN 'stopped:fear' WHEN pledged >= 25 THEN 'stopped:pledge' ELSE concat_ws(',', CASE WHEN m >= 5 THEN 'contract' END, CASE WHEN b >= 2 THEN 'buyback' END, CASE WHEN score > 0 THEN 'connection' END, CASE WHEN cl THEN 'cluster' END, CASE WHEN ac THEN 'acquirer' END, CASE WHEN bulk THEN 'bulk' END, CASE WHEN ss THEN 'superstar' END, CASE WHEN ta <> 0 THEN 'technical' END) END AS breakdown FROM q)"""
F_ = ("companies", *CHAIN, "announcements", "prices", "deals", "bulk_deals", "holdings", "pledges", "benchmark_prices")


def _convictions(t):
    value = lambda c, name: F.max(F.when(F.col(c), F.col("value"))).alias(name)
    rows = t.companies.join(t.announcements.groupBy("scrip_code").agg(value("is_contract", "won"), value("is_board_change", "back")), "scrip_code", "left")
    rows = rows.join(graph.top_connections(_connections(t)).select("scrip_code", "party", F.col("score").alias("alpha_score")), "scrip_code", "left")
    rows = rows.join(signals.insider_cluster(t.deals).select("scrip_code", "is_cluster"), "scrip_code", "left")
    rows = rows.join(signals.external_acquirers(t.deals).select("scrip_code", F.lit(True).alias("is_acquired")), "scrip_code", "left")
    rows = rows.join(signals.tracked_buys(t.bulk_deals, _tracked(t)).withColumn("has_bulk_buy", F.lit(True)), "scrip_code", "left")
    rows = rows.join(signals.new_entries(t.holdings).withColumn("has_superstar", F.lit(True)), "scrip_code", "left")
    rows = rows.join(indicators.technical_score(t.prices).select("scrip_code", "ta_adjustment"), "scrip_code", "left")
    rows = rows.join(t.pledges.groupBy("scrip_code").agg(F.max_by("pledged", F.struct("pledge_date", "seq", "pledged")).alias("pledged")), "scrip_code", "left")
    rules = _values(t, STATE_PARTIES, "s string, w string").groupBy("s").agg(F.collect_list("w").alias("tokens"))
    rows = rows.join(F.broadcast(rules), F.col("s") == F.col("region"), "left")
    fits = F.col("party").isNull() | F.col("tokens").isNull() | F.exists("tokens", lambda w: F.contains(F.lower("party"), w))
    rows = rows.crossJoin(F.broadcast(readers.fear(t.benchmark_prices.select("trade_date", (F.col("close") % 9 + 12).alias("close"))).select("vix")))
    rows = rows.withColumns({"materiality_pct": signals.materiality(F.col("won"), F.col("market_cap")), "buyback_pct": signals.materiality(F.col("back"), F.col("market_cap")), "is_regional_match": fits})
    return signals.conviction(rows)


@query(f"WITH {FEAT.replace(SLOPE, EXACT).replace('ORDER BY pledge_date DESC, seq DESC)', 'ORDER BY pledge_date DESC, seq DESC, pledged DESC)')} SELECT scrip_code, conviction, breakdown FROM cv", F_)
def conviction(t):
    return _convictions(t).select("scrip_code", "conviction", "breakdown")


@query(f"WITH {FEAT} SELECT a.id, scrip_code, event_date, conviction FROM announcements a JOIN cv USING (scrip_code) JOIN niches n USING (scrip_code) JOIN fundamentals f USING (scrip_code) WHERE is_contract AND score IS NOT NULL AND conviction >= 4 AND cin <> '' AND NOT (coalesce(de > 5, false) OR coalesce(ocf < 0, false) OR (de IS NULL AND ocf IS NULL))", (*F_, "niches", "fundamentals"))
def contract_alerts(t):
    sound = t.fundamentals.filter(signals.fundamentals_pass(F.col("de"), F.col("ocf"))[0]).join(t.niches.filter("cin <> ''"), "scrip_code", "left_semi").select("scrip_code")
    rows = _convictions(t).filter((F.col("conviction") >= 4) & F.col("alpha_score").isNotNull()).join(whole_side(sound), "scrip_code", "left_semi").select("scrip_code", "conviction")
    return t.announcements.filter("is_contract").join(rows, "scrip_code").select("id", "scrip_code", "event_date", "conviction")


@query(f"WITH {CONNECTIONS}{TOP} SELECT a.scrip_code, b.scrip_code AS competitor, coalesce(tb.score, 0) AS score FROM companies a JOIN companies b ON a.sector = b.sector AND a.scrip_code <> b.scrip_code JOIN top ta ON ta.scrip_code = a.scrip_code LEFT JOIN top tb ON tb.scrip_code = b.scrip_code WHERE ta.score >= 0.75 AND coalesce(tb.score, 0) < 0.75", ("companies", *CHAIN))
def pair_trades(t):
    top = graph.top_connections(_connections(t)).select("scrip_code", "score")
    a = t.companies.join(top.filter("score >= 0.75"), "scrip_code").select("scrip_code", "sector")
    b = t.companies.join(top, "scrip_code", "left").select(F.col("scrip_code").alias("competitor"), "sector", F.coalesce("score", F.lit(0.0)).alias("score")).filter("score < 0.75")
    return a.join(b, "sector").filter("scrip_code <> competitor").select("scrip_code", "competitor", "score")


@query("WITH f AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 6.0::DOUBLE END AS de, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice - 1000 END AS ocf FROM part) SELECT p_partkey, NOT (coalesce(de > 5, false) OR coalesce(ocf < 0, false) OR (de IS NULL AND ocf IS NULL)) AS passes, concat_ws(',', CASE WHEN de > 5 THEN 'debt' END, CASE WHEN ocf < 0 THEN 'cash flow' END, CASE WHEN de IS NULL AND ocf IS NULL THEN 'no data' END) AS reasons FROM f")
def fundamental_gate(t):
    f = t.part.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 6.0).alias("de"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") - 1000).alias("ocf"))
    passes, reasons = signals.fundamentals_pass(F.col("de"), F.col("ocf"))
    return f.select("p_partkey", passes.alias("passes"), reasons.alias("reasons"))


@query("WITH c AS (SELECT scrip_code, name, 'sector' AS source, market_cap FROM companies WHERE sector < 'K' UNION ALL SELECT scrip_code, name, 'donor', market_cap FROM companies WHERE sector >= 'K' AND scrip_code::BIGINT IN (SELECT donor FROM donations)), b AS (SELECT * FROM c WHERE market_cap BETWEEN 50 AND 1000000), n AS (SELECT scrip_code, count(*) AS contracts FROM announcements WHERE is_contract GROUP BY 1) SELECT b.scrip_code, source, coalesce(contracts, 0) AS contracts FROM b LEFT JOIN n USING (scrip_code) WHERE source = 'donor' OR contracts >= 1", ("companies", "donations", "announcements"))
def watchlist_funnel(t):
    donors = t.donations.select(F.col("donor").cast("string").alias("scrip_code")).distinct()
    found = t.companies.filter("sector < 'K'").withColumn("source", F.lit("sector")).unionByName(t.companies.filter("sector >= 'K'").join(donors, "scrip_code", "left_semi").withColumn("source", F.lit("donor")))
    n = t.announcements.filter("is_contract").groupBy("scrip_code").agg(F.count("id").alias("contracts"))
    rows = found.filter("market_cap BETWEEN 50 AND 1000000").join(n, "scrip_code", "left").filter("source = 'donor' OR contracts >= 1")
    return rows.select("scrip_code", "source", F.coalesce("contracts", F.lit(0)).alias("contracts"))


@query(f"WITH {CONNECTIONS}{TOP}, pg AS (SELECT scrip_code, seq, quantity FROM deals WHERE side = 'SELL' AND quantity > 45) SELECT pg.scrip_code, pg.seq, pg.quantity, score FROM pg JOIN top USING (scrip_code) WHERE score >= 0.75", (*CHAIN, "deals"))
def pledge_alerts(t):
    return t.deals.filter("side = 'SELL' AND quantity > 45").select("scrip_code", "seq", "quantity").join(graph.top_connections(_connections(t)).filter("score >= 0.75").select("scrip_code", "score"), "scrip_code")


@query(
    f"""WITH {CONNECTIONS}{TOP}, x AS (SELECT scrip_code, volume, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS d, count(*) OVER w AS n, row_number() OVER (PARTITION BY scrip_code ORDER BY trade_date DESC) AS k FROM prices
WINDOW w AS (PARTITION BY scrip_code ORDER BY trade_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT scrip_code, score FROM x JOIN top USING (scrip_code) JOIN companies USING (scrip_code) WHERE k = 1 AND n = 14 AND in_watchlist AND score >= 0.5 AND d > 0 AND (volume - m) / d > 0.5""",
    ("companies", *CHAIN, "prices"),
)
def volume_alerts(t):
    spikes = indicators.volume_spike(t.prices, z=0.5).filter("is_spike").select("scrip_code")
    return graph.top_connections(_connections(t)).filter("score >= 0.5").join(spikes, "scrip_code").join(t.companies.filter("in_watchlist").select("scrip_code"), "scrip_code").select("scrip_code", "score")


# --- portfolio -------------------------------------------------------------------------------------------------------


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 8 AS p, l_quantity AS w, l_tax * 200 + 1 AS l FROM lineitem), k AS (SELECT *, (p - (1 - p) / (w / l)) * 100 AS full_ FROM x) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN p > 0 AND full_ > 0 THEN least(full_ * 0.5, 5) ELSE 0 END, 4) AS kelly FROM k")
def kelly_size_all(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(portfolio.kelly_pct(F.col("l_discount") * 8, F.col("l_quantity"), F.col("l_tax") * 200 + 1), 4).alias("kelly"))


@query(
    """WITH x AS (SELECT o_orderkey, o_orderstatus = 'O' AS b, o_totalprice / 100 AS p, 10 AS q FROM orders), y AS (SELECT *, p * CASE WHEN b THEN 1.005::DOUBLE ELSE 0.995 END * q AS t FROM x),
z AS (SELECT *, round(t * 0.001::DOUBLE, 2) AS stt, round(t * 0.0000325::DOUBLE, 2) AS txn, round(t * 0.000001::DOUBLE, 2) AS sebi, CASE WHEN b THEN round(t * 0.00015::DOUBLE, 2) ELSE 0 END AS stamp, CASE WHEN b THEN 0 ELSE 15.93::DOUBLE END AS dp FROM y)
SELECT o_orderkey, stt, txn, stamp, round((txn + sebi) * 0.18::DOUBLE, 2) AS gst, round(stt + txn + sebi + stamp + round((txn + sebi) * 0.18::DOUBLE, 2) + dp, 2) AS total FROM z"""
)
def trade_costs(t):
    c = portfolio.costs(F.col("o_totalprice") / 100, F.lit(10), F.col("o_orderstatus") == "O")
    return t.orders.select("o_orderkey", *[c[k].alias(k) for k in ("stt", "txn", "stamp", "gst", "total")])


@query(f"WITH {TECH} SELECT a.id, CASE WHEN close < atr_b THEN 'stop' WHEN date_diff('day', event_date, DATE '2001-11-04') >= 90 THEN 'held' END AS reason FROM (SELECT *, stop * 3 AS atr_b FROM tech) JOIN announcements a USING (scrip_code) WHERE is_contract", ("prices", "announcements"))
def exits(t):
    ta = indicators.technical_score(t.prices).select("scrip_code", "close", (F.col("atr_stop") * 3).alias("stop"))
    return t.announcements.filter("is_contract").join(ta, "scrip_code").select("id", portfolio.exit_reason(F.col("close"), F.col("stop"), F.col("event_date"), F.lit("2001-11-04").cast("date")).alias("reason"))


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey AS account, o_orderkey AS seq, o_totalprice / 1000 AS price, CASE WHEN o_orderkey % 10 >= 8 THEN 0.25 WHEN o_orderkey % 10 >= 6 THEN 0.15 WHEN o_orderkey % 10 >= 4 THEN 0.05 ELSE 0 END::DOUBLE AS share, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
f AS (SELECT DISTINCT account, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS quantity, 0::DOUBLE AS spent, 100000::DOUBLE AS cash FROM o UNION ALL
  SELECT account, k, seq, q, q * price * 1.005::DOUBLE, cash - q * price * 1.005::DOUBLE FROM (SELECT f.account, o.k, o.seq, price, cash, CASE WHEN cash * share >= 1000 AND price > 0 THEN floor(0.99::DOUBLE * (cash * share) / (price * 1.005::DOUBLE)) ELSE 0 END::BIGINT AS q FROM f JOIN o ON o.account = f.account AND o.k = f.k + 1))
SELECT account, seq, quantity, round(spent, 2) AS spent, round(cash, 2) AS cash FROM f WHERE k > 0"""
)
def paper_trading_fold(t):
    """Every customer an account."""
    o = t.orders.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_orderkey") % 10).alias("conviction"))
    return portfolio.paper_trades(o)


# --- statistics and models -------------------------------------------------------------------------------------------


@query("WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN rn <= n - 3 * (n // 4) THEN 0 ELSE (rn - (n - 3 * (n // 4)) - 1) // (n // 4) + 1 END::INT AS fold FROM x")
def walk_forward_folds(t):
    return stats.folds(t.orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "fold")


# --- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s")
def events_session(t):
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("event_id").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT user_id, event_type, ts::DATE AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def events_dedup(t):
    return t.events.groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.min("event_id").alias("event_id"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2")
def events_stream_daily(t):
    from tidemark.streaming import streams

    return streams.daily_counts(t.spark, t.sf_dir)
