"""The relations of event-signal analysis as views over the star-schema tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.similarity import whole_side
from tidemark.operators.tables import fine

#: By view: its SQL, in the dialect that Spark and DuckDB share. Later views may use earlier ones.
VIEWS = {
    "companies": """
        SELECT CAST(s_suppkey AS STRING) AS scrip_code, s_name AS name, concat('INE', lpad(CAST(s_suppkey AS STRING), 9, '0')) AS isin,
               concat('L', lpad(CAST(s_suppkey AS STRING), 8, '0')) AS cin, n_name AS sector, r_name AS region,
               s_acctbal AS market_cap, s_suppkey % 3 <> 0 AS in_watchlist
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "announcements": """
        SELECT o_orderkey AS id, CAST(k AS STRING) AS scrip_code, CAST(o_orderdate AS DATE) AS event_date,
               o_orderpriority = '1-URGENT' AS is_contract, o_orderpriority = '2-HIGH' AS is_board_change, o_totalprice AS value
        FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY l_orderkey) w ON o_orderkey = l_orderkey""",
    "directors": "SELECT p_partkey AS din, p_name AS name, p_size % 7 = 0 AS is_bureaucrat FROM part",
    "company_boards": """
        SELECT DISTINCT l_partkey AS din, CAST(l_suppkey AS STRING) AS scrip_code
        FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45""",
    "donor_boards": """
        SELECT DISTINCT l_partkey AS din, o_custkey AS donor
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 45""",
    "donations": """
        SELECT o_orderkey AS id, o_custkey AS donor, o_orderpriority AS trust, c_mktsegment AS party, o_totalprice AS amount,
               CAST(year(o_orderdate) AS INT) AS donated
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "ticks": """
        SELECT CAST(l_suppkey AS STRING) AS scrip_code, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS p, l_quantity AS q
        FROM lineitem""",
    "prices": """
        SELECT scrip_code, trade_date, min(p) AS open, max(p) AS high, min(p) AS low, (max(p) + min(p)) / 2 AS close, sum(q) AS volume
        FROM ticks GROUP BY scrip_code, trade_date""",
    "benchmark_prices": "SELECT trade_date, (max(p) + min(p)) / 2 AS close FROM ticks GROUP BY trade_date",
    "deals": """
        SELECT l_orderkey * 10 + l_linenumber AS seq, CAST(l_suppkey AS STRING) AS scrip_code, CAST(l_shipdate AS DATE) AS deal_date, c_name AS client,
               CASE l_returnflag WHEN 'N' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'OTHER' END AS side, l_linestatus = 'O' AS at_market,
               c_mktsegment = 'HOUSEHOLD' AS is_promoter, l_quantity AS quantity, l_extendedprice AS price, l_discount * 100 AS pct
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    # some clients bear a tracked investor's name, its words in another order or misspelt, an institution's, or a register name with more words or misspelt
    "bulk_deals": """
        SELECT seq, scrip_code, deal_date, side, quantity, price,
               CASE seq % 97 WHEN 0 THEN 'Kacholia Ashish' WHEN 1 THEN 'Vijay Kedia' WHEN 2 THEN 'Sunrise Mutual Fund' WHEN 3 THEN 'dolly khanna huf'
               WHEN 4 THEN 'Vijay Kediaa' WHEN 5 THEN 'nation_7 trading co' WHEN 6 THEN 'natiom_12' WHEN 7 THEN 'kachol as' ELSE client END AS client
        FROM deals""",
    "holdings": """
        SELECT l_orderkey * 10 + l_linenumber AS seq, CAST(l_suppkey AS STRING) AS scrip_code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter_date,
               CASE l_orderkey % 11 WHEN 0 THEN 'Sunil Singhania & others' WHEN 1 THEN 'VIJAY KEDIA' ELSE concat('Holder ', CAST(l_orderkey % 11 AS STRING)) END AS investor,
               l_linenumber = 1 AS is_new, l_discount * 100 AS holding_pct
        FROM lineitem""",
    "niches": """
        SELECT scrip_code, name, in_watchlist, lower(concat(region, ' ', sector)) AS niche, CASE WHEN CAST(scrip_code AS INT) % 9 = 0 THEN '' ELSE cin END AS cin FROM companies""",
    "pledges": """
        SELECT l_orderkey * 10 + l_linenumber AS seq, CAST(l_suppkey AS STRING) AS scrip_code, CAST(l_shipdate AS DATE) AS pledge_date,
               CASE l_returnflag WHEN 'R' THEN 'Released' ELSE 'Created' END AS action, l_quantity AS pct_change, l_discount * 300 AS pledged
        FROM lineitem""",
    "tenders": """
        SELECT o_orderkey AS tender_id, CASE WHEN s_suppkey % 3 = 0 THEN concat('Q', CAST(o_orderkey AS STRING), ' zz') WHEN o_orderkey % 2 = 0 THEN concat(s_name, ' Ltd') ELSE concat(upper(s_name), ' Limited') END AS winner,
               o_totalprice AS value, CAST(o_orderdate AS DATE) AS awarded, o_orderstatus = 'F' AS processed
        FROM orders JOIN supplier ON s_suppkey = o_custkey""",
    "donors": """
        SELECT o_orderkey AS seq, c_name AS donor_name, CASE o_orderkey % 13 WHEN 0 THEN NULL ELSE o_orderpriority END AS trust_name, CAST(year(o_orderdate) AS INT) AS donated,
               o_orderstatus AS source, o_totalprice AS amount, c_mktsegment AS party, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE concat('D', CAST(o_custkey AS STRING)) END AS donor_cin
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fundamentals": """
        SELECT CAST(s_suppkey AS STRING) AS scrip_code, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 40) / 6.0 END AS de, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS ocf
        FROM supplier""",
    "held": """
        SELECT CAST(l_suppkey AS STRING) AS scrip_code, max(l_quantity) / 50 AS alpha_score, max(CAST(l_shipdate AS DATE)) AS alert_date
        FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey""",
}
#: The prices again, for windows that sort series several times: ticks are dealt finely by scrip, once for days and windows.
VIEWS["series"] = VIEWS["prices"]
#: The order in which views build on each other.
NEEDS = {"prices": ("ticks",), "series": ("ticks",), "benchmark_prices": ("ticks",), "bulk_deals": ("deals",), "niches": ("companies",)}
#: Tables of views whose files are many times smaller than their rows: Spark's size check would send them whole through the driver.
LARGE = ("customer", "orders", "part")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


class Tables:
    """The tables of a folder and the views over them, as DataFrames by attribute; nothing is read until used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                used = {t: getattr(self, t) for t in (*TABLES, *NEEDS.get(name, ())) if t in VIEWS[name].replace(",", " ").split()}
                sql = VIEWS[name]
                for t in used:
                    sql = _swap(sql, t)
                used |= {t: whole_side(d) for t, d in used.items() if t in LARGE}
                if name == "series":
                    used["ticks"] = fine(used["ticks"], "scrip_code")
                self._made[name] = self.spark.sql(sql, **used)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def _swap(sql: str, table: str) -> str:
    """A table after FROM or JOIN becomes a named DataFrame argument."""
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {table} ", f"{word} {{{table}}} ").replace(f"{word} {table}\n", f"{word} {{{table}}}\n")
        if sql.endswith(f"{word} {table}"):
            sql = sql[: -len(table)] + f"{{{table}}}"
    return sql


def with_views(sql: str, *views: str) -> str:
    """DuckDB SQL that starts with the views it uses; more WITH parts may follow them."""
    every: list[str] = []
    for v in views:
        every += [x for x in (*NEEDS.get(v, ()), v) if x not in every]
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in every)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
