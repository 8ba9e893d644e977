"""Readers of landed files: listings and bonds as CSV, paged JSON, HTML tables, disclosures; each returns plain columns."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.functions.text import bond_year, debt_to_equity, rupees


def csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV with a header, all columns as trimmed strings under trimmed names without a byte-order mark; a header field may span lines."""
    df = spark.read.csv(path, header=True, multiLine=multi_line)
    names = [" ".join(c.replace("﻿", "").split()) for c in df.columns]
    df = df.toDF(*names)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in names])


#: Column roles by words of a header; the first that fits.
ROLES = {"isin": ("isin",), "industry": ("industry",), "symbol": ("symbol",), "name": ("company", "name"), "series": ("series",)}


def by_role(df: DataFrame, roles: dict[str, tuple[str, ...]] = ROLES) -> DataFrame:
    """Columns renamed by the role that their header's words give them; the rest go."""
    found: dict[str, str] = {}
    for c in df.columns:
        for role, words in roles.items():
            if role not in found and any(w in c.lower() for w in words):
                found[role] = c
                break
    return df.select(*[F.col(f"`{c}`").alias(r) for r, c in found.items()])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The listed equities of a listing file (series EQ)."""
    df = by_role(csv(spark, path))
    return df.filter(F.upper("series") == "EQ") if "series" in df.columns else df


def announcements(spark: SparkSession, path: str, as_of: Column | None = None, lookback_days: int | None = None) -> DataFrame:
    """Landed pages of announcements: objects with a Table array, or arrays themselves; of the last lookback_days up to as_of, where given.

    A daily poll reads the newest pages with a short lookback, a backfill all pages with one of five years.
    """
    item = "array<struct<SCRIP_CD:string,NEWSSUB:string,NEWS_DT:string,CATEGORYNAME:string>>"
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.coalesce(F.from_json("value", f"struct<Table:{item}>")["Table"], F.from_json("value", item))).alias("x"))
    out = rows.select(F.col("x.SCRIP_CD").alias("scrip_code"), F.col("x.NEWSSUB").alias("title"), F.try_to_timestamp("x.NEWS_DT").cast("date").alias("event_date"), F.col("x.CATEGORYNAME").alias("category"))
    return out if lookback_days is None else out.filter(F.col("event_date").between(F.date_sub(as_of, lookback_days), as_of))


def company_headers(rows: DataFrame, text: str = "json") -> DataFrame:
    """rows with scrip_code, sector, industry, igroup, isub of a company's header as JSON: the new industry, or else the old; headers without a code go."""
    fields = ("SecurityCode", "Sector", "IndustryNew", "Industry", "IGroup", "ISubGroup")
    x = F.from_json(text, ", ".join(f"{f} string" for f in fields))
    head = rows.withColumn("__x", x).filter(F.coalesce("__x.SecurityCode", F.lit("")) != "")
    industry = F.coalesce(F.nullif("__x.IndustryNew", F.lit("")), F.nullif("__x.Industry", F.lit("")))
    return head.select(*rows.columns, F.col("__x.SecurityCode").alias("scrip_code"), F.col("__x.Sector").alias("sector"), industry.alias("industry"), F.col("__x.IGroup").alias("igroup"), F.col("__x.ISubGroup").alias("isub"))


# Where a page states an exchange's code of six digits.
CODE_LINK, CODE_TEXT, CODE_QUOTE = r"bseindia\.com/stock-share-price/[^/]+/[^/]+/(\d{6})/?", r"BSE:\s*(\d{6})", r"href='[^']*?/(\d{6})/'"


def scrip_code_of_page(html: Column) -> Column:
    """The code in a company page's link to the exchange, or else in its text; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (CODE_LINK, CODE_TEXT)])


def scrip_code_of_search(html: Column) -> Column:
    """The code in the first link of a quote search's answer; null without one."""
    return F.nullif(F.regexp_extract(html, CODE_QUOTE, 1), F.lit(""))


def bond_purchases(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    pick = lambda *names: F.coalesce(*[F.col(f"`{c}`") for c in names if c in df.columns])
    return df.select(pick("Purchaser Name", "Name of the Purchaser").alias("donor"), rupees(pick("Denomination", "Denominations")).alias("amount"), bond_year(pick("Date of Purchase", "Journal Date")).alias("year")).filter("coalesce(amount, 0) <> 0")


def bond_encashments(spark: SparkSession, path: str) -> DataFrame:
    """party, amount of bonds encashed; a header field of the file spans two lines."""
    df = csv(spark, path, multi_line=True)
    return df.select(F.col("`Name of the Political Party`").alias("party"), rupees(F.col("Denomination")).alias("amount"))


def deals(spark: SparkSession, path: str) -> DataFrame:
    """Bulk and block deals: symbol and client are needed, a file that has no records gives none."""
    df = csv(spark, path).filter("Symbol <> '' AND `Client Name` <> '' AND NOT upper(Symbol) LIKE '%NO RECORDS%'")
    number = lambda c: F.regexp_replace(F.col(c), ",", "").try_cast("double")
    return df.select("Symbol", F.col("`Client Name`").alias("client"), F.upper("`Buy/Sell`").alias("side"), number("`Quantity Traded`").cast("long").alias("quantity"), number("`Trade Price / Wght. Avg. Price`").alias("price"))


def disclosures(spark: SparkSession, *paths: str) -> DataFrame:
    """Insider filings of several forms in one table; columns that a form lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.json(p) for p in paths])


def ranked(sources: list[DataFrame], key: str, fresh: DataFrame | None = None) -> DataFrame:
    """The rows of the first source that has a key, key by key. fresh: keys for which the first source, a cache, is recent enough to be asked."""
    out = sources[0] if fresh is None else sources[0].join(fresh.select(key).distinct(), key, "left_semi")
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


#: Pages whose rows are Python lists at once; a batch has many more.
PAGES = 256


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def html_rows(html: pa.Array) -> pa.Array:
    """The rows of all tables of a page, in Arrow batches; pages without one give an empty array."""

    def parse(x):
        p = _Tables()
        p.feed(x or "")
        return [r for r in p.rows if r]

    kind = pa.list_(pa.list_(pa.string()))
    parts = [pa.array([parse(x) for x in html.slice(lo, PAGES).to_pylist()], kind) for lo in range(0, len(html), PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def directors(pages: DataFrame, html: str = "html", current: bool = False) -> DataFrame:
    """din, name, designation from pages with a table whose header names them; numbers of 7 or 8 digits, padded to 8.

    current: only rows whose end date is '-' or blank, where the header has such a column.
    """
    rows = pages.withColumn("__rows", html_rows(F.col(html))).withColumn("__head", F.transform(F.try_element_at(F.filter("__rows", lambda r: F.exists(r, lambda c: F.upper(c).contains("DIN"))), F.lit(1)), F.upper)).filter("__head IS NOT NULL")

    def at(word: str) -> Column:
        return F.array_position(F.transform("__head", lambda c: c.contains(word)), True).cast("int") - 1

    end = F.array_position(F.transform("__head", lambda c: c.contains("END") & c.contains("DATE")), True).cast("int") - 1
    cells = rows.select(at("DIN").alias("d"), at("NAME").alias("n"), at("DESIGNATION").alias("g"), end.alias("e"), F.explode("__rows").alias("r"))
    if current:
        cells = cells.filter(F.coalesce(F.get("r", F.col("e")), F.lit("-")).isin("-", ""))
    din = F.get("r", F.col("d"))
    return cells.filter(din.rlike(r"^\d{7,8}$")).select(F.lpad(din, 8, "0").alias("din"), F.initcap(F.get("r", F.col("n"))).alias("name"), F.get("r", F.col("g")).alias("designation"))


# Parts of a header that give a donations table's column its role, the first role that fits.
DONOR_ROLES = (("donor", ("donor", "contributor", "company")), ("amount", ("amount", "contribution", "rs")), ("party", ("party", "recipient")), ("trust", ("trust", "electoral trust")))


def donor_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """donor, amount, party, trust from pages with a table whose first row names a donor's and an amount's column.

    Of columns with one role the last counts; party and trust are blank without a column. Rows without a donor or with
    no amount (or 0) go.
    """
    rows = pages.select(html_rows(F.col(html)).alias("rows")).filter(F.size("rows") > 0).select(F.transform(F.col("rows")[0], F.lower).alias("head"), F.explode(F.slice("rows", 2, 2_147_483_647)).alias("r"))

    def role(header: Column) -> Column:
        found = None
        for name, words in reversed(DONOR_ROLES):
            fits = F.lit(False)
            for w in words:
                fits = fits | F.contains(header, F.lit(w))
            found = F.when(fits, F.lit(name)).otherwise(F.lit(None) if found is None else found)
        return found

    roles = F.transform("head", role)
    last = lambda name: F.size("head") - F.array_position(F.reverse(roles), name).cast("int")
    cell = lambda name: F.when(F.array_contains(roles, name), F.get("r", last(name)))
    out = rows.select(cell("donor").alias("donor"), rupees(cell("amount")).alias("amount"), F.coalesce(cell("party"), F.lit("")).alias("party"), F.coalesce(cell("trust"), F.lit("")).alias("trust"))
    return out.filter("donor <> '' AND coalesce(amount, 0) <> 0")


def director_records(rows: DataFrame, text: str = "json") -> DataFrame:
    """din, name, designation of an open-data answer's records; field names in small letters or capitals, numbers of 7 or 8 digits, padded to 8."""
    records = rows.select(F.explode(F.from_json(text, "records array<map<string,string>>")["records"]).alias("r"))
    pick = lambda c, d: F.coalesce(F.try_element_at("r", F.lit(c)), F.try_element_at("r", F.lit(c.upper())), F.lit(d))
    out = records.select(pick("din", "").alias("din"), pick("director_name", "Unknown").alias("name"), pick("designation", "").alias("designation"))
    return out.filter(F.col("din").rlike(r"^\d{7,8}$")).select(F.lpad("din", 8, "0").alias("din"), F.initcap("name").alias("name"), "designation")


def price_bars(wanted: DataFrame, bars: DataFrame, suffixes: tuple[str, str] = (".NS", ".BO"), least: int = 50) -> DataFrame:
    """scrip_code, trade_date, close of wanted(scrip_code, symbol): the bars of ticker symbol + first suffix, or else of scrip_code + the second.

    A code that starts with ^ is an index, whose ticker is the code itself. Series of fewer than least bars go.
    """
    code, symbol = F.col("scrip_code"), F.col("symbol")
    tickers = F.when(code.startswith("^"), F.array(code)).otherwise(F.array(F.concat(symbol, F.lit(suffixes[0])), F.concat(code, F.lit(suffixes[1]))))
    asked = wanted.select("scrip_code", F.posexplode(tickers).alias("rank", "ticker")).filter("ticker IS NOT NULL")
    sizes = asked.join(bars.groupBy("ticker").agg(F.count("close").alias("n")), "ticker")
    best = sizes.groupBy("scrip_code").agg(F.min(F.struct("rank", "ticker", "n")).alias("x")).filter(F.col("x.n") >= least)
    return bars.join(best.select("scrip_code", F.col("x.ticker").alias("ticker")), "ticker").select("scrip_code", "trade_date", "close")


def operating_cash_flow(lines: DataFrame) -> DataFrame:
    """scrip_code, ocf of lines(scrip_code, line, label, period, value): the newest period of the first line whose label has 'operating' and 'cash'."""
    own = lines.filter(F.lower("label").contains("operating") & F.lower("label").contains("cash"))
    first = own.groupBy("scrip_code").agg(F.min("line").alias("line"))
    return own.join(first, ["scrip_code", "line"]).groupBy("scrip_code").agg(F.max_by("value", "period").alias("ocf"))


def fear(index: DataFrame, level: float = 22.0, default: float = 15.0) -> DataFrame:
    """One row vix, is_high_fear: the last close of index(trade_date, close), or the default without rows."""
    vix = F.coalesce(F.max_by("close", "trade_date"), F.lit(default))
    return index.agg(vix.alias("vix")).select("vix", (F.col("vix") > level).alias("is_high_fear"))


#: An object without objects inside, cut off at the end of a text or not; braces in its strings are none.
_OBJECT = r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*(?:\}|$)'


def node_link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (id, kind) and edges (src, dst, kind) of a graph in node-link JSON, as large as it may be: a file, or a folder of files that follow each other.

    The document is cut after each object, so that its parts are read and parsed by as many tasks as the file has
    splits. Objects in its lists have plain values, and no text in them holds a brace before a comma.
    """
    shape = "id string, node_type string, source string, target string, edge_type string"
    found = spark.read.option("lineSep", "},").text(path).select(F.explode(F.regexp_extract_all("value", F.lit(_OBJECT), F.lit(0))).alias("o"))
    each = found.select(F.from_json(F.concat(F.rtrim("o"), F.when(F.rtrim("o").endswith("}"), "").otherwise("}")), shape).alias("x"))
    vertices = each.filter("x.id IS NOT NULL").select("x.id", F.col("x.node_type").alias("kind"))
    return vertices, each.filter("x.source IS NOT NULL AND x.target IS NOT NULL").select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), F.col("x.edge_type").alias("kind"))


# How a director's number, and a name before it, stand in running text.
TEXT_DIN = r"(?:DIN|Director.*?Identification)\s*[:\-]?\s*(\d{7,8})"
TEXT_NAME_DIN = r"(?s)(?:Name|Director)\s*[:\-]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+).*?DIN\s*[:\-]?\s*(\d{7,8})"


def directors_in_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """din, name, designation ('') from the text of pages that have no table of them: names followed by their numbers, or else numbers alone ('Unknown')."""
    head = F.exists(html_rows(F.col(html)), lambda r: F.exists(r, lambda c: F.upper(c).contains("DIN")))
    text = pages.filter(~head).select(F.regexp_replace(html, "<[^>]*>", "").alias("t"))
    named = F.arrays_zip(F.regexp_extract_all("t", F.lit(TEXT_NAME_DIN), F.lit(2)).alias("din"), F.regexp_extract_all("t", F.lit(TEXT_NAME_DIN), F.lit(1)).alias("name"))
    alone = F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(TEXT_DIN), F.lit(1))), lambda d: F.struct(d.alias("din"), F.lit("Unknown").alias("name")))
    found = text.select(named.alias("named"), alone.alias("alone")).select(F.explode(F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("alone"))).alias("x"))
    return found.select(F.lpad("x.din", 8, "0").alias("din"), F.initcap("x.name").alias("name"), F.lit("").alias("designation"))


def fundamentals(wanted: DataFrame, answers: DataFrame, lines: DataFrame) -> DataFrame:
    """scrip_code, debt_to_equity, market_cap, ocf of wanted(scrip_code, symbol), from answers(ticker, json) and the lines of cash-flow statements.

    The answer of code.BO counts if it has a market price, else that of symbol.NS (code.NS without a symbol). A company
    without either has no row.
    """
    tickers = F.array(F.concat("scrip_code", F.lit(".BO")), F.concat(F.coalesce("symbol", "scrip_code"), F.lit(".NS")))
    told = answers.select("ticker", F.from_json("json", "regularMarketPrice double, debtToEquity double, marketCap double, totalDebt double, totalStockholderEquity double").alias("i")).filter("i.regularMarketPrice IS NOT NULL")
    first = wanted.select("scrip_code", F.posexplode(tickers).alias("rank", "ticker")).join(told, "ticker").groupBy("scrip_code").agg(F.min_by("i", "rank").alias("i"))
    ratio = debt_to_equity(F.col("i.debtToEquity"), F.col("i.totalDebt"), F.col("i.totalStockholderEquity"))
    return first.select("scrip_code", ratio.alias("debt_to_equity"), F.col("i.marketCap").alias("market_cap")).join(operating_cash_flow(lines), "scrip_code", "left")


def exit_commands(messages: DataFrame, chat: str) -> DataFrame:
    """scrip_code of each '/exit <code>' in messages(chat, text) of one chat."""
    own = messages.filter((F.col("chat") == chat) & F.lower(F.trim("text")).startswith("/exit"))
    return own.select(F.try_element_at(F.split(F.trim("text"), r"\s+"), F.lit(2)).alias("scrip_code")).filter("scrip_code IS NOT NULL")


def gated(sources: list[DataFrame], least: tuple[int, ...]) -> DataFrame:
    """The sources in turn until there are enough rows: source i + 1 is taken only if those before have fewer than least[i]."""
    out = sources[0]
    for source, n in zip(sources[1:], least, strict=True):
        if out.limit(n).count() >= n:
            break
        out = out.unionByName(source, allowMissingColumns=True)
    return out


def first_amounts(rows: Column, least: float = 10_000.0) -> Column:
    """Of a report's row: its first text of over 5 characters and its first amount over least, or null."""
    text = F.try_element_at(F.filter(rows, lambda c: (F.length(c) > 5) & rupees(c).isNull()), F.lit(1))
    amount = F.try_element_at(F.filter(F.transform(rows, lambda c: rupees(c)), lambda a: a > least), F.lit(1))
    return F.when(F.size(F.filter(rows, lambda c: rupees(c) > least)) > 0, F.struct(text.alias("donor"), amount.alias("amount")))


FEED_KEYWORDS = {
    # Words that make a headline relevant, as parts of words too.
    "policy": ("pli", "scheme", "mandate", "cabinet", "policy", "subsidy", "approved", "approval", "incentive", "monetization"),
    "macro": ("war", "tariffs", "ban", "subsidy", "crisis", "rate", "fed", "rbi", "inflation", "conflict", "pandemic", "shortage", "sanctions", "strike"),
}


def headlines(feed: DataFrame, kind: str, per_feed: int = 10) -> DataFrame:
    """The newest headlines of each feed (feed, published, title, summary), each title once, of those that a keyword fits."""
    newest = feed.withColumn("__k", F.expr("row_number() OVER (PARTITION BY feed ORDER BY published DESC, title)")).filter(F.col("__k") <= per_feed).drop("__k")
    words = "|".join(FEED_KEYWORDS[kind])
    return newest.dropDuplicates(["title"]).filter(F.lower("title").rlike(words) | F.lower("summary").rlike(words))
