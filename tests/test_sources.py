"""Readers on small files."""

from pyspark.sql import functions as F

from tidemark.sources import readers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


def test_listing(spark, tmp_path):
    path = put(tmp_path, "l.csv", "﻿SYMBOL , NAME OF COMPANY, SERIES, ISIN NUMBER\nAA, Alpha Ltd , EQ,INE1\nBB,Beta,BE,INE2\n")
    assert [tuple(r) for r in readers.listing(spark, path).select("symbol", "name", "isin").collect()] == [("AA", "Alpha Ltd", "INE1")]


def test_bonds(spark, tmp_path):
    path = put(tmp_path, "b.csv", 'Date of Purchase,Purchaser Name,Denomination\n12-Apr-19,A Ltd,"1,00,00,000"\n13-Apr-19,B Ltd,\n')
    assert [tuple(r) for r in readers.bond_purchases(spark, path).collect()] == [("A Ltd", 1e7, 2019)]
    path = put(tmp_path, "e.csv", 'Date,"Name of the\nPolitical Party",Denomination\nx,P,"10,00,000"\n')
    assert [tuple(r) for r in readers.bond_encashments(spark, path).collect()] == [("P", 1e6)]


def test_announcements(spark, tmp_path):
    put(tmp_path, "p1.json", '{"Table": [{"SCRIP_CD": "1", "NEWSSUB": "Award of order", "NEWS_DT": "2024-05-01T10:00:00", "CATEGORYNAME": "x"}]}')
    put(tmp_path, "p2.json", '[{"SCRIP_CD": "2", "NEWSSUB": "t", "NEWS_DT": null}]')
    assert sorted(r.scrip_code for r in readers.announcements(spark, f"file://{tmp_path}/p*.json").collect()) == ["1", "2"]


def test_directors(spark):
    html = "<table><tr><th>S</th><th>DIN/PAN</th><th>Name</th><th>Designation</th></tr><tr><td>1</td><td>1234567</td><td>RAJ KUMAR</td><td>Director</td></tr><tr><td>2</td><td>x</td><td>y</td><td>z</td></tr></table>"
    df = spark.createDataFrame([(html,), ("<p>none</p>",), (None,)], "html string")
    assert [tuple(r) for r in readers.directors(df).collect()] == [("01234567", "Raj Kumar", "Director")]


def test_headlines_and_amounts(spark):
    feed = spark.createDataFrame([("a", 1, "War looms", ""), ("b", 2, "War looms", ""), ("a", 3, "Nothing", "calm seas")], "feed string, published int, title string, summary string")
    assert readers.headlines(feed, "macro").count() == 1
    row = spark.range(1).select(readers.first_amounts(F.array(F.lit("1"), F.lit("Some Donor Ltd"), F.lit("25,00,000"))).alias("x")).first().x
    assert (row.donor, row.amount) == ("Some Donor Ltd", 2.5e6)
    a, b = spark.createDataFrame([("c1", 1)], "cin string, v int"), spark.createDataFrame([("c1", 2), ("c2", 3)], "cin string, v int")
    assert {(r.cin, r.v) for r in readers.ranked([a, b], "cin").collect()} == {("c1", 1), ("c2", 3)}


def test_pages_of_many_companies_share_files(spark, tmp_path):
    """Files and partitions follow shelves of companies, not companies; a landing that skips a shelf loses nothing of the next."""
    import glob
    from types import SimpleNamespace

    from tidemark.plans import landed

    companies = spark.range(600).select(F.col("id").cast("string").alias("scrip_code"))
    told = spark.range(600 * 30).select((F.col("id") % 600).cast("string").alias("scrip_code"), "id", F.lit(1.5).alias("value"), F.lit("2001-01-01").cast("date").alias("event_date"), F.lit(True).alias("is_contract"))
    t = SimpleNamespace(spark=spark, companies=companies, announcements=told)
    landed._land_pages(t, str(tmp_path / "a"), 0, lambda p: p >= 0)
    assert len(glob.glob(f"{tmp_path}/a/*/*/*.json")) == 3
    rows = spark.read.format(landed._paged(t, str(tmp_path / "a"))).load()
    assert rows.rdd.getNumPartitions() == 3
    assert rows.agg(F.count("id"), F.sum("id"), F.countDistinct("scrip_code")).first()[:] == (18000, 18000 * 17999 // 2, 600)
    t.announcements = told.filter("id < 600 OR scrip_code = '7'")
    landed._land_pages(t, str(tmp_path / "b"), 1, lambda p: p > 0)
    assert spark.read.format(landed._paged(t, str(tmp_path / "b"))).load().count() == 10


def test_paged_stream_numbers_pages_once(spark):
    """The two landings share one reading of the announcements, and each run of the stream ends by itself, with every page read once."""
    from types import SimpleNamespace

    from tidemark.plans import landed

    read = []

    class Told(SimpleNamespace):
        @property
        def announcements(self):
            read.append(1)
            return self.spark.range(600 * 30).select((F.col("id") % 600).cast("string").alias("scrip_code"), "id", F.lit(1.5).alias("value"), F.lit("2001-01-01").cast("date").alias("event_date"), F.lit(True).alias("is_contract"))

    t = Told(spark=spark, companies=spark.range(600).select(F.col("id").cast("string").alias("scrip_code")))
    assert landed.paged_stream(t).agg(F.count("n"), F.sum("n"), F.sum("ids")).first()[:] == (600, 18000, 18000 * 17999 // 2)
    assert len(read) == 1 and not spark.streams.active


def test_html_rows_in_slices():
    """A batch's cells are never all Python objects at once."""
    import tracemalloc

    import pyarrow as pa

    page = "<table>" + "".join(f"<tr><td>name {i}</td><td>{i} Lakh</td></tr>" for i in range(40)) + "</table>"
    pages = pa.array([page, None, ""] * 1000)
    tracemalloc.start()
    rows = readers.html_rows.func(pages)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [len(r) for r in rows.to_pylist()] == [40, 0, 0] * 1000
    assert peak < 5_000_000
