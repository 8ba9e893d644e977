"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal
import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from tidemark.plans import alerts, catalog, landed, learned, matching, models, state  # noqa: F401

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in NAMES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in catalog.SQL:
        told = duck.execute(catalog.SQL[name])
        names = [d[0] for d in told.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in told.fetchall())


@pytest.mark.parametrize(("name", "count"), [("kelly_size_all", "count(*) FROM lineitem"), ("director_upsert_all", "count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem"), ("event_props_all", "count(*) FROM events")])
def test_whole_tables(spark, sf_dir, duck, name, count):
    assert catalog.QUERIES[name](spark, sf_dir).count() == duck.execute(f"SELECT {count}").fetchone()[0]


@pytest.mark.parametrize("name", ["technical_score", "conviction"])
def test_level_volume_has_no_sign(duck, name):
    """A series that reads the same both ways has a slope of 0, not of some last digit."""
    rng, rows = random.Random(3), []
    for k in range(60):
        half = [rng.randrange(-400, 400) for _ in range(5)]
        rows += [f"('s{k}', {i}, {300 + i}, {90000 + v}::DOUBLE)" for i, v in enumerate(half + half[::-1])]
    slope = re.search(r"\bl AS \(SELECT scrip_code, CASE.*? GROUP BY scrip_code\)", catalog.SQL[name]).group()
    told = duck.execute(f"WITH o AS (SELECT * FROM (VALUES {', '.join(rows)}) v(scrip_code, trade_date, rn, obv)), {slope} SELECT slope FROM l").fetchall()
    assert [x for (x,) in told] == [0] * 60


def test_spans_are_numbered_in_one_order(duck):
    """Alerts of one day come in the order that says where a stretch starts: every window has the whole of it."""
    assert set(re.findall(r"ORDER BY (\w+(?:, \w+)*)", catalog.SQL["held_spans"])) == {"event_date, id"}


def test_no_large_table_is_sent_whole(spark, sf_dir):
    """Files of customers, orders and parts are many times smaller than their rows: no view may take them for a small side, which the driver would have to hold."""
    from tidemark.operators import graph, signals
    from tidemark.plans.bindings import Tables

    t = Tables(spark, sf_dir)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (t.deals, t.donors, t.donor_boards, t.announcements, signals.tracked_buys(t.bulk_deals, t.deals.select("client"))):
        assert "BroadcastExchange" not in plan(df)
    for part in plan(graph.top_connections(catalog._connections(t))).split("BroadcastExchange")[1:]:
        assert not re.search("p_partkey|c_custkey|o_orderkey", next(line for line in part.splitlines() if "Scan " in line))


def test_graph_json_is_written_in_parts(spark, sf_dir, monkeypatch):
    """No task sorts and writes the whole document."""
    plans, land = [], landed.land
    monkeypatch.setattr(landed, "land", lambda df, *args: plans.append(df._jdf.queryExecution().executedPlan().toString()) or land(df, *args))
    catalog.QUERIES["graph_json"](spark, sf_dir)
    (plan,) = plans
    assert "Coalesce" not in plan and "rangepartitioning(k" in plan


def test_graph_in_several_files(spark, tmp_path):
    """Files that hold a part each, the head alone too, are one graph."""
    from tidemark.sources import readers

    parts = ['{"directed": true, "nodes": [', '{"id": "1", "node_type": "Director {"},\n{"id": "2", "node_type": "Director {"}', '], "links": [', '{"source": "1", "target": "a", "edge_type": "X"},', '{"source": "2", "target": "a", "edge_type": "X"}\n]}']
    for i, text in enumerate(parts):
        (tmp_path / f"part-{i}.txt").write_text(text + "\n")
    v, e = readers.node_link_graph(spark, str(tmp_path))
    assert sorted(r.id for r in v.collect()) == ["1", "2"] and sorted(r.src for r in e.collect()) == ["1", "2"]
