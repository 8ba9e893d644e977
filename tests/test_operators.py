"""Golden cases and properties of the operators on small literals."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import entity, graph, indicators, portfolio, signals, stats, tables
from tidemark.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("5.2 Crore", 5.2e7), ("52.5 Cr", 5.25e8), ("1 crore", 1e7), ("10 Lakh", 1e6), ("50 lakhs", 5e6), ("5,00,00,000", 5e7), ("₹ 10,00,000", 1e6), ("", None), (None, None)])
def test_rupees(spark, text, want):
    got = one(spark, X.rupees(F.lit(text).cast("string")))
    assert got == want or got == pytest.approx(want)


@pytest.mark.parametrize(("name", "want"), [("ABC Infra Projects Ltd.", "abc infra projects"), ("", ""), (None, ""), ("A.B.C. & Co", "a b c &")])
def test_normal_name(spark, name, want):
    assert one(spark, X.normal_name(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Award of Order worth ₹450 Cr from Indian Railways", "contract"),
        ("Tender Award - Supply of transformers", "contract"),
        ("New Work Order from Metro Rail Corporation", "contract"),
        ("Appointment of Mr. X as Independent Director", "board_change"),
        ("Resignation of Company Secretary", "board_change"),
        ("Order of NCLT approving award", None),
        ("Contract for supply of defence equipment to MoD", None),
        ("Financial results", None),
    ],
)
def test_announcement_kind(spark, title, want):
    assert one(spark, X.announcement_kind(F.lit(title))) == want


@pytest.mark.parametrize(("text", "want"), [("12-Apr-19", 2019), ("03-Oct-23", 2023), ("2024-01-15", 2024), (None, 2023)])
def test_bond_year(spark, text, want):
    assert one(spark, X.bond_year(F.lit(text).cast("string"))) == want


def test_scalars(spark):
    assert one(spark, X.debt_to_equity(F.lit(150.0), F.lit(None), F.lit(None))) == 1.5
    assert one(spark, X.debt_to_equity(F.lit(None).cast("double"), F.lit(4.0), F.lit(2.0))) == 2.0
    assert one(spark, X.director_number(F.lit("1234567"))) == "01234567"
    assert one(spark, X.director_number(F.lit("12"))) is None
    assert one(spark, X.stars(F.lit(0.03))) == "**"
    assert one(spark, X.months_until(F.lit(2029), F.lit(4), F.lit("2028-04-30").cast("date"))) == 12
    assert one(spark, X.fenced_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.money(F.lit(2.5e7))) == "2.50 Cr"
    assert one(spark, X.event_date(F.lit("2024-05-01T10:00:00"), F.lit("2000-01-01").cast("date"))) == date(2024, 5, 1)
    assert one(spark, X.event_date(F.lit("??"), F.lit("2000-01-01").cast("date"))) == date(2000, 1, 1)


def test_company_upsert(spark):
    old = spark.createDataFrame([("1", "a", "C1", 10.0), ("2", "b", "C2", 20.0)], "k string, name string, cin string, cap double")
    new = spark.createDataFrame([("1", "A", None, 1000.0), ("3", "c", "", None)], "k string, name string, cin string, cap double")
    got = {r.k: tuple(r)[1:] for r in tables.merge(old, new, ["k"], overwrite=("name",), blank_is_null=("cin",)).collect()}
    assert got == {"1": ("A", "C1", 1000.0), "2": ("b", "C2", 20.0), "3": ("c", None, None)}
    again = tables.merge(tables.merge(old, new, ["k"], ("name",), ("cin",)), new, ["k"], ("name",), ("cin",))
    assert {r.k: tuple(r)[1:] for r in again.collect()} == got


def test_insert_absent_and_latest(spark):
    old = spark.createDataFrame([("1", "x")], "k string, t string")
    new = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "k string, t string")
    assert tables.insert_absent(old, new, ["k", "t"]).count() == 2
    rows = spark.createDataFrame([("d", 1, 5.0), ("d", 2, 7.5)], "d string, id int, amount double")
    assert tables.latest(rows, ["d"], "id").first().amount == 7.5


def test_connection_score(spark):
    company = spark.createDataFrame([(1, "540001"), (2, "540001"), (3, "540002")], "din long, scrip_code string")
    donor = spark.createDataFrame([(1, 9)], "din long, donor long")
    given = spark.createDataFrame([(1, 9, "Prudent", "BJP", 5e7, 2025), (2, 8, "Prudent", "BJP", 5e6, 2024)], "id long, donor long, trust string, party string, amount double, donated int")
    directors = spark.createDataFrame([(i, "n", False) for i in (1, 2, 3)], "din long, name string, is_bureaucrat boolean")
    rows = graph.connections(company, donor, given, directors, 2026).collect()
    assert [(r.scrip_code, r.din, r.seats, r.score) for r in rows] == [("540001", 1, 2, 0.51)]


def series(n, seed=1):
    rng, p, out = random.Random(seed), 100.0, []
    for i in range(n):
        p = max(1.0, p + rng.uniform(-3, 3))
        out.append(("s", date(2020, 1, 1) + timedelta(days=i), p, p + rng.random(), p - rng.random(), p, float(rng.randrange(1, 1000))))
    return out


@pytest.mark.parametrize("n", [40, 2300])
def test_averages_match_pandas(spark, n):
    import pandas as pd

    rows = series(n)
    df = spark.createDataFrame(rows, "scrip_code string, trade_date date, open double, high double, low double, close double, volume double")
    close = pd.Series([r[5] for r in rows])
    got = indicators.macd(df).orderBy("rn").toPandas()
    want = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    assert (got["macd"] - want).abs().max() < 1e-9
    d = close.diff()
    gain, loss = (x.ewm(com=13, min_periods=14).mean() for x in (d.where(d > 0, 0.0), (-d).where(d < 0, 0.0)))
    rsi = indicators.rsi(df).orderBy("rn").toPandas()["rsi"]
    assert (rsi - (100 - 100 / (1 + gain / loss))).abs().max() < 1e-9


def test_portfolio(spark):
    assert one(spark, portfolio.kelly_pct(F.lit(0.6), F.lit(10.0), F.lit(5.0))) == 5.0
    c = portfolio.costs(F.lit(100.0), F.lit(100), F.lit(True))
    assert [one(spark, c[k]) for k in ("stt", "txn", "sebi", "stamp", "gst", "total")] == [10.05, 0.33, 0.01, 1.51, 0.06, 11.96]
    orders = spark.createDataFrame([("a", 1, 100.0, 8), ("a", 2, 50.0, 6), ("a", 3, 10.0, 1)], "account string, seq long, price double, conviction int")
    got = {r.seq: r for r in portfolio.paper_trades(orders).collect()}
    assert got[1].quantity == math.floor(0.99 * 25000 / 100.5)
    assert got[2].quantity == math.floor(0.99 * 0.15 * got[1].cash / 50.25)
    assert got[3].quantity == 0


def test_signals(spark):
    deals = spark.createDataFrame([(1, "s", "A", "BUY", True, 10.0), (2, "s", "B", "BUY", True, 5.0), (3, "s", "B", "SELL", True, 9.0), (4, "t", "C", "BUY", True, 100000.0), (5, "u", "D", "BUY", False, 9e9)], "seq long, scrip_code string, client string, side string, at_market boolean, quantity double")
    got = {r.scrip_code: r for r in signals.insider_cluster(deals).collect()}
    assert set(got) == {"t"} and got["t"].is_whale
    passes, reasons = signals.fundamentals_pass(F.lit(6.0), F.lit(-1.0))
    assert one(spark, passes) is False and one(spark, reasons) == "debt,cash flow"


def test_ratios():
    assert entity.sorted_ratio("tata steel", "steel tata") == 100.0
    assert entity.ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert entity.set_ratio("rail works", "rail works india") == 100.0
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "xy")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert entity.lcs(a, b) == t[-1][-1]


def test_t_tail():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert stats.t_tail(0.0, 5) == pytest.approx(1.0)
    assert stats.t_tail(12.706, 1) == pytest.approx(0.05, rel=1e-3)


def test_prune_is_idempotent(spark):
    v = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, kind string")
    e = spark.createDataFrame([("a", "b", "k")], "src string, dst string, kind string")
    once = graph.pruned(v, e)
    assert sorted(r.id for r in once.collect()) == ["a", "b"] == sorted(r.id for r in graph.pruned(once, e).collect())


def test_boosting_settings():
    """The queries train the reference's 50 rounds with both penalties, and the search has all its 324 settings."""
    from tidemark.operators import boosting

    assert boosting.Setting() == boosting.Setting(depth=2, step=0.05, l2=5.0, l1=1.0, rounds=50, least=1.0)
    assert len(boosting.DEPTHS) * len(boosting.STEPS) * len(boosting.L2) * len(boosting.L1) * len(boosting.ROUNDS) == 324


# --- inference, state and streams ------------------------------------------------------------------------------------


def t_tail_by_sums(t, df, steps=200_000):
    """Two-sided tail of Student's t by the midpoint rule on the angle."""
    from math import atan, cos, pi, sqrt

    a = atan(abs(t) / sqrt(df))
    upper = sum(cos(a + (i + 0.5) * (pi / 2 - a) / steps) ** (df - 1) for i in range(steps)) * (pi / 2 - a)
    whole = sum(cos((i + 0.5) * pi / 2 / steps) ** (df - 1) for i in range(steps)) * pi / 2
    return upper / whole


def test_p_values(spark):
    from tidemark.operators import stats

    for t, df in ((0.3, 4.0), (2.1, 9.5), (-1.7, 250.0), (6.0, 3.0)):
        assert abs(stats.t_tail(t, df) - t_tail_by_sums(t, df)) < 1e-6
    rows = spark.createDataFrame([(2.1, 9.5), (0.0, 5.0), (None, 3.0), (1.0, None)], "t double, df double")
    got = [r.p for r in rows.select(stats.p_value("t", "df").alias("p")).collect()]
    assert abs(got[0] - t_tail_by_sums(2.1, 9.5)) < 1e-6 and got[1:] == [1.0, 1.0, 1.0]


def test_ols_inference(spark):
    import random

    import numpy as np

    from tidemark.operators import stats

    rng = random.Random(4)
    data = [(a := rng.random(), b := rng.gauss(3, 2), 1 + 2 * a - 0.5 * b + rng.gauss(0, 1)) for _ in range(60)]
    got = {r.term: r for r in stats.ols2_inference(spark.createDataFrame(data, "a double, b double, y double"), "y", "a", "b").collect()}
    x = np.array([[1, a, b] for a, b, _ in data])
    y = np.array([c for *_, c in data])
    coef = np.linalg.solve(x.T @ x, x.T @ y)
    rest = y - x @ coef
    sigma2 = rest @ rest / (len(y) - 3)
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(x.T @ x)))
    r2 = 1 - rest @ rest / ((y - y.mean()) @ (y - y.mean()))
    for k, term in enumerate(("const", "a", "b")):
        r = got[term]
        assert abs(r.coef - coef[k]) < 1e-8 and abs(r.se - se[k]) < 1e-8 and abs(r.r2 - r2) < 1e-8
        assert abs(r.p - t_tail_by_sums(coef[k] / se[k], len(y) - 3, 20_000)) < 1e-5
        reach = (r.high - r.low) / 2 / se[k]
        assert abs(t_tail_by_sums(reach, len(y) - 3, 20_000) - 0.05) < 1e-5
    f = r2 / 2 / ((1 - r2) / (len(y) - 3))
    assert abs(got["a"].f - f) < 1e-6 and 0 <= got["a"].f_p < 1e-3


def test_donor_upsert(spark):
    """A key with a null never equals another; a null cin keeps the one before; amount and party are replaced."""
    from tidemark.operators import tables

    shape = "seq long, donor_name string, trust_name string, donated int, source string, amount double, party string, donor_cin string"
    old = spark.createDataFrame([(1, "A", "T", 2020, "s", 1.0, "p", "c1"), (2, "B", None, 2020, "s", 2.0, "p", None)], shape)
    new = spark.createDataFrame([(3, "A", "T", 2020, "s", 5.0, None, None), (4, "B", None, 2020, "s", 7.0, "q", "c2"), (5, "C", "T", 2021, "s", 8.0, "q", None)], shape)
    got = sorted((r.donor_name, r.amount, r.party, r.donor_cin) for r in tables.merge_null_never_equal(old, new, ["donor_name", "trust_name", "donated", "source"], "seq", ("donor_cin",)).collect())
    assert got == [("A", 5.0, None, "c1"), ("B", 2.0, "p", None), ("B", 7.0, "q", "c2"), ("C", 8.0, "q", None)]


def test_held_positions(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from tidemark.operators import tables

    held = spark.createDataFrame([("1", 0.5, date(2024, 1, 1), date(2024, 6, 29)), ("2", 0.6, date(2024, 5, 1), date(2024, 10, 28))], "scrip_code string, alpha_score double, alert_date date, expires date")
    new = tables.hold(held, spark.createDataFrame([("1", None, date(2024, 6, 1))], "scrip_code string, alpha_score double, alert_date date"))
    assert {r.scrip_code: (r.alpha_score, r.expires) for r in new.collect()} == {"1": (None, date(2024, 11, 28)), "2": (0.6, date(2024, 10, 28))}
    left, gone = tables.expired(new, F.lit("2024-10-28").cast("date"))
    assert [r.scrip_code for r in left.collect()] == ["1"] and gone.first().removed == 1
    flags = spark.createDataFrame([(1, None), (2, True), (3, False)], "id long, done boolean")
    assert {r.id: r.done for r in tables.marked(flags, spark.createDataFrame([(3,), (3,)], "id long"), "id", "done").collect()} == {1: None, 2: True, 3: True}


def test_tracked_names(spark):
    from tidemark.operators import entity

    names = ["kacholia ashish", "Some Fund", "MEGHA WORKS LTD", "nobody at all", "VIJAY KEDIAA", None, "NOBODY AT ALL"]
    donors = ["MEGHA WORKS", "Future Gaming"]
    got = {r.client: r.why for r in entity.tracked_names(spark.createDataFrame([(n,) for n in names], "client string"), spark.createDataFrame([(d,) for d in donors], "name string")).collect()}
    want = {}
    for n in {x for x in names if x}:
        up = n.upper()
        if max(entity.set_ratio(s, up) for s in entity.SUPERSTARS) > 90:
            want[n] = "superstar"
        elif any(w in up for w in entity.INSTITUTIONS):
            want[n] = "institution"
        elif max(entity.set_ratio(up, d) for d in donors) >= 75:
            want[n] = "donor"
    assert got == want and set(want.values()) == {"superstar", "institution", "donor"}


def test_tender_winners(spark):
    from difflib import SequenceMatcher

    from tidemark.operators import entity

    companies = [("1", "Alpha Builders Ltd"), ("2", "Beta Steel Limited"), ("3", "Gamma Rail Systems Ltd")]
    winners = ["ALPHA BUILDERS", "Beta Steels Limited", "Gama Rail System", "Quite Another"]
    clean = lambda x: x.lower().replace(" ltd", "").replace(" limited", "").strip()
    got = {r.winner: r.scrip_code for r in entity.tender_winners(spark.createDataFrame(list(enumerate(winners)), "tender_id long, winner string"), spark.createDataFrame(companies, "scrip_code string, name string")).collect()}
    want = {}
    for w in winners:
        score, code = max((SequenceMatcher(None, clean(w), clean(n)).ratio(), c) for c, n in companies)
        if score >= 0.8:
            want[w] = code
    assert got == want and len(want) == 3


def test_last_name_wins(spark):
    from tidemark.operators import entity

    register = spark.createDataFrame([("Alpha Ltd", 9.0, 1), ("ALPHA LIMITED", 1.0, 2)], "name string, weight double, seq long")
    assert entity.resolve(spark.createDataFrame([("alpha",)], "name string"), register).first().match == "ALPHA LIMITED"


def test_streams_resume_and_expire(spark, tmp_path):
    """A second run reads only what is new; stretches end when the watermark passes them."""
    from datetime import datetime

    from tidemark.streaming import streams

    shape = "scrip_code string, ts timestamp"
    put = lambda n, rows: spark.createDataFrame([(k, datetime.fromisoformat(d)) for k, d in rows], shape).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")  # noqa: E731, ARG005
    put(1, [("1", "2023-01-01"), ("1", "2023-05-01"), ("2", "2023-02-01")])
    run = lambda: streams.drained(streams.held_spans(spark.readStream.schema(shape).parquet(f"file://{tmp_path}/in"), late="1 day"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    run()
    put(2, [("3", "2024-06-01")])
    run()
    put(3, [("3", "2024-06-02")])
    run()
    got = {(r.scrip_code, r.since.date().isoformat(), r.expires.date().isoformat(), r.alerts) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("1", "2023-01-01", "2023-10-28", 2), ("2", "2023-02-01", "2023-07-31", 1)}


def test_model_answers(spark):
    from tidemark.functions.answers import answered

    def model(prompts):
        if "boom" in prompts:
            raise RuntimeError
        return ["```json\n{\"a\": 1}\n```" if p == "x" else "not json" for p in prompts]

    rows = spark.createDataFrame([("x",), ("y",), (None,)], "p string").coalesce(1)
    assert {r.p: r.answer and r.answer.a for r in answered(rows, "p", model, "a int").collect()} == {"x": 1, "y": None, None: None}
    failed = answered(spark.createDataFrame([("boom",)], "p string"), "p", model, "a int", '{"a": 7}')
    assert failed.first().answer.a == 7


@pytest.mark.parametrize("n", [5, 14, 60, 2300])
def test_last_day_fold(spark, n):
    """The fold over a series' last rows gives what the windows give on its last day."""
    df = spark.createDataFrame(series(n, 3), "scrip_code string, trade_date date, open double, high double, low double, close double, volume double")
    got = indicators.technical_score(df).first()
    last = lambda d, *c: [d.orderBy(F.desc("rn")).first()[x] for x in c]
    (rsi,) = last(indicators.rsi(df), "rsi")
    hist, bullish = last(indicators.macd_bullish(indicators.macd(df)), "macd_hist", "macd_bullish")
    (stop,) = last(indicators.atr(df), "atr_stop")
    (slope,) = last(indicators.obv_slope(indicators.obv(indicators.numbered(df))), "obv_slope")
    assert got.rsi == pytest.approx(rsi) if rsi is not None else got.rsi is None
    assert got.macd_hist == pytest.approx(hist) and got.atr_stop == pytest.approx(stop)
    assert got.ta_score >= (2 if bullish else 0) + (2 if slope is not None and slope > 0 else 0)


def test_sink_counts_once(spark, tmp_path):
    """A batch that fails after its write and is run again, and polls that find nothing, leave the same totals."""
    from pyspark.sql import DataFrame

    from tidemark.streaming import streams

    home, shape = f"file://{tmp_path}", "kind string, n long, batch long"
    put = lambda rows: spark.createDataFrame([(k,) for k in rows], "kind string").coalesce(1).write.mode("append").parquet(f"{home}/in")
    kinds = spark.createDataFrame([("a",), ("b",)], "kind string")
    run = lambda: streams.polled(spark.readStream.schema("kind string").parquet(f"{home}/in"), kinds, "kind", f"{home}/out", f"{home}/state")
    told = lambda: {(r.kind, r.batch): r.n for r in streams.stored_batches(spark, f"{home}/out", shape).collect()}
    assert told() == {}
    put("aab")
    real, failed = streams.put_batch, []

    def once(rows: DataFrame, out: str, number: int) -> None:
        real(rows, out, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("after the write")

    streams.put_batch = once
    try:
        with pytest.raises(Exception, match="after the write"):
            run()
        run()
    finally:
        streams.put_batch = real
    assert failed == [0] and told() == {("a", 0): 2, ("b", 0): 1}
    run()
    run()
    put("b")
    run()
    assert told() == {("a", 0): 2, ("b", 0): 1, ("a", 1): 0, ("b", 1): 1, **{(k, -i): 0 for k in "ab" for i in (1, 2)}}


def test_late_rows_are_told(spark, tmp_path):
    """Within one load nothing is late, in whatever order files stand; what a later load brings too late is counted."""
    from datetime import datetime

    from tidemark.streaming import streams

    home, shape = f"file://{tmp_path}", "event_id long, ts timestamp"
    put = lambda *rows: spark.createDataFrame([(i, datetime.fromisoformat(d)) for i, d in rows], shape).coalesce(1).write.mode("append").parquet(f"{home}/events.parquet")
    put((1, "2024-03-01"))
    put((2, "2024-01-01"), (1, "2024-03-01"))
    run = lambda: streams.drained(streams.unique_events(streams.landed(spark, home, "events"), ["event_id"]).select("event_id"), f"{home}/out", f"{home}/state")
    assert run() == 0
    put((3, "2024-02-01"), (4, "2024-03-02"))
    assert run() == 1
    assert sorted(r.event_id for r in spark.read.parquet(f"{home}/out").collect()) == [1, 2, 4]


def test_stretches_merge_in_any_order():
    from tidemark.streaming.held import merged

    assert merged([], [400, 0, 180], 180) == [(0, 180, 2), (400, 400, 1)]
    assert merged([(0, 180, 2), (400, 400, 1)], [300], 180) == [(0, 400, 4)]
    assert merged([(0, 0, 1)], [181], 180) == [(0, 0, 1), (181, 181, 1)]


def test_keyed_merge(spark, tmp_path):
    """A merge writes the buckets of its own rows alone; of two runs from one commit the second fails and changes nothing."""
    from tidemark.operators import keyed, tables

    table = keyed.Keyed(spark, f"file://{tmp_path}/t", ["k"], 8)
    one = lambda old, new: tables.merge(old, new, ["k"], overwrite=("v",))
    shape = "k long, v string"
    assert table.read(shape).count() == 0
    table.merge(spark.range(100).selectExpr("id AS k", "'old' AS v"), one)
    before = table.head()[1]
    changed = table.merge(spark.createDataFrame([(3, "new"), (1000, "new")], shape), one)
    after = table.head()[1]
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in changed} and len(changed) <= 2
    got = {r.k: r.v for r in table.read(shape).collect()}
    assert len(got) == 101 and {k for k, v in got.items() if v == "new"} == {3, 1000}
    other = keyed.Keyed(spark, f"file://{tmp_path}/t", ["k"], 8)
    stale = other.head()
    other.head = lambda: stale
    table.merge(spark.createDataFrame([(5, "first")], shape), one)
    with pytest.raises(keyed.Changed):
        other.merge(spark.createDataFrame([(5, "second")], shape), one)
    assert {r.v for r in table.read(shape).filter("k = 5").collect()} == {"first"}
    assert table.merge(spark.createDataFrame([], shape), one) == []


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5])
def test_paths_between(spark, hops):
    rng = random.Random(hops)
    edges = {(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}") for _ in range(16)} | {("v0", "v1"), ("v1", "v0"), ("v2", "v2")}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = []

    def walk(path):
        if len(path) > 1 and path[-1] in ends:
            want.append(tuple(path))
        if len(path) <= hops:
            for n in near.get(path[-1], ()):
                if n not in path:
                    walk([*path, n])

    starts, ends = ["v0", "v3", "none"], {"v1", "v5", "v3", "other"}
    for s in starts:
        walk([s])
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    got = [(tuple(r.path), r.length) for r in graph.paths_between(frame, ids(starts), ids(sorted(ends)), hops).collect()]
    assert sorted(p for p, _ in got) == sorted(want) and all(n == len(p) - 1 for p, n in got)


def test_accounts_across_batches(spark):
    """Accounts that batches cut give what they give whole, and no account is gathered as a group."""
    orders = spark.createDataFrame([(a, k, 100.0 + 7 * k, 4 + k % 6) for a in (None, 1, 2, 3) for k in range(9)], "account long, seq long, price double, conviction int")
    whole = sorted(map(str, portfolio.paper_trades(orders).collect()))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        cut = portfolio.paper_trades(orders)
        assert sorted(map(str, cut.collect())) == whole
    finally:
        spark.conf.set(name, before)
    assert "FlatMapGroupsInPandas" not in cut._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in portfolio.paper_trades(orders).collect():
        by.setdefault(r.account, []).append((r.seq, r.quantity, r.spent, r.cash))
    assert len(by) == 4 and all(sorted(x) == sorted(by[1]) for x in by.values())


def test_averages_of_a_series_share_a_sort(spark):
    """A task holds each sort of its series: by day, and by block for all averages; a day's lag after them is a third."""
    from tidemark.operators import indicators

    rows = spark.createDataFrame([("1", date(2024, 1, 1 + i), float(i % 7)) for i in range(30)], "scrip_code string, trade_date date, close double")
    sorts = lambda df: sum(line.strip(" :+-").startswith("Sort [") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert [sorts(x) for x in (indicators.macd(rows), indicators.rsi(rows), indicators.macd_bullish(indicators.macd(rows)))] == [2, 2, 3]
    assert indicators.macd(rows).columns == [*rows.columns, "rn", "macd", "macd_signal", "macd_hist"] and indicators.rsi(rows).columns == [*rows.columns, "rn", "rsi"]


def test_held_stream_reads_its_alerts_once(spark):
    """The years land from alerts that are worked out once, not anew for each year."""
    from types import SimpleNamespace

    from tidemark.plans import models

    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda i: seen.add(1) or True, "boolean").asNondeterministic()
    days = F.date_add(F.lit("1999-01-01").cast("date"), (F.col("id") * 400).cast("int"))
    rows = spark.range(4).select(F.lit("7").alias("scrip_code"), days.alias("event_date"), told("id").alias("is_contract"))
    got = models.held_stream(SimpleNamespace(spark=spark, announcements=rows)).collect()
    assert (len(got), seen.value) == (3, 4)


@pytest.mark.parametrize("name", ["macd", "macd_bullish", "rsi", "atr_stop"])
def test_series_dealt_once(spark, sf_dir, name):
    """Days and windows of a series share one shuffle, into more parts than others have and a number that stays."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange") == 1
    assert "REPARTITION_BY_NUM" in plan and f", {4 * int(spark.conf.get('spark.sql.shuffle.partitions'))})" in plan


def test_insert_absent_dealt_finely(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k long, v string")
    out = tables.insert_absent(old, new, ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
