import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.missing import Reading
from tidemark.operators.hot_deck import hot_deck, marked_cells
from tidemark.operators.known_at import Tree, known_at
from tidemark.operators.profile import Check, add_loads, column_states, merge_states, out_of_control, state_metrics
from tidemark.operators.regrid import calendar_cells, regrid
from tidemark.operators import spikes
from tidemark.operators.spikes import Measure, implausible, robust_pca
from tidemark.operators.trailing import trailing

D0 = date(2024, 1, 1)
NAN, INF = float("nan"), float("inf")


def day(n):
    return None if n is None else D0 + timedelta(days=n)


# hot deck ---------------------------------------------------------------------------------------------------
DECK = "row_id long, k string, g string, date date, v double, s string, v_filled int"


def deck(spark, rows):
    return spark.createDataFrame([(i, k, g, day(d), v, s, 7) for i, (k, g, d, v, s) in enumerate(rows)], DECK)


def filled(spark, rows, **kw):
    x = hot_deck(deck(spark, rows), {"v": Reading(low=0.0), "s": Reading()}, row_id="row_id", date="date", within="k", levels=("g", ""), **kw)
    return {r["row_id"]: r for r in x.collect()}


def brute_deck(rows, i):
    k, g, d, v, s = rows[i]
    ok = lambda x: x is not None and x == x and x >= 0 and x != INF and x != -9999.0
    if ok(v):
        return v, None
    for name, same in (("k", lambda r: r[0] == k), ("g", lambda r: r[1] == g), ("all", lambda r: True)):
        donors = [(abs(r[2] - d), r[2] > d, r[2], j, r[3]) for j, r in enumerate(rows) if same(r) and r[2] is not None and d is not None and ok(r[3])]
        if donors:
            return min(donors)[:3], name
    return None, None


def test_hot_deck_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.choice("xy"), r.randint(0, 400), r.choice([None, NAN, -9999.0, -1.0, INF, 1.5, 2.5, 3.5]), r.choice([None, "nan", " ", "p"])) for _ in range(150)]
    rows += [("d", "x", r.randint(0, 400), None, None) for _ in range(10)] + [("e", "z", r.randint(0, 400), NAN, None) for _ in range(5)]
    for kw in ({"block_days": 30}, {"rows_per_block": 5}, {"block_days": 7, "rows_per_block": 1}):
        check_deck(rows, filled(spark, rows, **kw))


def check_deck(rows, got):
    for i, row in enumerate(rows):
        want, level = brute_deck(rows, i)
        g = got[i]
        assert g["v_was_missing"] == (level is not None) and g["v_donor_level"] == level
        if level is None:
            assert g["v_filled"] == want and g["v_distance"] is None
        else:
            assert (g["v_distance"], g["v_donor_date"]) == (want[0], day(want[2])), (i, row, g)
            assert any(x[3] == g["v_filled"] and x[2] == want[2] for x in rows)
    assert all(got[i]["s_was_missing"] == (rows[i][4] != "p") for i in got)


def test_hot_deck_nulls_and_empties(spark):
    rows = [(None, None, None, None, None), (None, None, None, 4.0, "q"), ("a", "x", None, None, None), ("a", "x", 3, 2.0, "w"), (None, "x", 5, None, None)]
    got = filled(spark, rows)
    assert got[0]["v_filled"] == 4.0  # of its own group without a date
    assert got[2]["v_filled"] is None and got[2]["v_was_missing"] and got[2]["v_donor_level"] is None
    assert (got[4]["v_filled"], got[4]["v_donor_level"], got[4]["v_distance"]) == (2.0, "g", 2)
    assert filled(spark, []) == {}
    nobody = filled(spark, [("a", "x", 1, None, None), ("b", "x", 2, NAN, None)])
    assert all(r["v_filled"] is None and r["v_was_missing"] for r in nobody.values())


def test_hot_deck_of_one_field(spark):
    df = spark.createDataFrame([("r1", "a", day(0), None), ("r2", "b", day(3), 1.0), (None, "b", day(4), None)], "row_id string, k string, date date, v double")
    got = {r["row_id"]: (r["v_filled"], r["v_donor_level"], r["v_distance"]) for r in hot_deck(df, ["v"], row_id="row_id", date="date", within="k", levels=("",)).collect()}
    assert got == {"r1": (1.0, "all", 3), "r2": (1.0, None, None), None: (1.0, "k", 1)}


def test_marked_cells(spark):
    x = hot_deck(deck(spark, [("a", "x", 1, None, "p"), ("a", "x", 2, 1.0, None)]), ["v", "s"], row_id="row_id", date="date", within="k")
    assert {tuple(r) for r in marked_cells(x, ["v", "s"], "row_id").collect()} == {(0, "v"), (1, "s")}


# trailing ---------------------------------------------------------------------------------------------------
def test_trailing_against_brute_force(spark):
    r = random.Random(5)
    events = [(r.choice(["a", "b", None]), r.choice([None, *range(0, 60)]), r.choice([None, NAN, 0.5, -1.0, 2.0])) for _ in range(300)]
    events += [("c", 3, INF), ("c", 20, -INF), ("c", 4, 1.0)]
    points = [(r.choice(["a", "b", "c", "d", None]), r.choice([None, *range(-5, 90)])) for _ in range(200)]
    e = spark.createDataFrame([(k, day(d), v, 1) for k, d, v in events], "k string, date date, v double, count_7 int")
    p = spark.createDataFrame([(k, day(d), 2.0) for k, d in points], "k string, date date, mean_7 double")
    got = {(g["k"], g["date"]): g for g in trailing(e, p, entity="k", date="date", value="v", periods=(7, 30)).collect()}
    assert set(got) == {(k, day(d)) for k, d in points}
    for (k, d), g in got.items():
        for n in (7, 30):
            vs = [v for a, b, v in events if k is not None and d is not None and a == k and b is not None and v is not None and v == v and d - timedelta(days=n) <= day(b) <= d]
            assert g[f"count_{n}"] == len(vs)
            s = sum(vs) if vs else 0.0
            assert g[f"sum_{n}"] == pytest.approx(s, nan_ok=True) and g[f"mean_{n}"] == pytest.approx(s / len(vs) if vs else 0.0, nan_ok=True)


def test_trailing_empty(spark):
    e = spark.createDataFrame([], "k string, date date, v double")
    assert trailing(e, e, entity="k", date="date", value="v").count() == 0
    p = spark.createDataFrame([("a", day(1))], "k string, date date")
    assert trailing(e, p, entity="k", date="date", value="v").first()["count_30"] == 0


# profile ----------------------------------------------------------------------------------------------------
def test_states_merge_to_the_whole(spark):
    r = random.Random(7)
    rows = [(i % 4, r.choice([None, NAN, -9999.0, r.gauss(0, 1)]), r.choice([None, "FY2024Q1", "x"]), [1], 3) for i in range(400)]
    df = spark.createDataFrame(rows, "part int, v double, q string, a array<int>, n int")
    checks = {"q": Check(pattern="^FY"), "n": Check(domain=(1, 2)), "v": Check(low=-1.0)}
    parts = merge_states(column_states(df, "part", None, checks), "field")
    whole = column_states(df.withColumn("part", df["n"]), "part", ["v", "q", "a", "n"], checks)
    a = {x["field"]: x for x in state_metrics(parts).collect()}
    b = {x["field"]: x for x in state_metrics(whole).collect()}
    for f in ("v", "q", "a", "n"):
        for c in ("n_distinct", "nulls", "nans", "stand_ins", "off_pattern", "off_domain", "off_range", "used", "low", "high"):
            assert a[f][c] == b[f][c], (f, c)
        assert a[f]["mean"] == pytest.approx(b[f]["mean"]) and a[f]["sd"] == pytest.approx(b[f]["sd"])
    assert a["n"]["off_domain"] == 400 and a["q"]["off_pattern"] == sum(x[2] == "x" for x in rows)


def test_broken_loads_are_out_of_control(spark):
    r = random.Random(11)
    rows = []
    for load in range(20):
        for _ in range(300):
            v = r.gauss(0.4, 0.15)
            if load == 3 and r.random() < 0.3:
                v = None
            if load == 5:
                v = -v
            if load == 7:
                v *= 100
            if load == 9 and r.random() < 0.5:
                v = 0.25
            if load == 11 and r.random() < 0.2:
                v = -9999.0
            rows.append((load, v, "FY2024-Q1" if load == 13 and r.random() < 0.3 else "FY2024Q1"))
    df = spark.createDataFrame(rows, "part int, v double, q string")
    s = column_states(df, "part", None, {"q": Check(pattern=r"^FY\d{4}Q[1-4]$")})
    got = {(x["part"], x["field"]) for x in out_of_control(state_metrics(s, merge_states(s, "field"))).collect()}
    assert got == {(3, "v"), (5, "v"), (7, "v"), (9, "v"), (11, "v"), (13, "q")}


def test_kept_states_of_deliveries(spark, tmp_path):
    r = random.Random(13)
    rows = [(load, -1.0 if load == 12 else r.gauss(0.5, 0.1), "x" if load == 15 and r.random() < 0.1 else "FY2024Q1") for load in range(20) for _ in range(200)]
    df = spark.createDataFrame(rows, "load int, v double, q string")
    checks, at = {"q": Check(pattern=r"^FY")}, str(tmp_path / "states")
    assert add_loads(df.where("load < 9"), "load", at, None, checks).count() == 18
    # loads that are kept aren't read again: what has become of them since doesn't count
    kept = add_loads(df.withColumn("v", df["v"] + (df["load"] < 9).cast("int") * 100), "load", at, None, checks)
    assert kept.count() == 40 and kept.where("field = 'v' and part < 9").agg({"high": "max"}).first()[0] < 5
    got = {(x["part"], x["field"]) for x in out_of_control(state_metrics(kept), memory=10).collect()}
    assert got == {(12, "v"), (15, "q")}
    once = {(x["part"], x["field"]): x for x in state_metrics(column_states(df, "load", None, checks)).collect()}
    for x in state_metrics(kept).collect():
        assert x["mean"] == once[x["part"], x["field"]]["mean"] and x["n_distinct"] == once[x["part"], x["field"]]["n_distinct"]


def test_few_violations_where_there_are_none(spark):
    rows = [(load, "x" if load == 4 and i < 30 or load == 5 and i < 10 else "FY2024Q1") for load in range(10) for i in range(1000)]
    s = column_states(spark.createDataFrame(rows, "part int, q string"), "part", None, {"q": Check(pattern=r"^FY")})
    assert {x["part"] for x in out_of_control(state_metrics(s)).where("metric = 'off_pattern_rate'").collect()} == {4}  # three in a hundred, not one


def test_texts_are_watched_by_value(spark, tmp_path):
    from tidemark.plans.quality_queries import p3_alarms, p3_found

    r = random.Random(12)
    label = lambda n: f"FY{n // 4}Q{n % 4 + 1}"
    rows = []
    for load in range(24):
        tickers = [f"{b}-P{i:06}.QX" for b in ("ABCD", "EFGH") for i in range(load // 6, load // 6 + 8)]  # tickers come and go
        if load == 17:
            tickers = [f"ZZZZ-P{i:06}.QX" for i in range(16)]
        for _ in range(200):
            d = date(2020, 11, 1) + timedelta(days=60 * load + r.randrange(150))
            q = (d.year + (d.month >= 11)) * 4 + (d.month - 11) % 12 // 3
            q = {3: 2099 * 4, 7: q - 1, 11: q + r.randint(-2, 2)}.get(load, q)
            t = r.choice(tickers)
            rows.append((len(rows), d, t, t[:4], label(q), r.gauss(0.2, 0.1), r.gauss(0, 0.02), int(r.random() < 0.1), load))
    schema = "row_id long, date date, ticker string, issuer string, fiscal_quarter string, framing_gap_ffill double, td_return_5d_fwd double, is_news_burst int, load_id int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "model_features_daily.parquet"))
    assert {(g["load_id"], g["field"]) for g in p3_found(spark, str(tmp_path)).collect()} == {(3, "fiscal_quarter"), (7, "fiscal_quarter"), (11, "fiscal_quarter")}
    got = {(g["load_id"], g["field"]) for g in p3_alarms(spark, str(tmp_path)).collect()}
    assert {(17, "ticker"), (17, "issuer"), (3, "fiscal_quarter")} <= got
    assert {n for n, f in got if f in ("ticker", "issuer")} == {17}


def test_alarms_of_all_tables(spark, tmp_path):
    from tidemark.plans.quality_queries import p3_profile, p3_table_alarms

    r = random.Random(13)
    prices, annotations, documents, matrix = [], [], [], []
    for m in range(14):
        rows = 5 if m == 12 else 400 if m == 2 else 120  # a short month and a long one aren't broken
        for _ in range(rows):
            d = date(2021 + m // 12, m % 12 + 1, r.randint(1, 28))
            q = f"FY{d.year + (d.month >= 11)}Q{(d.month - 11) % 12 // 3 + 1}"
            at = f"{d}T01:00:00Z"
            price = r.gauss(50, 5)
            prices.append((d, f"{d} 01:00:00", price * 100 if m == 4 else price))
            score = None if m == 6 and r.random() < 0.5 else r.gauss(0, 0.3)
            annotations.append((str(d), at, q, ("positive", score)))
            documents.append((d, "FY2030Q1" if m == 8 else q, "the same" if m == 10 else f"text {r.randrange(10**9)}"))
            matrix.append((d, q, m))
    for name, x, schema in (
        ("prices", prices, "date date, ingested string, adj_close double"), ("documents", documents, "doc_date date, fiscal_quarter string, text string"),
        ("annotations", annotations, "date string, created_at string, fiscal_quarter string, output struct<sentiment:string,sentiment_score:double>"),
        ("model_features_daily", matrix, "date date, fiscal_quarter string, load_id int"),
    ):
        df = spark.createDataFrame(x, schema)
        df = df.selectExpr("date", "CAST(ingested AS timestamp) AS ingested_at", "adj_close") if name == "prices" else df
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(g["table_name"], g["load"], g["field"]) for g in p3_table_alarms(spark, str(tmp_path)).collect()}
    assert got == {("prices", "2021-05", "adj_close"), ("annotations", "2021-07", "output.sentiment_score"), ("documents", "2021-09", "fiscal_quarter"), ("documents", "2021-11", "text")}
    far = {(g["table_name"], g["load"]): g["distance"] for g in p3_profile(spark, str(tmp_path)).where("field = 'adj_close'").collect()}
    assert far["prices", "2021-05"] > 0.8 > 0.2 > far["prices", "2021-04"]


def test_shares_merge_to_the_whole(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i % 5, r.choice([None, *map(str, range(300))]), 0) for i in range(3000)], "part int, q string, one int").repartition(7)
    a = merge_states(column_states(df, "part", ["q"]), "field").first()["shares"]
    b = column_states(df, "one", ["q"]).first()["shares"]
    assert a == b and sum(a) == df.where("q is not null").count() and len(a) == 64


def test_profile_of_nothing(spark):
    s = column_states(spark.createDataFrame([], "part int, v double"), "part")
    assert out_of_control(state_metrics(s, merge_states(s, "field"))).count() == 0
    s = column_states(spark.createDataFrame([(None, None), (1, NAN)], "part int, v double"), "part")
    assert {x["part"] for x in state_metrics(s).collect()} == {None, 1}


# spikes -----------------------------------------------------------------------------------------------------
def faults(spark, series, kind="level", witness=None, **kw):
    rows, i = [], 0
    for k, vs in series.items():
        for d, v in enumerate(vs):
            rows.append((i, k, day(d), v, None if witness is None else witness[k][d], 1))
            i += 1
    df = spark.createDataFrame(rows, "id long, k string, date date, v double, w double, spike int")
    x = implausible(df, [Measure("v", kind, "w" if witness else None)], source="k", date="date", row_id="id", **kw)
    at, i = {}, 0
    for k, vs in series.items():
        for d in range(len(vs)):
            at[i] = (k, d)
            i += 1
    return {(*at[r["id"]], "range" if r["out_of_range"] else "spike" if r["spike"] else "stuck") for r in x.collect()}


def walk(seed, n=700, s=0.01):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, s, n)))).tolist()


def test_spikes_runs_and_ranges(spark):
    x = {k: walk(i) for i, k in enumerate("abcdef")}
    want = set()
    x["a"][250] *= 1.2
    want |= {("a", 250, "spike")}
    x["a"][255:257] = [v * 0.8 for v in x["a"][255:257]]
    want |= {("a", 255, "spike"), ("a", 256, "spike")}
    x["b"][300:] = [v * 1.5 for v in x["b"][300:]]  # a level that lasts
    for k in x:
        x[k][400] *= 1.3  # a move that all show
    x["c"][508:516] = [x["c"][508]] * 8
    want |= {("c", i, "stuck") for i in range(509, 516)}
    x["c"][100:105] = [x["c"][100]] * 5  # not more than five
    x["d"][10], x["d"][11], x["d"][12] = -3.0, None, NAN
    want |= {("d", 10, "range")}
    x["e"][511] *= 10
    want |= {("e", 511, "spike")}
    assert faults(spark, x) == want


def test_returns_need_a_witness(spark):
    w = {k: walk(i) for i, k in enumerate("abcdef")}
    w["a"][200:] = [v * 1.4 for v in w["a"][200:]]
    x = {k: [0.0, *[b / a - 1 for a, b in zip(v, v[1:])]] for k, v in w.items()}
    x["b"][300], x["c"][5], x["c"][6] = 0.3, -1.5, INF
    assert faults(spark, x, "return", w) == {("b", 300, "spike"), ("c", 5, "range"), ("c", 6, "range")}


def test_blocks_do_not_matter(spark):
    x = {"a": walk(1, 900), "b": walk(2, 900)}
    x["a"][255:262] = [x["a"][255]] * 7
    x["b"][511] *= 1.3
    assert faults(spark, x) == faults(spark, x, block=5000) == {*(("a", i, "stuck") for i in range(256, 262)), ("b", 511, "spike")}


def test_faults_in_odd_tables(spark):
    assert faults(spark, {}) == set()
    assert faults(spark, {"a": [None, NAN]}) == set() and faults(spark, {"a": [1.0]}) == set()
    df = spark.createDataFrame([(1, None, day(1), -1.0), (2, "a", None, 5.0), (3, None, None, 0.0)], "id long, k string, date date, v double")
    assert {r["id"] for r in implausible(df, [Measure("v")], source="k", date="date", row_id="id").collect()} == {1, 3}


def planted(sources=12, n=300):
    """Walks of very different liveliness with lone and double spikes, lasting levels and three-day stays; the spikes' places."""
    g = np.random.default_rng(5)
    rows, want = [], set()
    for k in range(sources):
        s = 0.002 * 1.5**k
        x = np.cumsum(g.normal(0, s, n))
        x[150:] += 25 * s  # a level that lasts
        x[200:203] += 20 * s  # three days are no spike
        for at, length, size in ((40, 1, 12), (90, 2, -12), (250, 1, -15)):
            x[at : at + length] += size * s
            want |= {(k, at + j) for j in range(length)}
        rows.append(np.exp(x))
    return rows, want


def spikes_of(rows):
    none = [np.zeros(len(x)) for x in rows]
    f = spikes._flags("level", pd.Series(rows), pd.Series(none), pd.Series(none), None, 4.0, 5, 4)
    return {(k, i) for k, x in enumerate(f) for i in np.flatnonzero(x & spikes.SPIKE)}


def test_the_decomposition_decides(monkeypatch):
    rows, want = planted()
    assert spikes_of(rows) == want
    monkeypatch.setattr(spikes, "robust_pca", lambda d, w=None: (d, np.zeros_like(d)))  # all is normal
    assert spikes_of(rows) == set()
    monkeypatch.setattr(spikes, "robust_pca", lambda d, w=None: (np.zeros_like(d), d))  # nothing is
    assert spikes_of(rows) != want


def test_returns_against_their_witness_in_the_decomposition():
    g = np.random.default_rng(6)
    x = g.normal(0, 1, (1, 256))
    shown = x + g.normal(0, 0.1, x.shape)
    x[0, 20] = shown[0, 20] = 15.0  # seen by both
    x[0, 60], x[0, 90], shown[0, 120] = 12.0, -14.0, np.nan
    off = spikes._off_witness(x, shown)
    assert set(np.flatnonzero(off[0] > 4)) == {60, 90}


def test_one_source_by_itself_and_few(spark):
    x = walk(1)
    x[300] *= 1.2
    for k in (1, 2, 3, 6):
        assert faults(spark, {"a": x, **{f"s{i}": walk(10 + i) for i in range(k - 1)}}) == {("a", 300, "spike")}


def test_robust_pca_parts():
    g = np.random.default_rng(0)
    low = g.normal(size=(3, 60, 1)) @ g.normal(size=(3, 1, 8))
    sparse = np.where(g.random((3, 60, 8)) < 0.03, 20.0, 0.0)
    a, b = robust_pca(low + sparse, steps=60)
    assert np.median(np.abs(a - low)) < 0.01 and ((np.abs(b) > 10) == (sparse > 0)).all()


# regrid -----------------------------------------------------------------------------------------------------
def grid(spark, readings, bounds, **kw):
    r = spark.createDataFrame(readings, "k string, t double, v double, o int")
    b = spark.createDataFrame(bounds, "k string, first_cell long, last_cell long")
    return {(g["k"], g["cell"]): g for g in regrid(r, b, entity="k", time="t", value="v", order="o", **kw).collect()}


def test_counter_increments_resets_and_gaps(spark):
    readings = [("a", 0.0, 100.0, 0), ("a", 2.0, 120.0, 0), ("a", 2.5, 130.0, 0), ("a", 4.0, 6.0, 0), ("a", 8.0, 14.0, 0)]
    g = grid(spark, readings, [("a", 0, 9)], max_gap=3.0)
    assert [g["a", c]["value"] for c in range(8)] == pytest.approx([10, 10, 10 + 2, 4, 2, 2, 2, 2])
    assert g["a", 9]["value"] is None and g["a", 9]["covered"] == 0
    assert [c for c in range(10) if g["a", c]["marked"]] == [1, 3, 4, 5, 6, 7, 9]
    assert sum(g["a", c]["value"] for c in range(8)) == pytest.approx(30 + 6 + 8)  # nothing is lost or made


def test_levels_hold(spark):
    g = grid(spark, [("a", 1.0, 5.0, 0), ("a", 1.0, 7.0, 1), ("a", 3.5, 9.0, 0), ("b", None, 1.0, 0), (None, 1.0, 1.0, 0)], [("a", 0, 4), ("b", 2, 3), ("b", 3, 3)], kind="level")
    assert [g["a", c]["value"] for c in range(5)] == [None, 7.0, 7.0, 8.0, 9.0]
    assert [g["a", c]["marked"] for c in range(5)] == [True, False, True, False, True]
    assert set(g) == {*(("a", c) for c in range(5)), ("b", 2), ("b", 3)} and g["b", 2]["marked"] and g["b", 2]["value"] is None


def test_readings_that_only_hold(spark):
    # Friday 0, Saturday and Sunday before Monday 1, Monday itself, Tuesday 2 without a reading, one before Wednesday 3
    rows = [("a", 0.0, 1.0, 5, True), ("a", 1.0, 5.0, 6, False), ("a", 1.0, 6.0, 7, False), ("a", 1.0, -2.0, 8, True), ("a", 3.0, 4.0, 9, False), ("a", 3.0, None, 10, True)]
    r = spark.createDataFrame(rows, "k string, t double, v double, o int, own boolean")
    b = spark.createDataFrame([("a", 0, 3)], "k string, first_cell long, last_cell long")
    g = {x["cell"]: x for x in regrid(r, b, entity="k", time="t", value="v", order="o", kind="level", own="own").collect()}
    assert [g[c]["value"] for c in range(4)] == pytest.approx([1.0, -2.0, -2.0, 4.0], abs=1e-12)
    assert [g[c]["marked"] for c in range(4)] == [False, False, True, True] and [g[c]["n_readings"] for c in range(4)] == [1, 1, 0, 0]


def test_levels_of_any_sign_against_brute_force(spark):
    r = random.Random(11)
    rows = [("a", r.uniform(-3, 20), r.uniform(-5, 5), i) for i in range(40)]
    g = grid(spark, rows, [("a", 0, 16)], kind="level")
    line = sorted((t, o, v) for _, t, v, o in rows)
    for c in range(17):
        total = 0.0
        for i, (t, _, v) in enumerate(line):
            u = line[i + 1][0] if i + 1 < len(line) else 17.0
            total += max(0.0, min(u, c + 1) - max(t, c)) * v
        assert g["a", c]["value"] == pytest.approx(total / min(1.0, c + 1 - line[0][0]), abs=1e-9)


def test_readings_beyond_the_bounds(spark):
    g = grid(spark, [("a", -3.0, 2.0, 0), ("a", 9.0, 4.0, 0)], [("a", 0, 3)], kind="level")
    assert [g["a", c]["value"] for c in range(4)] == [2.0] * 4 and all(g["a", c]["marked"] for c in range(4))
    assert grid(spark, [], []) == {} and len(grid(spark, [], [("a", 0, 2)])) == 3


def test_calendar(spark):
    c = spark.createDataFrame([(day(i), i % 7 not in (5, 6)) for i in range(9)] + [(day(2), None), (None, True)], "d date, o boolean")
    assert [(r["cell"], r["open"]) for r in calendar_cells(c, "d", "o").orderBy("day").collect()] == [(0, True), (1, True), (2, True), (3, True), (4, True), (5, False), (5, False), (5, True), (6, True)]


# known at ---------------------------------------------------------------------------------------------------
def test_tree_keeps_every_version():
    r = random.Random(1)
    for _ in range(100):
        t, log, k = Tree(), [], 0
        for i in range(r.randint(0, 60)):
            k += r.randint(0, 2)
            key = r.randint(-50, 50)
            t.insert(k, key, i)
            log.append((k, key, i))
        ask = [(r.randint(-2, k + 2), r.randint(-55, 55)) for _ in range(50)]
        got = t.search(np.array([a for a, _ in ask]), np.array([b for _, b in ask]))
        for (a, b), g in zip(ask, got):
            held = {key: i for kk, key, i in log if kk <= a}
            fit = [key for key in held if key <= b]
            assert g == (held[max(fit)] if fit else -1)


def test_known_at_against_brute_force(spark):
    r = random.Random(2)
    facts = [(r.choice(["a", "b", None]), r.choice([None, *range(20, 60)]), r.choice([None, *range(0, 40)]), r.randint(0, 3), r.choice([None, NAN, float(r.randint(0, 99))]), float(r.randint(0, 9))) for _ in range(120)]
    facts += facts[:10]
    events = [(i, r.choice(["a", "b", "c", None]), r.choice([None, *range(0, 70)]), "z") for i in range(300)]
    f = spark.createDataFrame([(k, day(a), day(b), o, x, y) for k, a, b, o, x, y in facts], "k string, known date, valid date, o int, x double, y double")
    e = spark.createDataFrame([(i, k, day(d), z) for i, k, d, z in events], "id long, k string, date date, x_known string")
    got = known_at(e, f, entity="k", event_time="date", known_time="known", valid_time="valid", order="o", columns=("x", "y"), keep=("id", "k", "x_known"), rows_per_task=40).collect()
    assert len(got) == 300
    for g in got:
        _, k, d, _ = events[g["id"]]
        for c, at in (("x", 4), ("y", 5)):
            fit = [(v[2], v[1], v[3], v[at]) for v in facts if k is not None and d is not None and v[0] == k and None not in v[1:3] and v[1] <= d and v[2] <= d and v[at] is not None and v[at] == v[at]]
            assert g[f"{c}_known"] == (max(fit)[3] if fit else None)


def test_known_at_empty(spark):
    f = spark.createDataFrame([], "k string, known date, valid date, o int, x double")
    e = spark.createDataFrame([(1, "a", day(1)), (1, "a", day(1))], "id long, k string, date date")
    args = dict(entity="k", event_time="date", known_time="known", valid_time="valid", order="o", columns=("x",), keep=("id",))
    assert [r["x_known"] for r in known_at(e, f, **args).collect()] == [None, None]
    assert known_at(e.limit(0), f, **args).count() == 0
