import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import models as md
from tidemark.operators.features import EVENTS, event_signals, flips, persistence, project_daily, with_changes
from tidemark.operators.narrative import agreement, conditional_means, counts_over, extreme_quotes, label_table, quarterly, shares_by_row, stratified
from tidemark.operators.rolling import Series

D0 = date(2024, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def test_changes_and_projection(spark):
    q = spark.createDataFrame([("a", day(0), 1.0), ("a", day(90), None), ("a", day(180), 4.0)], "k string, known date, x double")
    s = Series(["k"], ["known"])
    c = {r["known"]: (r["x_delta"], r["x_surprise"]) for r in with_changes(q, s, ["x"]).collect()}
    assert c == {day(0): (None, None), day(90): (None, None), day(180): (None, 3.0)}
    spine = spark.createDataFrame([("a", day(i)) for i in (-1, 0, 5, 6, 95, 180)], "k string, d date")
    got = [(r["x_ffill"], r["x_surprise"], r["days_since_call"], r["is_earnings_week"]) for r in project_daily(spine, with_changes(q, s, ["x"]), entity=["k"], date="d", known="known", columns=["x"]).orderBy("d").collect()]
    assert got == [(None, None, None, 0), (1.0, None, 0, 1), (1.0, None, 5, 1), (1.0, None, 6, 0), (1.0, None, 5, 1), (4.0, 3.0, 0, 1)]


def test_event_signals(spark):
    names = ["ceo", "cfo", "gap", "ps", "pm", "gs", "gm", "os", "om", "bs", "bm", "cs", "cm", "en", "qa", "an", "sd", "nw", "rp"]
    row = {f"{n}_{k}": 0.1 * (i + 1) for i, n in enumerate(names) for k in ("ffill", "delta", "surprise")} | {"cm_ffill": None, "nw_ffill": None, "days_since_call": 10, "days_since_last_news": None, "nm": 0.5, "nc": 3}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if k in ('days_since_call', 'days_since_last_news', 'nc') else 'double'}" for k in row))
    named = {"ceo": "ceo", "cfo": "cfo", "gap": "gap", "entropy": "en", "answers": "qa", "questions": "an", "spread": "sd", "news": "nw", "report": "rp", "news_mean": "nm", "news_count": "nc"}
    r = event_signals(df, pressure=("ps", "pm"), guidance=("gs", "gm"), outlook=("os", "om"), broad=[("bs", "bm"), ("cs", "cm")], **named).first()
    assert set(EVENTS) <= set(r.asDict()) and len(EVENTS) == 24
    c, n = math.exp(-0.5), math.exp(-999 / 15)
    assert r["evt_ceo_tone"] == pytest.approx(0.1 * c) and r["evt_aml_pressure"] == pytest.approx(0.4 * 0.5 * c) and r["evt_aml_shift"] == pytest.approx(0.9 * c)
    assert r["evt_guidance_shift"] == pytest.approx(1.3 * c) and r["evt_macro_topic"] == pytest.approx(0.8 * 0.4 * c) and r["evt_news_flow"] == pytest.approx(math.log(4) * n)
    assert r["evt_broad_topic_signal"] == pytest.approx(1.0 * 0.6 * c)  # the other pair has no value
    assert r["evt_cfo_lead"] == pytest.approx(0.1 * c) and r["evt_ceo_surprise"] == pytest.approx(0.1 * c) and r["evt_exec_scripted_gap"] == pytest.approx(1.4 * c)
    assert r["evt_source_dispersion"] == pytest.approx(1.8 / math.sqrt(2) * c)  # of two sources, the news having none
    assert r["evt_transcript_reliability"] == pytest.approx(1 / 2.7 * c) and r["exec_tone_ffill"] == pytest.approx(0.15)


def test_persistence(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 1.0, 2.0, 5.0, None])], "k string, d int, v double")
    got = [r["autocorrelation"] for r in persistence(df, Series(["k"], ["d"]), "v", 3).orderBy("d").collect()]
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(-1) and got[4] is not None and got[5] is None


def test_flips(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, -1.0, 1.0, 2.0, None, 1.0])], "k string, d int, v double")
    assert [r["flips"] for r in flips(df, Series(["k"], ["d"]), "v", 2).orderBy("d").collect()] == [None, None, 2, 1, None, None]


NOTES = [
    ("q1", "transcripts", "prepared_remarks", "ceo", 0.5, ["capital", "capital", "other"]), ("q1", "transcripts", "qa", "analyst", -0.5, ["NIM"]), ("q1", "news", None, None, None, None),
    ("q1", "reports_40f", "body", None, 0.1, []), ("q2", "transcripts", "qa", "cfo", 0.25, None), (None, "news", None, None, 1.0, ["NIM"]),
]


def notes(spark):
    return spark.createDataFrame(NOTES, "quarter string, source_type string, section string, role string, score double, topics array<string>")


def test_quarterly(spark):
    got = {r["quarter"]: r for r in quarterly(notes(spark), ["quarter"]).collect()}
    q = got["q1"]
    assert set(got) == {"q1", "q2"} and q["n_chunks_annotated"] == 4
    assert (q["transcript_ceo_prep_sentiment_mean"], q["report_sentiment_mean"], q["framing_gap"], q["news_sentiment_mean"]) == (0.5, 0.1, 0.4, None)
    assert q["transcript_sentiment_std"] == 0.5 and got["q2"]["transcript_sentiment_std"] is None
    assert q["topic_capital_share"] == 0.5 and q["topic_capital_sentiment"] == 0.5 and q["topic_US_retail_sentiment"] is None
    assert q["topic_entropy"] == pytest.approx(0.9183) and got["q2"]["topic_entropy"] == 0.0
    assert {r["quarter"] for r in quarterly(notes(spark), ["quarter"], "q1").collect()} == {"q1"}
    assert quarterly(notes(spark).limit(0), ["quarter"]).count() == 0


def test_shares_round_half_even(spark):
    df = spark.createDataFrame([(1, 0.1, ["a"] if i == 0 else []) for i in range(32)], "g int, score double, topics array<string>")
    assert conditional_means(df, ["g"], "score", {}, "topics", ["a"]).first()["topic_a_share"] == 0.0312


def test_label_tables_and_samples(spark):
    x = label_table(notes(spark), "source_type", "topics", ["NIM", "capital"])
    assert {r["source_type"]: (r["NIM"], r["capital"]) for r in x.collect()} == {"transcripts": (1, 2), "news": (1, 0)}
    assert {r["source_type"]: r["NIM"] for r in shares_by_row(x, ["NIM", "capital"]).collect()}["news"] == 1.0
    assert {r["source_type"]: r["n"] for r in counts_over(notes(spark), "source_type", ["news", "memo"]).collect()} == {"news": 2, "memo": 0}
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("string").alias("g"))
    a, b = stratified(df, "g", "id", 10), stratified(df.repartition(7), "g", "id", 10)
    assert a.groupBy("g").count().where("count = 10").count() == 2 and {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}


def test_quotes_and_agreement(spark):
    df = spark.createDataFrame([("c1", 0.5, ["a", "a"], "x"), ("c2", 0.5, ["a"], "y"), ("c3", -1.0, ["a", "b"], "z"), ("c4", None, ["b"], "w")], "id string, score double, topics array<string>, quote string")
    q = {r["label"]: tuple(r)[1:] for r in extreme_quotes(df, "topics", "score", "quote", "id").collect()}
    assert q == {"a": (-1.0, "z", 0.5, "x"), "b": (-1.0, "z", -1.0, "z")}
    other = spark.createDataFrame([("c1", 0.2), ("c2", -0.4), ("c3", 0.01), ("c9", 1.0)], "id string, score double")
    r = agreement(df.select("id", "score"), other, "id").first()
    assert (r["n"], r["n_signed"], r["agreement"]) == (3, 2, 0.5)


def test_more_metrics(spark):
    df = spark.range(100).select(F.lit(1).alias("f"), "id", F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("p"), F.lit(0.5).alias("y"))
    r = ev.offset_interval(df, ["f"], "id", predicted="p", outcome="y").first()
    assert r["share"] == 0.5 and r["low"] <= 0.5 <= r["high"]
    assert ev.hash_split(df, "id").where("is_fit").count() == pytest.approx(70, abs=15)
    assert ev.fixed_folds(spark, [("a", "2024-01-01", "2024-01-08", "2024-02-01")]).first()["test_start"] == date(2024, 1, 8)
    w = spark.createDataFrame([(1.0, 1.0), (None, 9.0), (4.0, 2.0)], "v double, n double").agg(ev.weighted_mean("v", "n").alias("m")).first()["m"]
    assert w == 3.0
    best = ev.grid_search([{"a": 1}, {"a": 2}, {"a": 3}], [0, 1], lambda c, f: None if c["a"] == 3 else (c["a"] / 10, f))
    assert [c["a"] for _, c in best] == [2, 1, 3]
    b = lambda *v: spark.range(1).select(ev.beats(*[F.lit(x).cast("double") for x in v]).alias("x")).first()["x"]
    assert [b(0.6, 0.35, 0.8, 0.5, 0.355), b(0.6, 0.3, 0.8, 0.5, 0.355), b(0.6, 0.35, 0.6, 0.5, 0.3), b(0.6, 0.35, 0.8, None, None)] == [True, False, False, False]
    done = ev.run_stages([lambda b: [{"x": b["x"] + 1}, {"x": b["x"] + 2}]] * 2, lambda e: {**e, "score": e["x"]}, {"x": 0})
    assert [d["x"] for d in done] == [1, 2, 3, 4]


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(400).select(F.col("id"), (F.rand(1) - 0.5).alias("a"), F.rand(2).alias("b"), F.when(F.rand(3) < 0.1, F.lit(None)).otherwise(F.rand(4)).alias("c"))
    return x.withColumn("label", F.when(F.col("a") > 0.15, 1).when(F.col("a") < -0.15, -1).otherwise(0)).cache()


@pytest.mark.parametrize("kind,params", [("forest", {"numTrees": 10}), ("logistic", None), ("boosted", {"maxIter": 5})])
def test_models_learn(spark, rows, kind, params, tmp_path):
    (x,) = md.imputed(rows, features=["a", "b", "c"])
    m = md.fit(x, ["a", "b", "c"], "label", kind, params)
    p = md.predict(m, x)
    assert p.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.6
    if kind == "forest":
        assert md.importances(m, ["a", "b", "c"])[0][0] == "a" and md.permutation_importance(m, x, ["a", "b"], "label", "id")[0][0] == "a"
        md.save(m, str(tmp_path / "m"), ["a"], {"k": 1})
        again, about = md.load(spark, str(tmp_path / "m"))
        assert about["params"] == {"k": 1} and md.predict(again, x).select("prediction").collect() == p.select("prediction").collect()
        for f in (md.platt, md.isotonic):
            c = f(p, p, "label").select(F.aggregate("prob", F.lit(0.0), lambda u, v: u + v).alias("s")).collect()
            assert all(r["s"] == pytest.approx(1.0) for r in c)


def test_regressions_and_unknown_models(spark, rows):
    (x,) = md.imputed(rows, features=["a", "b", "c"])
    p = md.predict(md.fit(x, ["a", "b"], "c", "forest_regression", {"numTrees": 5}), x)
    assert "prob" not in p.columns and ev.regression_metrics(p.withColumn("g", F.lit(1)), ["g"], actual="c", predicted="prediction").first()["n"] == 400
    with pytest.raises(ValueError):
        md.estimator("oracle")


# plans ------------------------------------------------------------------------------------------------------
def test_scans_are_pruned(spark):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir(entry.SMOKE):
        pytest.skip("no test tables here")
    plan = entry.queries()["p2_found"](spark, entry.SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_type,news)" in plan and "key_quote" not in plan and "topics" not in plan
    plan = entry.queries()["p3_found"](spark, entry.SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "td_close" not in plan
    for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"):
        plan = entry.queries()[name](spark, entry.SMOKE)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_attributions_are_shapley_values(spark):
    import itertools
    import random

    import numpy as np
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, a := r.gauss(0, 1), b := r.gauss(0, 1), c := r.gauss(0, 1), (1 if a + b * c > 0.4 else -1 if a < -0.6 else 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    names = ["a", "b", "c"]
    m = md.fit(df, names, "label", "forest", {"numTrees": 3, "maxDepth": 3})
    paths = md.tree_paths(m)
    x = np.array([row[1:4] for row in rows[:40]])
    phi = md.attributions(x, paths)
    prob = np.array([row["prob"] for row in md.predict(m, df.where("id < 40")).orderBy("id").collect()])
    base = sum(v * np.prod([s for *_, s in way]) for v, way in paths)
    assert np.allclose(phi.sum(1) + base, prob)

    def worth(row, known):
        return sum(v * np.prod([float(lo < row[f] <= hi) if f in known else s for f, lo, hi, s in way]) for v, way in paths)

    for row, got in zip(x[:5], phi):
        for j in range(3):
            want = 0
            for order in itertools.permutations(range(3)):
                before = set(order[: order.index(j)])
                want = want + (worth(row, before | {j}) - worth(row, before)) / 6
            assert np.allclose(got[j], want)
    imp = {(q["feature"], q["output"]): q["importance"] for q in md.attribution_importance(m, df.where(F.col("id") < 40), names).collect()}
    assert imp["a", 1] == pytest.approx(np.abs(phi[:, 0, 2]).mean()) and len(imp) == 9


def test_places_ranks_and_quantiles_in_parts(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F
    from tidemark.operators.ranks import placed, quantiles, ranked

    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "b", None]), r.choice([None, float("nan"), 1.0, 2.0, 2.0, r.gauss(0, 3), float(r.randint(0, 9))])) for i in range(600)] + [(600 + i, "hot", 5.0) for i in range(50)] + [(700, "none", None)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    for cuts in (1, 7, 64):
        got = {x["k"]: (x["m"], x["p"]) for x in quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.83}, cuts=cuts).collect()}
        for k in ("a", "b", None, "hot"):
            v = [x[2] for x in rows if x[1] == k and x[2] is not None and x[2] == x[2]]
            assert got[k] == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.83)))
        assert "none" not in got
        some = df.where("v is not null and not isnan(v)")
        w = {x["id"]: x["r"] for x in ranked(some, ["k"], "v", "r", cuts=cuts).collect()}
        for i, k, v in rows:
            if i in w:
                same = [x[2] for x in rows if x[0] in w and x[1] == k]
                assert w[i] == sum(y < v for y in same) + (sum(y == v for y in same) + 1) / 2
        p = placed(df, ["k"], F.col("id") % 13, "v", ["id"], cuts=cuts).collect()
        for k in ("a", "hot"):
            mine = sorted((x for x in p if x["k"] == k), key=lambda x: x["v"])
            assert [x["v"] for x in mine] == list(range(1, len(mine) + 1)) and [x["id"] for x in mine] == [i for _, i in sorted((x["id"] % 13, x["id"]) for x in mine)]
    assert quantiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0
