"""Queries that fit models: the ensemble of blocks, regressions, calibration, on a chronological split of the whole matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import band
from tidemark.operators import evaluation as ev
from tidemark.operators import models as md
from tidemark.operators.rolling import latest_row
from tidemark.operators.tables import without_sentinel
from tidemark.session import table

#: Features by what they come from: one model each, which then vote.
BLOCKS = {
    "price": ["td_return_1d", "td_return_5d", "td_return_20d", "td_volatility_20d", "td_dist_52w_high", "td_volume_change_1d"],
    "transcript": ["transcript_ceo_prep_sentiment_mean_ffill", "report_sentiment_mean_ffill", "topic_regulatory_AML_share_ffill", "evt_framing_gap"],
    "news": ["news_sent_mean_7d", "news_sent_mean_30d", "news_count_7d", "news_count_30d", "days_since_last_news"],
}
ALL = [c for b in BLOCKS.values() for c in b]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The matrix's last row per ticker and date, sentinels and infinities missing, with its label."""
    m = table(spark, d, "model_features_daily").select("row_id", "ticker", "date", "load_id", *ALL, "td_return_5d_fwd")
    m = latest_row(m, ["ticker", "date"], ["load_id", "row_id"])
    m = without_sentinel(m, [*ALL, "td_return_5d_fwd"])
    m = m.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in [*ALL, "td_return_5d_fwd"]})
    return m.where("td_return_5d_fwd > -1").withColumn("label", band(F.col("td_return_5d_fwd"), 0.01))


def _split(spark: SparkSession, d: str, share: float = 0.8, gap_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Training and test rows on either side of the date before which ``share`` of the rows lie; a gap keeps training outcomes out of the test."""
    r = _rows(spark, d)
    cut = r.agg(F.percentile_approx(F.unix_date("date"), share)).first()[0] or 0
    day = F.unix_date("date")
    return r.where(day <= cut - gap_days), r.where(day > cut)


def model_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """A model per block, their hard and soft vote, each with its metrics."""
    train, test = _split(spark, d)
    train, test = md.imputed(train, test, features=ALL)
    joined = test.select("row_id", "ticker", "date", "label", "td_return_5d_fwd")
    kinds = {"price": "forest", "transcript": "logistic", "news": "forest"}
    for name, features in BLOCKS.items():
        m = md.fit(train, features, "label", kinds[name], {"numTrees": 20, "maxDepth": 4} if kinds[name] == "forest" else None)
        p = md.predict(m, test).select("row_id", F.col("prediction").alias(f"call_{name}"), F.col("prob").alias(f"prob_{name}"))
        joined = joined.join(p, on="row_id")
    hard = ev.majority_vote(*[F.col(f"call_{b}") for b in BLOCKS])
    soft = ev.soft_vote(*[F.col(f"prob_{b}") for b in BLOCKS])
    calls = [F.struct(F.lit(b).alias("model"), F.col(f"call_{b}").alias("call")) for b in BLOCKS] + [F.struct(F.lit("hard vote").alias("model"), hard.alias("call")), F.struct(F.lit("soft vote").alias("model"), soft.alias("call"))]
    long = joined.select("ticker", "date", "label", "td_return_5d_fwd", F.explode(F.array(*calls)).alias("c")).select("ticker", "date", "label", "td_return_5d_fwd", "c.model", "c.call")
    return ev.stride_metrics(long, ["model", "ticker"], "date", actual="label", predicted="call", outcome="td_return_5d_fwd")


def model_regression(spark: SparkSession, d: str) -> DataFrame:
    """Forest and boosted regressions of the forward return."""
    train, test = md.imputed(*_split(spark, d), features=ALL)
    out = None
    for kind, params in (("forest_regression", {"numTrees": 20, "maxDepth": 4}), ("boosted_regression", {"maxIter": 8, "maxDepth": 3})):
        p = md.predict(md.fit(train, ALL, "td_return_5d_fwd", kind, params), test)
        x = ev.regression_metrics(p.withColumn("model", F.lit(kind)), ["model"], actual="td_return_5d_fwd", predicted="prediction")
        out = x if out is None else out.unionByName(x)
    return out


def model_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Class shares and precision as predicted, after a logistic and after a step calibration on the last fifth of training, and with the confidence gate."""
    train, test = md.imputed(*_split(spark, d), features=ALL)
    parts = ev.chronological_split(train, ["ticker"], "date", least=0, leave=1)
    m = md.fit(parts.where("is_fit").drop("is_fit"), ALL, "label", "forest", {"numTrees": 20, "maxDepth": 4})
    held, p = md.predict(m, parts.where("not is_fit").drop("is_fit")), md.predict(m, test)
    named = {"raw": p, "platt": md.platt(held, p, "label"), "isotonic": md.isotonic(held, p, "label")}
    out = None
    for name, x in named.items():
        for gate, least in (("", 0.0), (" gated", 0.45)):
            y = ev.class_metrics(x.withColumn("call", ev.confidence_gate(F.col("prob"), least)).withColumn("model", F.lit(name + gate)), ["model"], actual="label", predicted="call")
            out = y if out is None else out.unionByName(y)
    return out


def model_importances(spark: SparkSession, d: str) -> DataFrame:
    """Share of each feature in a forest, and of the components of the text block in a logistic model."""
    train, _ = _split(spark, d)
    (train,) = md.imputed(train, features=ALL)
    rows = [("forest", f, v) for f, v in md.importances(md.fit(train, ALL, "label", "forest", {"numTrees": 20, "maxDepth": 4}), ALL)]
    m = md.fit(train, BLOCKS["transcript"], "label", "logistic", components=2)
    rows += [("components", f"pc{i + 1}", float(abs(m.stages[-1].coefficientMatrix.toArray()[:, i]).mean())) for i in range(2)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def model_shap(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute Shapley value of every feature for every class of a forest, over the test rows."""
    train, test = md.imputed(*_split(spark, d), features=ALL)
    return md.attribution_importance(md.fit(train, ALL, "label", "forest", {"numTrees": 20, "maxDepth": 4}), test, ALL)


def model_grid(spark: SparkSession, d: str) -> DataFrame:
    """A small grid of forests, scored by sign accuracy and macro F1 over the middle folds of a walk forward."""
    r = _rows(spark, d)
    folds = ev.tuning_folds(ev.walk_forward(r, "date", train=120, test=40, gap=5)).orderBy("fold_id").collect()  # a row a fold

    def score(c: dict, f) -> tuple[float, float] | None:  # noqa: ANN001
        train, test = md.imputed(r.where(F.col("date").between(f["train_start"], f["train_end"])), r.where(F.col("date").between(f["test_start"], f["test_end"])), features=ALL)
        p = md.predict(md.fit(train, ALL, "label", "forest", c), test)
        g = ev.stride_metrics(p, ["ticker"], "date", actual="label", predicted="prediction", outcome="td_return_5d_fwd").agg(F.avg("sign_accuracy").alias("sign_accuracy"), F.avg("macro_f1").alias("macro_f1")).first()
        return None if g["sign_accuracy"] is None else (g["sign_accuracy"], g["macro_f1"])

    grid = [{"numTrees": n, "maxDepth": k} for n in (5, 15) for k in (2, 4)]
    rows = [(i + 1, c["numTrees"], c["maxDepth"], float(s), len(folds)) for i, (s, c) in enumerate(ev.grid_search(grid, folds, score))]
    return spark.createDataFrame(rows, "place int, trees int, depth int, score double, folds int")


QUERIES = {"model_grid": model_grid, "model_shap": model_shap, "model_ensemble": model_ensemble, "model_regression": model_regression, "model_calibration": model_calibration, "model_importances": model_importances}
ORACLE: dict[str, str] = {}
