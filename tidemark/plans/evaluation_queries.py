"""Walk-forward and metric queries over calls derived from prices, with their SQL.

The calls stand in for a model's: three voters that are plain functions of the
row, so that both engines have the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators.asof import in_ranges
from tidemark.operators.features import flips, persistence
from tidemark.operators.ranks import quantiles
from tidemark.operators.rolling import rank_correlations
from tidemark.plans.base import BARS, TICKER, bars, with_
from tidemark.plans.market_queries import EXCESS, _excess
from tidemark.session import table

TRAIN, TEST, GAP = 120, 40, 5


def _days(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("date").distinct()


def folds_rolling(spark: SparkSession, d: str) -> DataFrame:
    return ev.walk_forward(_days(spark, d), "date", train=TRAIN, test=TEST, gap=GAP)


def folds_expanding(spark: SparkSession, d: str) -> DataFrame:
    return ev.walk_forward(_days(spark, d), "date", train=TRAIN, test=TEST, gap=GAP, expanding=True)


def _folds_sql(expanding: bool) -> str:
    first = "0" if expanding else f"greatest(0, i - {GAP + TRAIN})"
    return f"""days AS (SELECT list_sort(list(DISTINCT date)) AS d, count(DISTINCT date) AS n FROM bars),
st AS (SELECT d, n, unnest(range({TRAIN + GAP}, n, {TEST})) AS i FROM days),
folds AS (SELECT CAST((i - {TRAIN + GAP}) // {TEST} + 1 AS INTEGER) AS fold_id, d[{first} + 1] AS train_start, d[i - {GAP}] AS train_end, d[i + 1] AS test_start, d[least(i + {TEST - 1}, n - 1) + 1] AS test_end FROM st)"""


FOLDS = with_(BARS, _folds_sql(False))


def folds_tuning(spark: SparkSession, d: str) -> DataFrame:
    return ev.tuning_folds(folds_rolling(spark, d)).select("fold_id", "test_start")


TUNING_SQL = FOLDS + """SELECT fold_id, test_start FROM folds, (SELECT count(*) AS k FROM folds)
WHERE fold_id - 1 BETWEEN greatest(2, k // 4) AND least(k - 2, 3 * k // 4)"""


def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training and test rows of every fold: a row is in many folds' training slices."""
    b = bars(spark, d).select("ticker", "date")
    f = folds_rolling(spark, d)
    tr = in_ranges(b, f, date="date", low="train_start", high="train_end").groupBy("fold_id").agg(F.count("*").alias("train_rows"))
    te = in_ranges(b, f, date="date", low="test_start", high="test_end").groupBy("fold_id").agg(F.count("*").alias("test_rows"))
    return tr.join(te, on="fold_id")


ROWS_SQL = FOLDS + """SELECT fold_id, count(*) FILTER (date BETWEEN train_start AND train_end) AS train_rows, count(*) FILTER (date BETWEEN test_start AND test_end) AS test_rows
FROM bars, folds GROUP BY fold_id"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows with three voters and two probability triples."""
    from tidemark.functions.scalar import band

    x = _excess(spark, d).where("excess_5d is not null and momentum is not null")
    x = x.select("ticker", "date", F.round("excess_5d", 6).alias("outcome"), band(F.round("excess_5d", 6), 0.005).alias("actual"), F.round("momentum", 6).alias("momentum"), F.unix_date("date").alias("k"))
    x = x.withColumns({"v1": band(F.col("momentum"), 0.01), "v2": (F.col("k") % 3 - 1).cast("int"), "v3": ((F.col("k") + F.ascii("ticker")) % 3 - 1).cast("int")})
    a, b, c = (1 + F.col("k") % n for n in (7, 5, 4))
    whole = (a + b + c).cast("double")
    x = x.withColumn("prob", F.array(a / whole, b / whole, c / whole)).withColumn("prob2", F.array(c / whole, a / whole, b / whole))
    return x.withColumn("vote", ev.majority_vote(F.col("v1"), F.col("v2"), F.col("v3"))).withColumn("soft", ev.soft_vote(F.col("prob"), F.col("prob2")))


CALLS = EXCESS.rstrip() + """, c0 AS (SELECT ticker, date, round(excess_5d, 6) AS outcome, CASE WHEN round(excess_5d, 6) > 0.005 THEN 1 WHEN round(excess_5d, 6) < -0.005 THEN -1 ELSE 0 END AS actual,
  round(momentum, 6) AS momentum, date - DATE '1970-01-01' AS k FROM x WHERE excess_5d IS NOT NULL AND momentum IS NOT NULL),
c1 AS (SELECT *, CASE WHEN momentum > 0.01 THEN 1 WHEN momentum < -0.01 THEN -1 ELSE 0 END AS v1, CAST(k % 3 - 1 AS INTEGER) AS v2, CAST((k + ascii(ticker)) % 3 - 1 AS INTEGER) AS v3,
  CAST(1 + k % 7 AS DOUBLE) / (3 + k % 7 + k % 5 + k % 4) AS p0, CAST(1 + k % 5 AS DOUBLE) / (3 + k % 7 + k % 5 + k % 4) AS p1, CAST(1 + k % 4 AS DOUBLE) / (3 + k % 7 + k % 5 + k % 4) AS p2 FROM c0),
c2 AS (SELECT *, CAST(v1 = 1 AS INT) + CAST(v2 = 1 AS INT) + CAST(v3 = 1 AS INT) AS up, CAST(v1 = 0 AS INT) + CAST(v2 = 0 AS INT) + CAST(v3 = 0 AS INT) AS mid,
  CAST(v1 = -1 AS INT) + CAST(v2 = -1 AS INT) + CAST(v3 = -1 AS INT) AS dn, (p0 + p2) / 2 AS q0, (p1 + p0) / 2 AS q1, (p2 + p1) / 2 AS q2 FROM c1),
calls AS (SELECT *, CASE WHEN up > mid AND up > dn THEN 1 WHEN dn > mid AND dn > up THEN -1 ELSE 0 END AS vote,
  CASE WHEN q0 >= q1 AND q0 >= q2 THEN -1 WHEN q1 >= q2 THEN 0 ELSE 1 END AS soft FROM c2)
"""


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("ticker", "date", "vote", "soft")


def _in_folds(spark: SparkSession, d: str) -> DataFrame:
    return in_ranges(_calls(spark, d), folds_rolling(spark, d), date="date", low="test_start", high="test_end")


FOLD_CALLS = CALLS.rstrip() + ", " + _folds_sql(False) + ", fc AS (SELECT * FROM calls JOIN folds ON date BETWEEN test_start AND test_end)\n"


def stride_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = ev.stride_metrics(_in_folds(spark, d), ["ticker", "fold_id"], "date", actual="actual", predicted="vote", outcome="outcome")
    return x.select("ticker", "fold_id", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("accuracy", "macro_f1", "coverage", "sign_accuracy")])


def _f1_sql(c: int) -> str:
    return f"coalesce(2.0 * count(*) FILTER (actual = {c} AND vote = {c}) / nullif(count(*) FILTER (actual = {c}) + count(*) FILTER (vote = {c}), 0), 0)"


STRIDE_SQL = FOLD_CALLS + f""", o AS (SELECT *, (row_number() OVER (PARTITION BY ticker, fold_id ORDER BY date) - 1) % 5 AS off FROM fc),
per AS (SELECT ticker, fold_id, off, avg(CAST(actual = vote AS INT)) AS accuracy, ({_f1_sql(-1)} + {_f1_sql(0)} + {_f1_sql(1)}) / 3 AS macro_f1, avg(CAST(vote <> 0 AS INT)) AS coverage,
  avg(CASE WHEN vote <> 0 THEN CAST(sign(vote) = sign(outcome) AS INT) END) AS sign_accuracy FROM o GROUP BY ALL)
SELECT ticker, fold_id, round(avg(accuracy) + 1e-10, 6) AS accuracy, round(avg(macro_f1) + 1e-10, 6) AS macro_f1, round(avg(coverage) + 1e-10, 6) AS coverage, round(avg(sign_accuracy) + 1e-10, 6) AS sign_accuracy FROM per GROUP BY ticker, fold_id"""


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(_in_folds(spark, d), ["fold_id"], "actual", "vote")


CONFUSION_SQL = FOLD_CALLS + """, k AS (SELECT unnest([-1, 0, 1]) AS c)
SELECT f.fold_id, a.c AS actual, p.c AS predicted, count(fc.ticker) AS n FROM (SELECT DISTINCT fold_id FROM fc) f CROSS JOIN k a CROSS JOIN k p
LEFT JOIN fc ON fc.fold_id = f.fold_id AND fc.actual = a.c AND fc.vote = p.c GROUP BY ALL"""


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = ev.class_metrics(_in_folds(spark, d), ["fold_id"], actual="actual", predicted="vote")
    return x.select("fold_id", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in x.columns if c != "fold_id"])


_NAMES = ((-1, "neg"), (0, "neu"), (1, "pos"))
CLASS_SQL = FOLD_CALLS + ", mm AS (SELECT fold_id, " + ", ".join(
    f"avg(CAST(actual = {c} AS INT)) AS actual_{n}, avg(CAST(vote = {c} AS INT)) AS pred_{n}, avg(CAST(actual = {c} AS INT)) FILTER (vote = {c}) AS precision_{n}, avg(CAST(vote = {c} AS INT)) FILTER (actual = {c}) AS recall_{n}" for c, n in _NAMES
) + " FROM fc GROUP BY fold_id) SELECT fold_id, " + ", ".join(f"round({k}_{n} + 1e-10, 6) AS {k}_{n}" for _, n in _NAMES for k in ("actual", "pred", "precision", "recall")) + ", round(greatest(pred_neg, pred_neu, pred_pos) + 1e-10, 6) AS pred_max FROM mm"


def auc_ovr(spark: SparkSession, d: str) -> DataFrame:
    """AUC of up and of down calls against the rest, by fold."""
    x = _in_folds(spark, d)
    up = ev.auc(x.select("fold_id", (F.col("actual") == 1).alias("y"), F.get("prob", F.lit(2)).alias("s")), ["fold_id"], positive="y", score="s")
    dn = ev.auc(x.select("fold_id", (F.col("actual") == -1).alias("y"), F.get("prob", F.lit(0)).alias("s")), ["fold_id"], positive="y", score="s")
    return up.select("fold_id", F.round(F.col("auc") + 1e-10, 6).alias("auc_pos")).join(dn.select("fold_id", F.round(F.col("auc") + 1e-10, 6).alias("auc_neg")), on="fold_id")


def _auc_sql(p: str, c: int) -> str:
    return f"""(SELECT fold_id, (sum(CASE WHEN actual = {c} THEN r END) - n1 * (n1 + 1) / 2.0) / nullif(n1 * (n - n1), 0) AS auc FROM (
  SELECT fold_id, actual, rank() OVER (PARTITION BY fold_id ORDER BY {p}) + (count(*) OVER (PARTITION BY fold_id, {p}) - 1) / 2.0 AS r, count(*) FILTER (actual = {c}) OVER (PARTITION BY fold_id) AS n1, count(*) OVER (PARTITION BY fold_id) AS n FROM fc) GROUP BY fold_id, n1, n)"""


AUC_SQL = FOLD_CALLS + f"SELECT fold_id, round(a.auc + 1e-10, 6) AS auc_pos, round(b.auc + 1e-10, 6) AS auc_neg FROM {_auc_sql('p2', 1)} a JOIN {_auc_sql('p0', -1)} b USING (fold_id)"


def wald_ci(spark: SparkSession, d: str) -> DataFrame:
    """Share of right signs among the calls of a fold with its interval, and the two baselines."""
    x = _in_folds(spark, d)
    right = F.when(F.col("vote") != 0, (F.signum(F.col("vote").cast("double")) == F.signum("outcome")).cast("int"))
    back = F.when(F.col("momentum") != 0, (F.signum("momentum") == F.signum("outcome")).cast("int"))
    g = x.groupBy("fold_id").agg(F.avg(right).alias("share"), F.count(right).alias("n_calls"), F.avg(back).alias("momentum_share"))
    low, high = ev.wald(F.col("share"), F.col("n_calls"))
    tr = in_ranges(_calls(spark, d), folds_rolling(spark, d), date="date", low="train_start", high="train_end")
    maj = ev.majority_class(tr, ["fold_id"], "actual")
    six = lambda c, n: F.round(c + 1e-10, 6).alias(n)
    return g.join(maj, on="fold_id", how="left").select("fold_id", "n_calls", six(F.col("share"), "share"), six(low, "low"), six(high, "high"), six(F.col("momentum_share"), "momentum_share"), "majority")


WALD_SQL = FOLD_CALLS + """, g AS (SELECT fold_id, avg(CAST(sign(vote) = sign(outcome) AS INT)) FILTER (vote <> 0) AS share, count(*) FILTER (vote <> 0) AS n_calls, avg(CAST(sign(momentum) = sign(outcome) AS INT)) FILTER (momentum <> 0) AS momentum_share FROM fc GROUP BY fold_id),
t AS (SELECT fold_id, actual, count(*) AS n FROM calls JOIN folds ON date BETWEEN train_start AND train_end GROUP BY ALL),
mm AS (SELECT fold_id, actual AS majority FROM t QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY n DESC, actual) = 1)
SELECT g.fold_id, n_calls, round(share + 1e-10, 6) AS share, round(share - 1.96 * sqrt(share * (1 - share) / nullif(n_calls, 0)) + 1e-10, 6) AS low, round(share + 1.96 * sqrt(share * (1 - share) / nullif(n_calls, 0)) + 1e-10, 6) AS high,
  round(momentum_share + 1e-10, 6) AS momentum_share, majority FROM g LEFT JOIN mm USING (fold_id)"""


def median_impute(spark: SparkSession, d: str) -> DataFrame:
    """Per fold the median momentum of its training rows and the volatility cutoff by a percentile."""
    tr = in_ranges(_calls(spark, d), folds_rolling(spark, d), date="date", low="train_start", high="train_end")
    g = quantiles(tr, ["fold_id"], "momentum", {"median": 0.5, "p80": 0.8})
    return g.select("fold_id", F.round(F.col("median") + 1e-10, 6).alias("median"), F.round(F.col("p80") + 1e-10, 6).alias("p80"))


MEDIAN_SQL = FOLD_CALLS + "SELECT fold_id, round(median(momentum) + 1e-10, 6) AS median, round(quantile_cont(momentum, 0.8) + 1e-10, 6) AS p80 FROM calls JOIN folds ON date BETWEEN train_start AND train_end GROUP BY fold_id"


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Calls left after the confidence gate, and after the regime gate at each fold's training percentile."""
    x = _in_folds(spark, d).join(F.broadcast(median_impute(spark, d).select("fold_id", "p80")), on="fold_id")  # a row a fold
    x = x.select("fold_id", ev.confidence_gate(F.col("prob"), 0.45).alias("sure"), ev.regime_gate(F.col("vote"), F.col("momentum"), F.col("p80")).alias("calm"))
    return x.groupBy("fold_id").agg(F.sum((F.col("sure") != 0).cast("long")).alias("n_sure"), F.sum((F.col("calm") != 0).cast("long")).alias("n_calm"))


GATES_SQL = FOLD_CALLS + """, p AS (SELECT fold_id, round(quantile_cont(momentum, 0.8) + 1e-10, 6) AS p80 FROM calls JOIN folds ON date BETWEEN train_start AND train_end GROUP BY fold_id)
SELECT fc.fold_id, count(*) FILTER (greatest(p0, p1, p2) >= 0.45 AND NOT (p1 >= p2 AND p1 > p0)) AS n_sure, count(*) FILTER (vote <> 0 AND momentum <= p80) AS n_calm FROM fc JOIN p ON p.fold_id = fc.fold_id GROUP BY fc.fold_id"""


def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    """The momentum taken for a forecast of the outcome: errors and rank correlation by fold."""
    x = _in_folds(spark, d)
    a = ev.regression_metrics(x, ["fold_id"], actual="outcome", predicted="momentum")
    b = ev.rank_ic(x, ["fold_id"], "momentum", "outcome").select("fold_id", "ic")
    return a.join(b, on="fold_id").select("fold_id", "n", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("r2", "mae", "rmse", "sign_accuracy", "ic")])


REGRESSION_SQL = FOLD_CALLS + """, r AS (SELECT *, rank() OVER (PARTITION BY fold_id ORDER BY momentum) + (count(*) OVER (PARTITION BY fold_id, momentum) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY fold_id ORDER BY outcome) + (count(*) OVER (PARTITION BY fold_id, outcome) - 1) / 2.0 AS b FROM fc)
SELECT fold_id, count(*) AS n, round(1 - sum((outcome - momentum) * (outcome - momentum)) / nullif(var_pop(outcome) * count(*), 0) + 1e-10, 6) AS r2, round(avg(abs(outcome - momentum)) + 1e-10, 6) AS mae,
  round(sqrt(avg((outcome - momentum) * (outcome - momentum))) + 1e-10, 6) AS rmse, round(avg(CASE WHEN outcome <> 0 THEN CAST(sign(outcome) = sign(momentum) AS INT) END) + 1e-10, 6) AS sign_accuracy,
  round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) + 1e-10, 6) AS ic FROM r GROUP BY fold_id"""


def icir(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of momentum and outcome over every five consecutive days of a ticker, summed up."""
    x = rank_correlations(_calls(spark, d), ["ticker"], "date", "momentum", "outcome", 5)
    return x.select("ticker", "n_windows", F.round(F.col("mean_ic") + 1e-10, 6).alias("mean_ic"), F.round(F.col("icir") + 1e-10, 6).alias("icir"))


_RANKED = lambda c: f"list_transform({c}, lambda v: len(list_filter({c}, lambda u: u < v)) + (len(list_filter({c}, lambda u: u = v)) + 1) / 2.0 - 3)"
ICIR_SQL = CALLS + f""", f AS (SELECT ticker, list(momentum) OVER w AS a, list(outcome) OVER w AS b FROM calls WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)),
r AS (SELECT ticker, {_RANKED('a')} AS p, {_RANKED('b')} AS q FROM f WHERE len(a) = 5),
i AS (SELECT ticker, list_dot_product(CAST(p AS DOUBLE[]), CAST(q AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(p AS DOUBLE[]), CAST(p AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 0) AS ic FROM r)
SELECT ticker, count(*) AS n_windows, round(avg(ic) + 1e-10, 6) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0) + 1e-10, 6) AS icir FROM i WHERE ic IS NOT NULL GROUP BY ticker"""


def _importances(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in importances: the traded volume of each ticker as a feature, by year as fold."""
    return bars(spark, d).where("volume is not null").groupBy(F.year("date").alias("fold"), F.col("ticker").alias("feature")).agg(F.sum("volume").cast("double").alias("importance"))


IMP = with_(BARS, "imp AS (SELECT CAST(year(date) AS INTEGER) AS fold, ticker AS feature, CAST(sum(volume) AS DOUBLE) AS importance FROM bars WHERE volume IS NOT NULL GROUP BY ALL)")


def stability_rank(spark: SparkSession, d: str) -> DataFrame:
    x = ev.stability(_importances(spark, d))
    six = [F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("mean_norm", "median_norm", "mean_rank", "median_rank", "top10_share", "top20_share")]
    return x.select("feature", *six, "fold_count", "stable_rank", "selected")


STABILITY_SQL = IMP + """, n AS (SELECT *, importance / nullif(sum(importance) OVER (PARTITION BY fold), 0) AS norm, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS rank FROM imp),
g AS (SELECT feature, avg(norm) AS mean_norm, median(norm) AS median_norm, avg(rank) AS mean_rank, median(rank) AS median_rank, avg(CAST(rank <= 10 AS INT)) AS top10_share, avg(CAST(rank <= 20 AS INT)) AS top20_share, count(DISTINCT fold) AS fold_count FROM n GROUP BY feature),
s AS (SELECT *, row_number() OVER (ORDER BY top20_share DESC, top10_share DESC, median_norm DESC, mean_norm DESC, mean_rank, feature) AS stable_rank FROM g)
SELECT feature, round(mean_norm + 1e-10, 6) AS mean_norm, round(median_norm + 1e-10, 6) AS median_norm, round(mean_rank + 1e-10, 6) AS mean_rank, round(median_rank + 1e-10, 6) AS median_rank,
  round(top10_share + 1e-10, 6) AS top10_share, round(top20_share + 1e-10, 6) AS top20_share, fold_count, stable_rank, stable_rank <= 15 AS selected FROM s"""


def topk(spark: SparkSession, d: str) -> DataFrame:
    """In how many folds a feature is among the first 3 and the first 10, and which are selected by vote."""
    from pyspark.sql import Window

    x = _importances(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("importance").desc(), "feature")))
    hits = x.groupBy("feature").agg(F.sum((F.col("r") <= 3).cast("long")).alias("top3"), F.sum((F.col("r") <= 10).cast("long")).alias("top_hits"), F.max("importance").alias("importance"))
    return ev.vote_selection(hits, 7, most=12).select("feature", "top3", "top_hits", "stable", "place", "selected")


TOPK_SQL = IMP + """, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS r FROM imp),
h AS (SELECT feature, count(*) FILTER (r <= 3) AS top3, count(*) FILTER (r <= 10) AS top_hits, max(importance) AS importance FROM r GROUP BY feature),
s AS (SELECT *, top_hits / 7.0 >= 0.5 AS stable FROM h), p AS (SELECT *, row_number() OVER (ORDER BY stable DESC, top_hits DESC, importance DESC, feature) AS place FROM s)
SELECT feature, top3, top_hits, stable, place, place <= 12 AS selected FROM p"""


def experiment_winner(spark: SparkSession, d: str) -> DataFrame:
    """The best ticker of each fold, taken for a stage's experiments."""
    m = stride_metrics(spark, d).select(F.col("fold_id").alias("stage"), F.col("ticker").alias("exp_id"), "accuracy", "macro_f1", "coverage", "sign_accuracy").where("sign_accuracy is not null")
    m = m.withColumns({"majority_accuracy": F.lit(0.3), "momentum_accuracy": F.lit(0.3)}).withColumn("ok", ev.acceptable(m))
    return ev.stage_winner(m, "stage").select("stage", "exp_id", "sign_accuracy", "coverage", "ok")


WINNER_SQL = STRIDE_SQL.replace("SELECT ticker, fold_id, round(avg(accuracy)", ", mm AS (SELECT ticker, fold_id, round(avg(accuracy)") + """)
SELECT fold_id AS stage, ticker AS exp_id, sign_accuracy, coverage, 100 * (accuracy - 0.3) > 2 AND 100 * (accuracy - 0.3) > 1 AND macro_f1 > 0.34 AND sign_accuracy > 0.5 AS ok FROM mm WHERE sign_accuracy IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY CAST(coverage >= 0.7 AS INT) DESC, sign_accuracy DESC, coverage DESC, accuracy DESC, macro_f1 DESC, ticker) = 1"""

def sign_interval(spark: SparkSession, d: str) -> DataFrame:
    """Share of right signs of the momentum by fold with its interval over five interleaved samples, strict and abstaining accuracy of the vote."""
    x = _in_folds(spark, d)
    a = ev.offset_interval(x, ["fold_id"], F.unix_date("date"), ["ticker"], predicted="momentum", outcome="outcome")
    m = x.groupBy("fold_id").agg(F.avg((F.col("vote") != 0).cast("int")).alias("cov"), F.avg(F.when(F.col("vote") != 0, (F.signum(F.col("vote").cast("double")) == F.signum("outcome")).cast("int"))).alias("asa"))
    six = lambda c, n: F.round(c + 1e-10, 6).alias(n)
    y = a.join(m, on="fold_id")
    return y.select("fold_id", *[six(F.col(c), c) for c in ("share", "low", "high")], six(ev.strict_accuracy(F.col("asa"), F.col("cov")), "strict"), six(ev.abstain_half(F.col("asa"), F.col("cov")), "abstaining"))


INTERVAL_SQL = FOLD_CALLS + """, o AS (SELECT *, (row_number() OVER (PARTITION BY fold_id ORDER BY date, ticker) - 1) % 5 AS off FROM fc),
p AS (SELECT fold_id, off, avg(CASE WHEN outcome <> 0 THEN CAST(sign(momentum) = sign(outcome) AS INT) END) AS share FROM o GROUP BY ALL),
g AS (SELECT fold_id, avg(share) AS share, 2.776 * stddev_samp(share) / sqrt(count(share)) AS half FROM p GROUP BY fold_id),
v AS (SELECT fold_id, avg(CAST(vote <> 0 AS INT)) AS cov, avg(CAST(sign(vote) = sign(outcome) AS INT)) FILTER (vote <> 0) AS asa FROM fc GROUP BY fold_id)
SELECT fold_id, round(share + 1e-10, 6) AS share, round(share - half + 1e-10, 6) AS low, round(share + half + 1e-10, 6) AS high, round(asa * cov + 1e-10, 6) AS strict, round(asa * cov + 0.5 * (1 - cov) + 1e-10, 6) AS abstaining FROM g JOIN v USING (fold_id)"""


def issuer_share(spark: SparkSession, d: str) -> DataFrame:
    """Traded volume by issuer, its percentage of all and its tier."""
    x = ev.share_of_total(bars(spark, d).where("volume is not null"), "issuer", "volume")
    return x.select("issuer", "total", "percent", ev.tier(F.floor("percent").cast("int"), 10, 5).alias("tier"))


SHARE_SQL = with_(BARS) + """, g AS (SELECT issuer, CAST(sum(volume) AS BIGINT) AS total FROM bars WHERE volume IS NOT NULL GROUP BY issuer), p AS (SELECT *, round(100.0 * total / sum(total) OVER (), 1) AS percent FROM g)
SELECT issuer, total, percent, CASE WHEN floor(percent) >= 10 THEN 'stable' WHEN floor(percent) >= 5 THEN 'frequent' WHEN floor(percent) > 0 THEN 'rare' ELSE 'never' END AS tier FROM p"""

def class_strides(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and sign accuracy of each class, averaged over five interleaved samples, by ticker and fold."""
    x = ev.class_strides(_in_folds(spark, d), ["ticker", "fold_id"], "date", actual="actual", predicted="vote", outcome="outcome")
    return x.select("ticker", "fold_id", "label", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("precision", "recall", "sign_accuracy", "n_calls")])


CLASS_STRIDES_SQL = FOLD_CALLS + """, o AS (SELECT *, (row_number() OVER (PARTITION BY ticker, fold_id ORDER BY date) - 1) % 5 AS off FROM fc), k AS (SELECT unnest([-1, 0, 1]) AS label),
per AS (SELECT ticker, fold_id, off, label, avg(CASE WHEN vote = label THEN CAST(actual = label AS INT) END) AS precision, avg(CASE WHEN actual = label THEN CAST(vote = label AS INT) END) AS recall,
  avg(CASE WHEN vote = label THEN CAST(sign(outcome) = label AS INT) END) AS sign_accuracy, count(*) FILTER (vote = label) AS n_calls FROM o, k GROUP BY ALL)
SELECT ticker, fold_id, label, round(avg(precision) + 1e-10, 6) AS precision, round(avg(recall) + 1e-10, 6) AS recall, round(avg(sign_accuracy) + 1e-10, 6) AS sign_accuracy, round(avg(n_calls) + 1e-10, 6) AS n_calls FROM per GROUP BY ticker, fold_id, label"""


def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """The voters as experiments: means over folds of accuracy, shares, and the baselines of each fold, with the uplift over these."""
    x = _in_folds(spark, d)
    voters = F.array(*[F.struct(F.lit(v).alias("exp_id"), F.lit(k).alias("model_kind"), F.col(v).alias("call")) for v, k in (("v1", "momentum"), ("v2", "calendar"), ("v3", "calendar"), ("vote", "hard vote"), ("soft", "soft vote"))])
    long = x.select("fold_id", "actual", "outcome", "momentum", F.inline(voters))
    hit = lambda c, k: F.avg((F.col(c) == k).cast("int"))
    right = (F.signum(F.col("call").cast("double")) == F.signum("outcome")).cast("int")
    g = long.groupBy("exp_id", "model_kind", "fold_id").agg(
        F.avg((F.col("call") == F.col("actual")).cast("int")).alias("accuracy"), F.avg(F.when(F.col("call") != 0, right)).alias("active_sign_acc"), F.avg((F.col("call") != 0).cast("int")).alias("active_coverage"),
        *[hit("actual", c).alias(f"actual_{n}_share") for c, n in _NAMES], *[hit("call", c).alias(f"pred_{n}_share") for c, n in _NAMES],
        F.avg((F.signum("momentum") == F.signum("outcome")).cast("int")).alias("momentum_accuracy"),
    )
    tr = in_ranges(_calls(spark, d), folds_rolling(spark, d), date="date", low="train_start", high="train_end")
    maj = x.join(F.broadcast(ev.majority_class(tr, ["fold_id"], "actual")), on="fold_id").groupBy("fold_id").agg(F.avg((F.col("actual") == F.col("majority")).cast("int")).alias("majority_accuracy"))  # a row a fold
    measures = ["accuracy", "active_sign_acc", "active_coverage", *[f"{k}_{n}_share" for k in ("actual", "pred") for _, n in _NAMES], "momentum_accuracy", "majority_accuracy"]
    y = ev.experiment_summary(g.join(maj, on="fold_id"), ["exp_id", "model_kind"], measures)
    return y.select("exp_id", "model_kind", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in y.columns[2:]])


_MEASURES = ["accuracy", "active_sign_acc", "active_coverage", *[f"{k}_{n}_share" for k in ("actual", "pred") for _, n in _NAMES], "momentum_accuracy", "majority_accuracy"]
EXPERIMENTS_SQL = FOLD_CALLS + """, t AS (SELECT fold_id, actual, count(*) AS n FROM calls JOIN folds ON date BETWEEN train_start AND train_end GROUP BY ALL),
mm AS (SELECT fold_id, actual AS majority FROM t QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY n DESC, actual) = 1), ma AS (SELECT fc.fold_id, avg(CAST(actual = majority AS INT)) AS majority_accuracy FROM fc JOIN mm ON mm.fold_id = fc.fold_id GROUP BY fc.fold_id),
l AS (""" + " UNION ALL ".join(f"SELECT '{v}' AS exp_id, '{k}' AS model_kind, fold_id, actual, outcome, momentum, {v} AS call FROM fc" for v, k in (("v1", "momentum"), ("v2", "calendar"), ("v3", "calendar"), ("vote", "hard vote"), ("soft", "soft vote"))) + """),
g AS (SELECT exp_id, model_kind, fold_id, avg(CAST(call = actual AS INT)) AS accuracy, avg(CASE WHEN call <> 0 THEN CAST(sign(call) = sign(outcome) AS INT) END) AS active_sign_acc, avg(CAST(call <> 0 AS INT)) AS active_coverage, """ + ", ".join(
    f"avg(CAST({c} = {k} AS INT)) AS {p}_{n}_share" for p, c in (("actual", "actual"), ("pred", "call")) for k, n in _NAMES
) + """, avg(CAST(sign(momentum) = sign(outcome) AS INT)) AS momentum_accuracy FROM l GROUP BY ALL)
SELECT exp_id, model_kind, """ + ", ".join(f"round(avg({m}) + 1e-10, 6) AS mean_{m}" for m in _MEASURES) + """, round(100 * (avg(accuracy) - avg(majority_accuracy)) + 1e-10, 6) AS uplift_vs_majority_pp, round(100 * (avg(accuracy) - avg(momentum_accuracy)) + 1e-10, 6) AS uplift_vs_momentum_pp
FROM g JOIN ma USING (fold_id) GROUP BY exp_id, model_kind"""  # fmt: skip

FEATURES = (
    "td_return_1d", "td_return_5d", "td_return_20d", "td_volatility_20d", "td_dist_52w_high", "td_volume_change_1d", "fx_usdcad_level", "yield_10y_level", "vix_level", "transcript_ceo_prep_sentiment_mean_ffill",
    "report_sentiment_mean_ffill", "framing_gap_ffill", "news_sent_mean_7d", "news_sent_mean_30d", "news_count_30d", "days_since_call",
)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The matrix's features and forward return where they can be readings: what lies beyond 1000 is a stand-in or a fault."""
    m = table(spark, d, "model_features_daily")
    return m.select("row_id", F.year("date").alias("fold"), *[F.when(F.abs(F.col(c).cast("double")) < 1000, F.col(c).cast("double")).alias(c) for c in (*FEATURES, "td_return_5d_fwd")])


def feature_ranking(spark: SparkSession, d: str) -> DataFrame:
    """How steadily each feature of the matrix goes with the forward return, over years."""
    scores = ev.correlation_scores(_scored(spark, d), ["fold"], FEATURES, "td_return_5d_fwd")
    return _ranking_out(ev.stability(scores.withColumn("importance", F.round("importance", 9)), core=5))  # so that features that go alike tie


def _ranking_out(x: DataFrame) -> DataFrame:
    six = [F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("mean_norm", "median_norm", "mean_rank", "median_rank", "top10_share", "top20_share")]
    return x.select("feature", *six, "fold_count", "stable_rank", "selected")


_OK = lambda c: f"CASE WHEN abs(CAST({c} AS DOUBLE)) < 1000 THEN CAST({c} AS DOUBLE) END"
_SCORED = f"m AS (SELECT row_id, CAST(year(date) AS INTEGER) AS fold, {', '.join(f'{_OK(c)} AS {c}' for c in (*FEATURES, 'td_return_5d_fwd'))} FROM model_features_daily)"
_LONG = f"long AS (SELECT * FROM (SELECT * FROM m) UNPIVOT (v FOR feature IN ({', '.join(FEATURES)})))"
_IC = "coalesce(abs(covar_pop(v, td_return_5d_fwd) / nullif(stddev_pop(v) FILTER (td_return_5d_fwd IS NOT NULL) * stddev_pop(td_return_5d_fwd), 0)), 0.0)"
_EVERY = "(SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature)"
RANKING_SQL = STABILITY_SQL.replace(IMP, f"""WITH {_SCORED}, {_LONG}, had AS (SELECT fold, feature, {_IC} AS importance FROM long GROUP BY fold, feature),
imp AS (SELECT fold, f.feature, round(coalesce(importance, 0.0), 9) AS importance FROM (SELECT DISTINCT fold FROM m) CROSS JOIN {_EVERY} f LEFT JOIN had USING (fold, feature)) """).replace("stable_rank <= 15", "stable_rank <= 5")


def bootstrap_vote(spark: SparkSession, d: str) -> DataFrame:
    """In how many of 20 random splits of every year a feature is among the five that go best with the forward return, and which are selected by vote."""
    from pyspark.sql import Window

    x = ev.random_rounds(_scored(spark, d), ["row_id"], rounds=20).where("is_fit")
    imp = ev.correlation_scores(x, ["fold", "round"], FEATURES, "td_return_5d_fwd")
    imp = imp.withColumn("r", F.row_number().over(Window.partitionBy("fold", "round").orderBy(F.round("importance", 9).desc(), "feature")))
    hits = imp.groupBy("feature").agg(F.sum((F.col("r") <= 5).cast("long")).alias("top_hits"), F.round(F.avg("importance"), 9).alias("importance"), F.countDistinct("fold", "round").alias("n"))
    rounds = hits.agg(F.max("n").alias("rounds"))
    y = hits.join(F.broadcast(rounds), on=F.lit(True))  # one row
    y = y.withColumn("frequency", F.col("top_hits") / F.col("rounds"))
    return ev.by_vote(y, most=8).select("feature", "top_hits", F.round("frequency", 6).alias("frequency"), "stable", "place", "selected")


BOOTSTRAP_SQL = f"""WITH {_SCORED}, r AS (SELECT m.*, round FROM m, (SELECT unnest(range(1, 21)) AS round) WHERE ('0x' || substr(md5('42|' || round || '|' || row_id), 1, 8))::BIGINT < {int(0.7 * 2**32)}),
long AS (SELECT * FROM r UNPIVOT (v FOR feature IN ({', '.join(FEATURES)}))), imp AS (SELECT fold, round, feature, {_IC} AS importance FROM long GROUP BY ALL),
every AS (SELECT fold, round, f.feature, coalesce(importance, 0.0) AS importance FROM (SELECT DISTINCT fold, round FROM r) CROSS JOIN (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature) f LEFT JOIN imp USING (fold, round, feature)),
k AS (SELECT *, row_number() OVER (PARTITION BY fold, round ORDER BY round(importance, 9) DESC, feature) AS r FROM every),
h AS (SELECT feature, count(*) FILTER (r <= 5) AS top_hits, round(avg(importance), 9) AS importance, count(*) AS n FROM k GROUP BY feature), s AS (SELECT *, top_hits / CAST(max(n) OVER () AS DOUBLE) AS frequency FROM h),
p AS (SELECT *, frequency >= 0.5 AS stable, row_number() OVER (ORDER BY frequency >= 0.5 DESC, frequency DESC, importance DESC, feature) AS place FROM s)
SELECT feature, top_hits, round(frequency, 6) AS frequency, stable, place, place <= 8 AS selected FROM p"""


def regime_signs(spark: SparkSession, d: str) -> DataFrame:
    """Sign changes of the daily return over ten days, and its correlation with the day before's over twenty."""
    b = bars(spark, d)
    b = b.select("ticker", "date", TICKER.change("adj_close").alias("r"))
    x = persistence(flips(b, TICKER, "r", 10), TICKER, "r", 20)
    return x.select("ticker", "date", "flips", F.round(F.col("autocorrelation") + 1e-10, 6).alias("autocorrelation"))


REGIME_SQL = with_(BARS, "r AS (SELECT ticker, date, adj_close / nullif(lag(adj_close) OVER w, 0) - 1 AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))",
    "b AS (SELECT *, lag(r) OVER w AS b FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date))", "t AS (SELECT *, CAST(sign(r) <> sign(b) AS INTEGER) AS turn FROM b)") + """
SELECT ticker, date, CASE WHEN count(turn) OVER ten = 10 THEN CAST(sum(turn) OVER ten AS BIGINT) END AS flips,
  round(CASE WHEN count(turn) OVER twenty = 20 THEN covar_pop(r, b) OVER twenty / nullif(stddev_pop(CASE WHEN b IS NOT NULL THEN r END) OVER twenty * stddev_pop(CASE WHEN r IS NOT NULL THEN b END) OVER twenty, 0) END + 1e-10, 6) AS autocorrelation
FROM t WINDOW ten AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING), twenty AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)"""

QUERIES = {
    "class_strides": class_strides,
    "experiment_summary": experiment_summary,
    "feature_ranking": feature_ranking,
    "bootstrap_vote": bootstrap_vote,
    "regime_signs": regime_signs,
    "sign_interval": sign_interval,
    "issuer_share": issuer_share,
    "folds_rolling": folds_rolling,
    "folds_expanding": folds_expanding,
    "folds_tuning": folds_tuning,
    "fold_rows": fold_rows,
    "majority_vote": majority_vote,
    "stride_metrics": stride_metrics,
    "confusion": confusion,
    "class_metrics": class_metrics,
    "auc_ovr": auc_ovr,
    "wald_ci": wald_ci,
    "median_impute": median_impute,
    "gates": gates,
    "regression_scores": regression_scores,
    "icir": icir,
    "stability_rank": stability_rank,
    "topk": topk,
    "experiment_winner": experiment_winner,
}

ORACLE = {
    "class_strides": CLASS_STRIDES_SQL,
    "experiment_summary": EXPERIMENTS_SQL,
    "feature_ranking": RANKING_SQL,
    "bootstrap_vote": BOOTSTRAP_SQL,
    "regime_signs": REGIME_SQL,
    "sign_interval": INTERVAL_SQL,
    "issuer_share": SHARE_SQL,
    "folds_rolling": FOLDS + "SELECT * FROM folds",
    "folds_expanding": with_(BARS, _folds_sql(True)) + "SELECT * FROM folds",
    "folds_tuning": TUNING_SQL,
    "fold_rows": ROWS_SQL,
    "majority_vote": CALLS + "SELECT ticker, date, vote, soft FROM calls",
    "stride_metrics": STRIDE_SQL,
    "confusion": CONFUSION_SQL,
    "class_metrics": CLASS_SQL,
    "auc_ovr": AUC_SQL,
    "wald_ci": WALD_SQL,
    "median_impute": MEDIAN_SQL,
    "gates": GATES_SQL,
    "regression_scores": REGRESSION_SQL,
    "icir": ICIR_SQL,
    "stability_rank": STABILITY_SQL,
    "topk": TOPK_SQL,
    "experiment_winner": WINNER_SQL,
}
