"""Walk-forward slices, votes and metrics of three-class calls (-1, 0, 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import placed, quantiles, ranked

CLASSES = (-1, 0, 1)


def walk_forward(days: DataFrame, date: str, *, train: int = 504, test: int = 63, gap: int = 5, expanding: bool = False) -> DataFrame:
    """fold_id, train_start, train_end, test_start, test_end over the distinct dates of ``days``.

    Test slices of ``test`` dates follow each other; training ends ``gap`` dates
    before each and has ``train`` dates, or all before with ``expanding``. The
    dates, one a calendar day, are put into one sorted array. No folds where
    there are too few dates; NULL dates are none.
    """
    a = days.where(F.col(date).isNotNull()).agg(F.sort_array(F.collect_set(date)).alias("d")).withColumn("n", F.size("d"))
    at = a.where(F.col("n") > train + gap).select("d", "n", F.posexplode(F.sequence(F.lit(train + gap), F.col("n") - 1, F.lit(test))).alias("k", "i"))
    first = F.lit(0) if expanding else F.greatest(F.lit(0), F.col("i") - gap - train)
    get = lambda i: F.get("d", i)
    return at.select(
        (F.col("k") + 1).alias("fold_id"), get(first).alias("train_start"), get(F.col("i") - 1 - gap).alias("train_end"),
        get(F.col("i")).alias("test_start"), get(F.least(F.col("i") + test - 1, F.col("n") - 1)).alias("test_end"),
    )


def tuning_folds(folds: DataFrame) -> DataFrame:
    """The middle folds, from max(2, n // 4) to min(n - 2, 3 n // 4) by place, both in."""
    w = Window.orderBy("fold_id")  # folds are few
    n = F.count("*").over(Window.partitionBy())
    x = folds.withColumns({"__i": F.row_number().over(w) - 1, "__n": n})
    low, high = F.greatest(F.lit(2), F.floor(F.col("__n") / 4)), F.least(F.col("__n") - 2, F.floor(3 * F.col("__n") / 4))
    return x.where(F.col("__i").between(low, high)).drop("__i", "__n")


def chronological_split(df: DataFrame, by: Sequence[str], order: str, share: float = 0.8, least: int = 80, leave: int = 40) -> DataFrame:
    """``df`` with is_fit: the first share of each group's rows, at least ``least``, leaving at least ``leave``."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    k = F.least(F.greatest(F.floor(n * share), F.lit(least)), n - leave)
    return df.withColumn("is_fit", F.row_number().over(w.orderBy(order)) <= k)


def majority_vote(*votes: Column) -> Column:
    """The class most voters name; 0 on a tie. NULL votes count for none."""
    n = {c: sum((F.coalesce((v == c).cast("int"), F.lit(0)) for v in votes), F.lit(0)) for c in CLASSES}
    top = F.greatest(*n.values())
    winners = sum(((x == top).cast("int") for x in n.values()), F.lit(0))
    return F.when(winners > 1, 0).when(n[1] == top, 1).when(n[-1] == top, -1).otherwise(0)


def soft_vote(*probabilities: Column) -> Column:
    """Class of the greatest mean probability (arrays in the order of CLASSES), the first of equals."""
    mean = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: sum((F.get(p, i) for p in probabilities), F.lit(0.0)) / len(probabilities))
    return (F.array_position(mean, F.array_max(mean)) - 2).cast("int")


def confidence_gate(probability: Column, least: float) -> Column:
    """The class of the greatest probability, 0 where that is below ``least``."""
    top = F.array_max(probability)
    return F.when(top < least, 0).otherwise((F.array_position(probability, top) - 2).cast("int"))


def regime_gate(call: Column, volatility: Column, cutoff: Column) -> Column:
    """0 where volatility is known and above the cutoff, else the call."""
    return F.when(volatility > cutoff, 0).otherwise(call)


def confusion(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Counts of every pair of classes in each group, 0 included."""
    pairs = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.sum(F.coalesce(((F.col(actual) == a) & (F.col(predicted) == p)).cast("long"), F.lit(0))).alias("n")) for a in CLASSES for p in CLASSES])
    return df.groupBy(*by).agg(pairs.alias("__p")).select(*by, F.inline("__p"))


def _f1(actual: str, predicted: str) -> Column:
    scores = []
    for c in CLASSES:
        a, p = F.col(actual) == c, F.col(predicted) == c
        both = F.sum((a & p).cast("int"))
        scores.append(F.coalesce(F.try_divide(2 * both, F.sum(a.cast("int")) + F.sum(p.cast("int"))), F.lit(0.0)))
    return sum(scores[1:], scores[0]) / len(scores)


def stride_metrics(df: DataFrame, by: Sequence[str], order: str, *, actual: str, predicted: str, outcome: str, stride: int = 5) -> DataFrame:
    """Accuracy, macro F1, share of calls and accuracy of their sign against ``outcome``, averaged over ``stride`` interleaved samples of each group.

    A sample without calls has no sign accuracy and doesn't count for it. Rows
    need all of actual, predicted and outcome.
    """
    d = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull() & F.col(outcome).isNotNull())
    d = d.withColumn("__o", F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, F.lit(stride)))
    called = F.col(predicted) != 0
    per = d.groupBy(*by, "__o").agg(
        F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy"), _f1(actual, predicted).alias("macro_f1"), F.avg(called.cast("int")).alias("coverage"),
        F.avg(F.when(called, (F.signum(F.col(predicted).cast("double")) == F.signum(outcome)).cast("int"))).alias("sign_accuracy"),
    )
    return per.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("accuracy", "macro_f1", "coverage", "sign_accuracy")])


def class_metrics(df: DataFrame, by: Sequence[str], *, actual: str, predicted: str) -> DataFrame:
    """Per class actual and predicted share, precision and recall (NULL without predictions or cases), and the greatest predicted share."""
    aggs = []
    for c, name in zip(CLASSES, ("neg", "neu", "pos")):
        a, p = F.col(actual) == c, F.col(predicted) == c
        aggs += [
            F.avg(a.cast("int")).alias(f"actual_{name}"), F.avg(p.cast("int")).alias(f"pred_{name}"),
            F.avg(F.when(p, a.cast("int"))).alias(f"precision_{name}"), F.avg(F.when(a, p.cast("int"))).alias(f"recall_{name}"),
        ]
    return df.groupBy(*by).agg(*aggs).withColumn("pred_max", F.greatest("pred_neg", "pred_neu", "pred_pos"))


def auc(df: DataFrame, by: Sequence[str], *, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve per group, ties shared; NULL where one class is missing. Rows with NULLs are left out.

    Rows are first counted per score, so that what is sorted is distinct scores.
    """
    d = df.where(F.col(positive).isNotNull() & F.col(score).isNotNull())
    g = d.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(score)
    g = g.withColumn("neg", F.col("n") - F.col("p"))
    below = F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("area", F.col("p") * (below + F.col("neg") / 2))
    return g.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("neg").alias("n_neg"), F.try_divide(F.sum("area"), F.sum("p") * F.sum("neg")).alias("auc"))


def regression_metrics(df: DataFrame, by: Sequence[str], *, actual: str, predicted: str) -> DataFrame:
    """n, r2, mae, rmse, share of matching signs among nonzero outcomes. r2 is NULL where outcomes don't vary."""
    a, p = F.col(actual), F.col(predicted)
    d = df.where(a.isNotNull() & p.isNotNull())
    err = a - p
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.sum(err * err), F.var_pop(a) * F.count("*"))).alias("r2"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.when(a != 0, (F.signum(a) == F.signum(p)).cast("int"))).alias("sign_accuracy"),
    )


def rank_ic(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group, ties with mean ranks; a group is ranked in parts."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = ranked(ranked(d.select(*by, F.col(x).alias("x"), F.col(y).alias("y")), by, "x", "p"), by, "y", "q")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("p", "q"), F.stddev_pop("p") * F.stddev_pop("q")).alias("ic"))


def wald(share: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the normal interval of a share; NULL without cases."""
    half = z * F.sqrt(F.try_divide(share * (1 - share), n))
    return share - half, share + half


def majority_class(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The most frequent label of each group, the least of equals."""
    c = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"))


def train_medians(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact median of each column per group, NULL where it has no value; a column at a time, each group in parts."""
    out = rows.select(*by).distinct()
    for c in columns:
        m = quantiles(rows, by, c, {c: 0.5})
        out = out.join(m, on=list(by), how="left")
    return out


def class_strides(df: DataFrame, by: Sequence[str], order: str, *, actual: str, predicted: str, outcome: str, stride: int = 5) -> DataFrame:
    """Per class the precision, recall and sign accuracy (share of its calls whose sign is that of ``outcome``; of class 0, of nonzero outcomes none) and the number of calls, averaged over ``stride`` interleaved samples of each group.

    A sample without calls, or cases, of a class doesn't count for it; rows need all of actual, predicted and outcome.
    """
    d = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull() & F.col(outcome).isNotNull())
    d = d.withColumn("__o", F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, F.lit(stride)))
    sign = F.signum(F.col(outcome).cast("double"))
    cells = []
    for c in CLASSES:
        a, p = F.col(actual) == c, F.col(predicted) == c
        cells.append(F.struct(
            F.lit(c).alias("label"), F.avg(F.when(p, a.cast("int"))).alias("precision"), F.avg(F.when(a, p.cast("int"))).alias("recall"), F.avg(F.when(p, (sign == c).cast("int"))).alias("sign_accuracy"), F.sum(p.cast("long")).alias("n_calls"),
        ))
    per = d.groupBy(*by, "__o").agg(F.array(*cells).alias("__c")).select(*by, F.inline("__c"))
    return per.groupBy(*by, "label").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "sign_accuracy", "n_calls")])


def experiment_summary(folds: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean over folds of each measure by experiment (mean_...), with uplift_vs_majority_pp and uplift_vs_momentum_pp in points where accuracy and the baseline are among the measures. NULL keys are keys."""
    g = folds.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])
    for base in ("majority", "momentum"):
        if {"accuracy", f"{base}_accuracy"} <= set(measures):
            g = g.withColumn(f"uplift_vs_{base}_pp", 100 * (F.col("mean_accuracy") - F.col(f"mean_{base}_accuracy")))
    return g


def random_rounds(df: DataFrame, row_id: Sequence[str], rounds: int = 20, share: float = 0.7, seed: int = 42) -> DataFrame:
    """``df`` once for each of ``rounds`` random splits, with round and is_fit for about ``share`` of the rows, by a digest of seed, round and id: the same on every run.

    Rows are multiplied within their task; aggregate them by round before anything is shuffled.
    """
    x = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "round", *row_id)), 1, 8), 16, 10).cast("long")
    return x.withColumn("is_fit", digest < int(share * 2**32))


def correlation_scores(df: DataFrame, by: Sequence[str], features: Sequence[str], outcome: str) -> DataFrame:
    """by, feature, importance: the absolute correlation of each feature with the outcome in each group; 0 where one doesn't vary. One aggregation; NULL and NaN values are left out pair by pair."""
    v = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    cells = []
    for f in features:
        a = F.when(v(outcome).isNotNull(), v(f))
        b = F.when(v(f).isNotNull(), v(outcome))
        cells.append(F.struct(F.lit(f).alias("feature"), F.coalesce(F.abs(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))), F.lit(0.0)).alias("importance")))
    return df.groupBy(*by).agg(F.array(*cells).alias("__c")).select(*by, F.inline("__c"))


def stability(importances: DataFrame, core: int = 15) -> DataFrame:
    """Features ranked by how steadily they matter over folds: (fold, feature, importance) in, one row per feature out.

    Importances are normalised within a fold and ranked there (equal ones by
    name); features are ordered by their share of folds in the first 20, in the
    first 10, median and mean normalised importance, mean rank, name.
    """
    w = Window.partitionBy("fold")
    x = importances.withColumn("norm", F.try_divide(F.col("importance"), F.sum("importance").over(w)))
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.col("importance").desc(), "feature")))
    g = x.groupBy("feature").agg(
        F.avg("norm").alias("mean_norm"), F.median("norm").alias("median_norm"), F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"),
        F.avg((F.col("rank") <= 10).cast("int")).alias("top10_share"), F.avg((F.col("rank") <= 20).cast("int")).alias("top20_share"), F.countDistinct("fold").alias("fold_count"),
    )
    order = [F.col("top20_share").desc(), F.col("top10_share").desc(), F.col("median_norm").desc(), F.col("mean_norm").desc(), F.col("mean_rank").asc(), F.col("feature").asc()]
    g = g.withColumn("stable_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a row a feature
    return g.withColumn("selected", F.col("stable_rank") <= core)


def vote_selection(hits: DataFrame, rounds: int, share: float = 0.5, most: int = 30) -> DataFrame:
    """From (feature, top_hits, importance): features in at least ``share`` of the rounds first, others after them, up to ``most`` selected."""
    return by_vote(hits.withColumn("frequency", F.col("top_hits") / F.lit(rounds)), share, most)


def by_vote(hits: DataFrame, share: float = 0.5, most: int = 30) -> DataFrame:
    """As ``vote_selection``, from (feature, frequency, importance)."""
    x = hits.withColumn("stable", F.col("frequency") >= share)
    order = [F.col("stable").desc(), F.col("frequency").desc(), F.col("importance").desc(), F.col("feature").asc()]
    x = x.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a row a feature
    return x.withColumn("selected", F.col("place") <= most)


def acceptable(df: DataFrame) -> Column:
    """Uplift over majority above 2 points, over momentum above 1, macro F1 above 0.34, sign accuracy above 0.5."""
    up = lambda a: 100 * (F.col("accuracy") - F.col(a))
    return (up("majority_accuracy") > 2.0) & (up("momentum_accuracy") > 1.0) & (F.col("macro_f1") > 0.34) & (F.col("sign_accuracy") > 0.5)


def beats(sign_accuracy: Column, macro_f1: Column, coverage: Column, base_sign_accuracy: Column, base_macro_f1: Column) -> Column:
    """Better signs than the baseline, macro F1 no more than 0.01 below it, coverage 0.7 at least; false without a baseline."""
    return F.coalesce((sign_accuracy > base_sign_accuracy) & (macro_f1 >= base_macro_f1 - 0.01) & (coverage >= 0.7), F.lit(False))


def stage_winner(df: DataFrame, stage: str, least_coverage: float = 0.7) -> DataFrame:
    """The best row of each stage among those with enough coverage, or of all where none has: by sign accuracy, coverage, accuracy, macro F1, name."""
    enough = (F.col("coverage") >= least_coverage).cast("int")
    order = [enough.desc(), F.col("sign_accuracy").desc(), F.col("coverage").desc(), F.col("accuracy").desc(), F.col("macro_f1").desc(), F.col("exp_id").asc()]
    x = df.withColumn("__r", F.row_number().over(Window.partitionBy(stage).orderBy(*order)))
    return x.where("__r = 1").drop("__r")


def hash_split(df: DataFrame, row_id: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """``df`` with is_fit for about ``share`` of the rows, by a hash of the id and the seed: the same on every run."""
    return df.withColumn("is_fit", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1_000_000)) < int(share * 1_000_000))


def fixed_folds(spark, folds: Sequence[tuple[str, str, str, str]]) -> DataFrame:  # noqa: ANN001
    """Folds given as (id, last training day, first and last test day)."""
    x = spark.createDataFrame(list(folds), "fold_id string, train_end string, test_start string, test_end string")
    return x.select("fold_id", *[F.col(c).cast("date").alias(c) for c in ("train_end", "test_start", "test_end")])


def offset_interval(df: DataFrame, by: Sequence[str], order: Column | str, ties: Sequence[str] = (), *, predicted: str, outcome: str, stride: int = 5, t: float = 2.776) -> DataFrame:
    """Mean over ``stride`` interleaved samples of the share of right signs among nonzero outcomes, with its 95 % interval (t of stride - 1 degrees); order is a number."""
    d = df.where(F.col(predicted).isNotNull() & F.col(outcome).isNotNull())
    d = placed(d, by, order, "__o", ties).withColumn("__o", F.pmod(F.col("__o") - 1, F.lit(stride)))
    hit = F.when(F.col(outcome) != 0, (F.signum(F.col(predicted).cast("double")) == F.signum(F.col(outcome).cast("double"))).cast("int"))
    per = d.groupBy(*by, "__o").agg(F.avg(hit).alias("share"))
    g = per.groupBy(*by).agg(F.avg("share").alias("share"), F.stddev_samp("share").alias("sd"), F.count("share").alias("k"))
    half = t * F.col("sd") / F.sqrt("k")
    return g.select(*by, "share", (F.col("share") - half).alias("low"), (F.col("share") + half).alias("high"))


def strict_accuracy(sign_accuracy: Column, coverage: Column) -> Column:
    """Right calls among all rows."""
    return sign_accuracy * coverage


def abstain_half(sign_accuracy: Column, coverage: Column) -> Column:
    """As strict_accuracy, a row without a call counting half."""
    return sign_accuracy * coverage + 0.5 * (1 - coverage)


def weighted_mean(value: str, weight: str) -> Column:
    """Mean weighted over the rows that have a value."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def share_of_total(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, total, percent of all (one place) of ``value``."""
    g = df.groupBy(by).agg(F.sum(value).alias("total"))
    return g.withColumn("percent", F.round(F.try_divide(100.0 * F.col("total"), F.sum("total").over(Window.partitionBy())), 1))  # a row a group


def tier(count: Column, strong: int, some: int) -> Column:
    """"stable", "frequent", "rare" or "never" by how often something was selected."""
    return F.when(count >= strong, "stable").when(count >= some, "frequent").when(count > 0, "rare").otherwise("never")


def grid_search(configurations: Sequence[dict], folds: Sequence, score, parallel: int = 4) -> list[tuple[float, dict]]:  # noqa: ANN001
    """(0.6 sign accuracy + 0.4 macro F1, configuration) of each, averaged over folds, the best first; score(configuration, fold) gives both numbers, None where there were no calls.

    ``parallel`` fits are submitted at a time; each is a job of its own on the cluster.
    """
    from concurrent.futures import ThreadPoolExecutor

    pairs = [(i, f) for i in range(len(configurations)) for f in folds]
    with ThreadPoolExecutor(parallel) as pool:
        got = list(pool.map(lambda p: score(configurations[p[0]], p[1]), pairs))
    out = []
    for i, c in enumerate(configurations):
        have = [g for (k, _), g in zip(pairs, got) if k == i and g is not None]
        out.append((sum(0.6 * a + 0.4 * b for a, b in have) / len(have) if have else float("-inf"), c))
    return sorted(out, key=lambda p: -p[0])


def run_stages(stages: Sequence, run, first: dict) -> list[dict]:  # noqa: ANN001
    """Results of a queue of experiments that grows: each stage, given the best result so far (``first`` to begin with), names the next ones; run(experiment) gives a dict with a score."""
    done: list[dict] = []
    best = first
    for stage in stages:
        results = [run(e) for e in stage(best)]
        done += results
        best = max([best, *results], key=lambda r: r.get("score", float("-inf")))
    return done
