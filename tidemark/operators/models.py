"""Models of the three classes and of outcomes, behind one interface; MLlib does the fitting."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantiles
from tidemark.sources.files import read_document, write_document

P = "__md_"


def imputed(train: DataFrame, *others: DataFrame, features: Sequence[str]) -> list[DataFrame]:
    """The frames with missing features (NULL or NaN) put to the training frame's exact medians, 0 where it has none.

    The medians, one number a feature, are fetched once and written into the
    plans; no task holds all values of a feature.
    """
    v = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("f"), v(c).alias("v")) for c in features])))
    m = {r["f"]: r["m"] for r in quantiles(long, ["f"], "v", {"m": 0.5}).collect()}
    fill = {c: F.coalesce(v(c), F.lit(float(m.get(c) or 0.0))) for c in features}
    return [x.withColumns(fill) for x in (train, *others)]


def estimator(kind: str, params: Mapping[str, object] | None = None, seed: int = 42):  # noqa: ANN201
    """logistic, forest, boosted (one against the rest: boosting here knows two classes), or for outcomes forest_regression, boosted_regression."""
    p = dict(params or {})
    f = {"featuresCol": f"{P}x"}
    if kind == "logistic":
        return LogisticRegression(family="multinomial", labelCol=f"{P}y", weightCol=f"{P}w", **f, **({"regParam": 0.01, "maxIter": 100} | p))
    if kind == "forest":
        return RandomForestClassifier(labelCol=f"{P}y", seed=seed, **f, **({"numTrees": 60, "maxDepth": 5} | p))
    if kind == "boosted":
        return OneVsRest(classifier=GBTClassifier(seed=seed, **({"maxIter": 20, "maxDepth": 3} | p)), labelCol=f"{P}y", **f)
    if kind == "forest_regression":
        return RandomForestRegressor(labelCol=f"{P}t", seed=seed, **f, **({"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt"} | p))
    if kind == "boosted_regression":
        return GBTRegressor(labelCol=f"{P}t", seed=seed, **f, **({"maxIter": 40, "maxDepth": 4} | p))
    raise ValueError(f"no model {kind}")


def balanced(train: DataFrame, label: str) -> DataFrame:
    """Weights that give every class the same total; the class counts, three rows, are broadcast."""
    n = train.groupBy(label).agg(F.count("*").alias(f"{P}n"))
    every = Window.partitionBy()  # a row a class
    w = n.select(label, (F.sum(f"{P}n").over(every) / (F.count("*").over(every) * F.col(f"{P}n"))).alias(f"{P}w"))
    return train.join(F.broadcast(w), on=label)


def fit(train: DataFrame, features: Sequence[str], label: str, kind: str, params: Mapping[str, object] | None = None, *, components: int | None = None) -> PipelineModel:
    """A pipeline of assembling, scaling (and principal components) and the model; label in -1, 0, 1, or any number for regressions."""
    regression = kind.endswith("regression")
    x = train.withColumn(f"{P}t", F.col(label).cast("double")) if regression else balanced(train, label).withColumn(f"{P}y", (F.col(label) + 1).cast("double"))
    steps = [VectorAssembler(inputCols=list(features), outputCol=f"{P}v", handleInvalid="error")]
    scaled = kind == "logistic" or components
    steps.append(StandardScaler(inputCol=f"{P}v", outputCol=f"{P}s" if components else f"{P}x", withMean=True, withStd=True) if scaled else VectorAssembler(inputCols=[f"{P}v"], outputCol=f"{P}x"))
    if components:
        steps.append(PCA(k=components, inputCol=f"{P}s", outputCol=f"{P}x"))
    return Pipeline(stages=[*steps, estimator(kind, params)]).fit(x)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with prediction (class or outcome) and, where the model has them, prob: the three classes' probabilities."""
    x = model.transform(rows)
    kind = type(model.stages[-1]).__name__
    regression = "Regression" in kind and "Logistic" not in kind
    out = [F.col("prediction") if regression else (F.col("prediction") - 1).cast("int").alias("prediction")]
    if "probability" in x.columns:
        out.append(vector_to_array("probability").alias("prob"))
    return x.select(*[c for c in rows.columns if c != "prediction"], *out)


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Share of each feature in the reduction of impurity, of a tree ensemble."""
    last = model.stages[-1]
    trees = last.models if hasattr(last, "models") else [last]
    total = sum((t.featureImportances.toArray() for t in trees)) / len(trees)
    return sorted(zip(features, map(float, total)), key=lambda p: (-p[1], p[0]))


def _paths(node, held: dict[int, tuple[float, float, float]], value, out: list) -> None:  # noqa: ANN001
    """All leaves under a node: its value and, for every feature asked on the way, the interval that leads there and the share of training rows that went that way."""
    if node.getClass().getSimpleName() == "LeafNode":
        out.append((value(node), [(f, *x) for f, x in sorted(held.items())]))
        return
    f, cut, whole = node.split().featureIndex(), node.split().threshold(), float(node.impurityStats().count())
    low, high, share = held.get(f, (-np.inf, np.inf, 1.0))
    for child, a, z in ((node.leftChild(), low, min(high, cut)), (node.rightChild(), max(low, cut), high)):
        _paths(child, held | {f: (a, z, share * float(child.impurityStats().count()) / whole)}, value, out)


def tree_paths(model: PipelineModel) -> list[tuple[np.ndarray, list[tuple[int, float, float, float]]]]:
    """The leaves of a forest of continuous features, weighted as the forest does: class shares of a classifier, the outcome of a regression."""
    last = model.stages[-1]
    weights = np.asarray(last.treeWeights, dtype=float)
    if "Regression" in type(last).__name__:
        value = lambda n: np.array([float(n.prediction())])
    else:
        value = lambda n: np.asarray(list(n.impurityStats().stats()), dtype=float) / max(float(n.impurityStats().count()), 1e-300)
    out: list = []
    scale = weights if type(last).__name__.startswith("GBT") else weights / weights.sum()
    for t, w in zip(last.trees, scale):
        mine: list = []
        _paths(t._java_obj.rootNode(), {}, value, mine)
        out += [(w * v, way) for v, way in mine]
    return out


def attributions(x: np.ndarray, paths: Sequence[tuple[np.ndarray, list[tuple[int, float, float, float]]]]) -> np.ndarray:
    """Shapley values (rows, features, outputs) of the forest with these leaves, a feature that is left out going either way by the shares of training rows.

    A leaf is a product over the features asked on its way, of 1 or 0 for those
    that are known and of a share for the others; its Shapley values are sums
    over the subsets of these few features. Over all features they add up to the
    forest's output less its mean.
    """
    phi = np.zeros((*x.shape, len(paths[0][0]) if paths else 0))
    for value, way in paths:
        d = len(way)
        share = [r for *_, r in way]
        inside = [((x[:, f] > a) & (x[:, f] <= z)).astype(float) for f, a, z, _ in way]
        for j in range(d):
            rest = [i for i in range(d) if i != j]
            total = np.zeros(len(x))
            for subset in range(1 << len(rest)):
                known = [i for k, i in enumerate(rest) if subset >> k & 1]
                weight = math.factorial(len(known)) * math.factorial(d - len(known) - 1) / math.factorial(d)
                term = np.full(len(x), weight * math.prod(share[i] for i in rest if i not in known))
                for i in known:
                    term *= inside[i]
                total += term
            phi[:, way[j][0]] += (total * (inside[j] - share[j]))[:, None] * value
    return phi


def attribution_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, output (class -1, 0, 1; 0 for a regression), importance: the mean absolute Shapley value over the rows.

    The leaves, bounded by the forest's size, go with the plan; every batch is
    summed where it is, so that a row a batch, feature and output is shuffled.
    """
    paths, names = tree_paths(model), list(features)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            phi = np.abs(attributions(f[names].to_numpy(dtype=float), paths)).sum(0)
            k = phi.shape[1]
            yield pd.DataFrame({"feature": np.repeat(names, k), "output": np.tile(np.arange(k) - (k > 1), len(names)), "total": phi.ravel(), "n": len(f)})

    x = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(sums, "feature string, output long, total double, n long")
    return x.groupBy("feature", F.col("output").cast("int").alias("output")).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("importance"))


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], label: str, row_id: str) -> list[tuple[str, float]]:
    """How much accuracy falls when a feature's values are dealt to other rows: those of the row next by a hash.

    One pass for each feature; each shuffles two columns.
    """
    base = predict(model, rows).agg(F.avg((F.col("prediction") == F.col(label)).cast("int"))).first()[0] or 0.0
    out = []
    for i, f in enumerate(features):
        a = rows.select(F.col(row_id).alias(f"{P}id"), F.col(f).alias(f"{P}v")).withColumn(f"{P}b", F.pmod(F.xxhash64(f"{P}id"), F.lit(64)))
        w = Window.partitionBy(f"{P}b").orderBy(F.xxhash64(F.lit(i), F.col(f"{P}id")))
        dealt = a.select(f"{P}id", F.coalesce(F.lead(f"{P}v").over(w), F.first(f"{P}v").over(w)).alias(f))
        x = rows.drop(f).join(dealt, on=F.col(row_id) == F.col(f"{P}id")).drop(f"{P}id")
        out.append((f, base - (predict(model, x).agg(F.avg((F.col("prediction") == F.col(label)).cast("int"))).first()[0] or 0.0)))
    return sorted(out, key=lambda p: (-p[1], p[0]))


def _normal(prob: Column) -> Column:
    total = F.aggregate(prob, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.transform(prob, lambda p: p / total)).otherwise(prob)


def platt(held_out: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with prob calibrated by a logistic curve per class, fitted on held-out predictions, then normalised; a class with fewer than two cases on either side stays as it is."""
    curves: list[Column] = []
    for i, c in enumerate((-1, 0, 1)):
        y = (F.col(label) == c).cast("double")
        n = held_out.agg(F.sum(y), F.count("*")).first()
        p = F.get("prob", F.lit(i))
        if (n[0] or 0) < 2 or n[1] - (n[0] or 0) < 2:
            curves.append(p)
            continue
        x = VectorAssembler(inputCols=[f"{P}p"], outputCol=f"{P}x").transform(held_out.select(p.alias(f"{P}p"), y.alias(f"{P}y")))
        m = LogisticRegression(featuresCol=f"{P}x", labelCol=f"{P}y", regParam=1.0 / max(n[1], 1), maxIter=200).fit(x)
        curves.append(1 / (1 + F.exp(-(p * float(m.coefficients[0]) + float(m.intercept)))))
    return rows.withColumn("prob", _normal(F.array(*curves)))


def isotonic(held_out: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """As ``platt``, by a rising step curve per class, clipped beyond the held-out range; a class with fewer than three cases stays as it is."""
    out = rows
    for i, c in enumerate((-1, 0, 1)):
        y = (F.col(label) == c).cast("double")
        p = F.get("prob", F.lit(i))
        if (held_out.agg(F.sum(y)).first()[0] or 0) < 3:
            out = out.withColumn(f"{P}c{i}", p)
            continue
        m = IsotonicRegression(featuresCol=f"{P}p", labelCol=f"{P}y").fit(held_out.select(p.alias(f"{P}p"), y.alias(f"{P}y")))
        out = m.setPredictionCol(f"{P}c{i}").transform(out.withColumn(f"{P}p", p)).drop(f"{P}p")
    return out.withColumn("prob", _normal(F.array(*[F.col(f"{P}c{i}") for i in range(3)]))).drop(*[f"{P}c{i}" for i in range(3)])


def save(model: PipelineModel, path: str, features: Sequence[str], params: Mapping[str, object]) -> None:
    """The pipeline and, beside it, what it was fitted on, in a folder."""
    model.write().overwrite().save(f"{path}/model")
    write_document(SparkSession.active(), f"{path}/about", {"features": list(features), "params": dict(params)})


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, object]]:
    return PipelineModel.load(f"{path}/model"), read_document(spark, f"{path}/about")
