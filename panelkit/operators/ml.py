"""Distributed model jobs on ranked features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators import dataset, metrics


#: Name of the column of features as one vector; rows that have it are taken as they are.
VECTOR = "features"


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows if VECTOR in rows.columns else rows.na.fill(0.0, features)


def _stages(rows: DataFrame, features: list[str], gbt: GBTRegressor) -> Pipeline:
    return Pipeline(stages=[gbt] if VECTOR in rows.columns else [VectorAssembler(inputCols=features, outputCol=VECTOR), gbt])


def fit_regression(train: DataFrame, features: list[str], label: str, depth: int = 3, rounds: int = 10, seed: int = 42) -> PipelineModel:
    rows = _filled(train.where(F.col(label).isNotNull()), features)
    if VECTOR in rows.columns:
        rows = rows.select(VECTOR, label)
    gbt = GBTRegressor(featuresCol=VECTOR, labelCol=label, predictionCol=f"pred_{label}", maxDepth=depth, maxIter=rounds, seed=seed)
    return _stages(rows, features, gbt).fit(rows)


def fit_early_stop(rows: DataFrame, features: list[str], label: str, share: float = 0.1, depth: int = 3, rounds: int = 50, tolerance: float = 0.01, seed: int = 42) -> tuple[PipelineModel, int]:
    """(model, rounds used): boosting that is checked on the last ``share`` of dates and stops when it gains nothing there."""
    held = _filled(dataset.time_holdout(rows.where(F.col(label).isNotNull()), share), features)
    gbt = GBTRegressor(featuresCol=VECTOR, labelCol=label, predictionCol=f"pred_{label}", maxDepth=depth, maxIter=rounds, seed=seed, validationIndicatorCol="holdout", validationTol=tolerance)
    model = _stages(held, features, gbt).fit(held)
    return model, model.stages[-1].getNumTrees


def score_panel(panel: DataFrame, features: list[str], models: list[PipelineModel]) -> DataFrame:
    out, ready = _filled(panel, features), VECTOR in panel.columns
    for m in models:
        out = m.transform(out)
        out = out if ready else out.drop(VECTOR)
    return out.drop(VECTOR)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance; as many rows as there are features."""
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, weights)), key=lambda x: (-x[1], x[0]))


def tune_timesplit(rows: DataFrame, features: list[str], label: str, depths: list[int], folds: int | None = None) -> DataFrame:
    """(depth, fold, mse): every setting fitted on dates before each of the later folds.

    ``rows`` has a fold number in date order; without ``folds`` all of them count.  The loop
    is over a few settings, Spark does the fitting.
    """
    spark, out = rows.sparkSession, []
    if folds is None:
        folds = (rows.agg(F.max("fold")).first()[0] or 0) + 1
    for depth in depths:
        for fold in range(1, folds):
            model = fit_regression(rows.where(F.col("fold") < fold), features, label, depth, 5)
            scored = score_panel(rows.where((F.col("fold") == fold) & F.col(label).isNotNull()), features, [model])
            mse = scored.agg(F.avg(F.pow(F.col(label) - F.col(f"pred_{label}"), 2.0))).first()[0]
            out.append((depth, fold, mse))
    return spark.createDataFrame(out, "depth int, fold int, mse double")


def walkforward(folds: DataFrame, features: list[str], label: str) -> DataFrame:
    """(fold, n_dates, ic_mean, ...): fit, score and evaluate each fold of (fold, split, ...)."""
    out = None
    for fold in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        rows = folds.where(F.col("fold") == fold)
        model = fit_regression(rows.where("split = 'train'"), features, label, rounds=5)
        scored = score_panel(rows.where("split = 'test'"), features, [model])
        ic = metrics.rank_ic(scored, f"pred_{label}", label).withColumn("fold", F.lit(fold))
        out = ic if out is None else out.unionByName(ic)
    return out
