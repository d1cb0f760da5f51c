"""Ridge regression from moments, for all folds and all penalties of a grid from sums by cell (operators/folds.py).

Per fold: exact medians fill the training columns (a column that is all null is 0), means and population deviations scale
them (a constant column by 1). The p x p systems are solved on the driver, and predictions are a column expression over a
broadcast table of coefficients.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds

#: A column whose deviation is at most this is constant but for rounding.
CONSTANT = 1e-9


@dataclass(frozen=True)
class Fit:
    """One fold's fitted columns: fill values, means, scales, and centred cross moments per training row."""

    fold: int
    rows: int
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    cross: np.ndarray
    cross_y: np.ndarray
    mean_y: float

    def coefficients(self, alpha: float, used: list[int] | None = None) -> np.ndarray:
        """Weights of the standardised columns for ||y - Xw - b||^2 + alpha ||w||^2; unused columns get 0."""
        used = list(range(len(self.means))) if used is None else used
        weights = np.zeros(len(self.means))
        scale = self.scales[used]
        gram = self.rows * self.cross[np.ix_(used, used)] / np.outer(scale, scale)
        weights[used] = np.linalg.solve(gram + alpha * np.eye(len(used)), self.rows * self.cross_y[used] / scale)
        return weights


def fit_cells(rows: DataFrame, features: list[str], target: str, cell: Column, members: Callable[[list[str]], dict[int, list[str]]]) -> tuple[list[Fit], folds.Statistics]:
    """The fits of all folds. members: from the names of the cells to the cells that train each fold; folds without any are left out."""
    rows = rows.select(cell.cast("string").alias("cell_"), target, *features).persist()  # read for sums, then for medians
    found = folds.cell_statistics(rows, features, target, F.col("cell_"))
    trained = {fold: own for fold, own in members(sorted(found.sums)).items() if own}
    middle, fits = folds.medians(rows, found, F.col("cell_"), trained), []
    for fold, own in sorted(trained.items()):
        n, means, cross, cross_y, mean_y = found.of(own, middle[fold])
        deviation = np.sqrt(np.maximum(np.diag(cross), 0))
        size = np.abs(means - found.shift) + deviation
        fits.append(Fit(fold, n, middle[fold], means, np.where(deviation > np.maximum(CONSTANT, 1e-7 * size), deviation, 1.0), cross, cross_y, mean_y))
    rows.unpersist()
    return fits, found


def fit_folds(train: DataFrame, features: list[str], target: str, fold: str = "eval_period") -> list[Fit]:
    """Fits of folds whose rows are given for each fold (eval_period) on their own: each fold is a cell."""
    return fit_cells(train, features, target, F.col(fold), lambda cells: {int(c): [c] for c in cells})[0]


def parameters(spark, fits: list[Fit], features: list[str], alphas: list[float], groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Long table (fold, alpha, group, feature, weight, median, mean, scale, intercept) of every fitted model."""
    rows = []
    for fit in fits:
        for alpha in alphas:
            for name, members in (groups or {"all": features}).items():
                weights = fit.coefficients(alpha, [features.index(c) for c in members])
                rows += [(fit.fold, float(alpha), name, c, float(weights[i]), float(fit.medians[i]), float(fit.means[i]), float(fit.scales[i]), fit.mean_y, fit.rows) for i, c in enumerate(features) if c in members]
    return spark.createDataFrame(rows, "fold int, alpha double, group string, feature string, weight double, median double, mean double, scale double, intercept double, train_rows long")


def predictions(evaluate: DataFrame, fitted: DataFrame, features: list[str], fold: str = "eval_period") -> DataFrame:
    """`evaluate` with one row per (alpha, group) of its fold, and predicted_log."""
    wide = fitted.groupBy(F.col("fold").alias(fold), "alpha", "group").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("weight", "median", "mean", "scale")))).alias("m_"), F.first("intercept").alias("b_"))

    def part(c: str) -> Column:
        m = F.col("m_")[c]
        return F.when(m.isNull(), 0.0).otherwise(m["weight"] * (F.coalesce(F.col(c), m["median"]) - m["mean"]) / m["scale"])

    total = F.col("b_")
    for c in features:
        total = total + part(c)
    return evaluate.join(F.broadcast(wide), fold).withColumn("predicted_log", total).drop("m_", "b_")


def select_alpha(scores: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The largest penalty whose score is within the tolerance of the best one."""
    best = scores.agg(F.min("balanced").alias("best"))
    return scores.join(F.broadcast(best)).where(F.col("balanced") <= F.col("best") * (1 + tolerance)).agg(F.max("alpha").alias("alpha"), F.max_by("balanced", "alpha").alias("balanced"))


def contributions(spark, statistics: folds.Statistics, fits: list[Fit], alpha: float, evaluated: Callable[[int], list[str]]) -> DataFrame:
    """Per fold and feature: weight * mean z of the evaluated cells (that of training is 0); they add up to the mean prediction's change. Made of the sums alone."""
    out = []
    for fit in fits:
        cells = [c for c in evaluated(fit.fold) if c in statistics.sums]
        if cells:
            z = (statistics.of(cells, fit.medians)[1] - fit.means) / fit.scales
            out += [(fit.fold, c, 0.0, float(z[i]), float(w * z[i])) for i, (c, w) in enumerate(zip(statistics.features, fit.coefficients(alpha), strict=True))]
    return spark.createDataFrame(out, "fold int, feature string, z_train double, z_evaluate double, contribution double")
