"""Statistics of training folds that are unions of cells (target periods, release pairs): each row is read for its own cell only.

`cell_statistics` keeps, for each cell, the sums and products of all predictors and the target, split by which predictors are there; what a
missing predictor is filled with can be chosen afterwards, and a fold's moments are sums over its cells. `medians` finds the exact medians of all folds together: counts
in BINS ranges add up over cells, the range that holds a wanted rank is divided again, and a range of one value is the answer. So
the number of folds changes neither the number of scans nor what is shuffled. What reaches the driver is a row of (p + 1)(2 p + 3) sums for each cell, and in
each turn at most BINS counts for each cell and wanted range; cells are a short list by design.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256


@dataclass(frozen=True)
class Statistics:
    """shift: subtracted from each predictor; sums: for each cell the products of [x, missing, target, 1], x - shift being 0 where it is missing."""

    features: list[str]
    shift: np.ndarray
    least: np.ndarray
    most: np.ndarray
    sums: dict[str, np.ndarray]

    def of(self, cells: list[str], fill: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Rows, means, cross moments about the means, those with the target, mean of the target, of the cells together with missing values filled."""
        p, total = len(self.features), sum((self.sums[c] for c in cells), np.zeros((2 * len(self.features) + 2,) * 2))
        x, m, y, one = slice(0, p), slice(p, 2 * p), 2 * p, 2 * p + 1
        n, d = total[one, one], fill - self.shift
        mean = (total[x, one] + total[m, one] * d) / n
        mixed = total[x, m] * d
        cross = (total[x, x] + mixed + mixed.T + total[m, m] * np.outer(d, d)) / n - np.outer(mean, mean)
        mean_y = float(total[y, one] / n)
        return int(round(n)), self.shift + mean, cross, (total[x, y] + total[m, y] * d) / n - mean * mean_y, mean_y

    def rows(self, cells: list[str]) -> int:
        return int(round(sum(self.sums[c][-1, -1] for c in cells)))

    def missing(self, cells: list[str]) -> np.ndarray:
        p = len(self.features)
        return np.rint(sum((self.sums[c][p : 2 * p, -1] for c in cells), np.zeros(p))).astype(np.int64)


def _matrix(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells' numbers, values (not a number where missing), and the cells' names, from (cell, predictors, ...)."""
    names = batch.column(0).dictionary_encode()
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1 : 1 + features]]) if batch.num_rows else np.zeros((0, features))
    return np.asarray(names.indices), x, names.dictionary.to_pylist()


def cell_statistics(rows: DataFrame, features: list[str], target: str, cell: Column) -> Statistics:
    """rows: the target may not be null; they are read twice, so persist them."""
    p = len(features)
    ends = rows.agg(*[f(c).cast("double").alias(f"{name}_{i}") for i, c in enumerate(features) for name, f in (("least", F.min), ("most", F.max))]).first()
    least, most = (np.array([np.nan if ends[f"{name}_{i}"] is None else ends[f"{name}_{i}"] for i in range(p)]) for name in ("least", "most"))
    shift = np.nan_to_num(least + (most - least) / 2)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            number, x, names = _matrix(batch, p)
            y = batch.column(1 + p).to_numpy(zero_copy_only=False).astype(float)
            gone = np.isnan(x)
            z = np.column_stack([np.where(gone, 0.0, x - shift), gone.astype(float), y, np.ones(len(y))])
            for k, name in enumerate(names):
                own = z[number == k]
                held[name] = held.get(name, 0.0) + own.T @ own
        upper = np.triu_indices(2 * p + 2)
        place = pa.array(np.arange(len(upper[0])), pa.int32())
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(place), pa.string()), place, pa.array(total[upper])], names=["cell", "place", "value"])

    chosen = rows.select(cell.cast("string").alias("cell"), *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"))
    found = chosen.mapInArrow(run, "cell string, place int, value double").groupBy("cell", "place").agg(F.sum("value").alias("value")).toPandas()
    sums, upper = {}, np.triu_indices(2 * p + 2)
    for name, own in found.groupby("cell"):
        total = np.zeros((2 * p + 2,) * 2)
        total[upper[0][own.place], upper[1][own.place]] = own.value
        sums[name] = total + np.triu(total, 1).T
    return Statistics(list(features), shift, least, most, sums)


def medians(rows: DataFrame, statistics: Statistics, cell: Column, folds: dict[int, list[str]]) -> dict[int, np.ndarray]:
    """The exact median of each predictor over the cells of each fold, the mean of the two middle values of an even number; 0 where all are missing.

    A wanted rank's range [low, high] becomes the least and largest value inside the part that holds it, until both are one value.
    """
    features = statistics.features
    chosen = rows.select(cell.cast("string").alias("cell"), *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(features)])
    wanted = []  # fold, feature, which middle, rank among the values inside [low, high] (from 0), low, high
    for fold, cells in folds.items():
        there = statistics.rows(cells) - statistics.missing(cells)
        wanted += [[fold, i, side, (n - 1 + side) // 2, statistics.least[i], statistics.most[i]] for i, n in enumerate(there.tolist()) if n for side in (0, 1)]
    while open_ := [w for w in wanted if w[4] < w[5]]:
        ranges = sorted({(w[1], w[4], w[5]) for w in open_})
        found = chosen.mapInArrow(lambda batches, r=ranges: _bins(batches, r, len(features)), "cell string, range int, bin int, n long, least double, most double")
        counts = found.groupBy("cell", "range", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).toPandas()
        number = {r: k for k, r in enumerate(ranges)}
        by_range = {k: own for k, own in counts.groupby("range")}
        for w in open_:
            own = by_range[number[w[1], w[4], w[5]]]
            inside = own[own.cell.isin(folds[w[0]])].groupby("bin").agg({"n": "sum", "least": "min", "most": "max"}).sort_index()
            ends = inside.n.cumsum().to_numpy()
            at = int(np.searchsorted(ends, w[3], side="right"))
            w[3], w[4], w[5] = w[3] - int(ends[at - 1] if at else 0), float(inside.least.iloc[at]), float(inside.most.iloc[at])
    out = {fold: np.zeros(len(features)) for fold in folds}
    for fold, i, _, _, value, _ in wanted:
        out[fold][i] += value / 2
    return out


def _bins(batches, ranges: list[tuple[int, float, float]], p: int):
    """Numbers, least and largest values of BINS equal parts of each range, by cell."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    for batch in batches:
        number, x, names = _matrix(batch, p)
        for k, (i, low, high) in enumerate(ranges):
            own = np.flatnonzero((x[:, i] >= low) & (x[:, i] <= high))
            if not len(own):
                continue
            value = x[own, i]
            place = number[own] * BINS + np.minimum(((value / 2 - low / 2) / (high / 2 - low / 2) * BINS).astype(np.int64), BINS - 1)
            n = np.bincount(place, minlength=len(names) * BINS)
            least, most = np.full(len(n), np.inf), np.full(len(n), -np.inf)
            np.minimum.at(least, place, value)
            np.maximum.at(most, place, value)
            for c in np.unique(number[own]).tolist():
                part = slice(c * BINS, (c + 1) * BINS)
                have = held.get((names[c], k))
                new = [n[part], least[part], most[part]]
                held[names[c], k] = new if have is None else [have[0] + new[0], np.minimum(have[1], new[1]), np.maximum(have[2], new[2])]
    for (name, k), (n, least, most) in held.items():
        bins = np.flatnonzero(n)
        columns = [pa.array([name] * len(bins), pa.string()), pa.array([k] * len(bins), pa.int32()), pa.array(bins, pa.int32()), pa.array(n[bins], pa.int64()), pa.array(least[bins]), pa.array(most[bins])]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "range", "bin", "n", "least", "most"])
