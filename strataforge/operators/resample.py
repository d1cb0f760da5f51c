"""Bootstraps whose replicates never meet the entities in a shuffle.

Each of R replicates draws as many entities as there are, with replacement. The entities lie in ranges of their keys; how many
of a replicate's draws fall into each range is one multinomial draw, the same in every task because its seed is the replicate's, and
a range's task then draws among its own entities only. What is shuffled are sums by replicate and period, a row for each range. Draws come from a 64-bit mixing
function of seed, replicate, range and slot, so they don't depend on the engine; up to RANGE entities lie in one range, and
plain SQL can repeat them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut

#: Entities of a range, about.
RANGE = 1 << 16
SLOTS = 1 << 18
#: Odd factors of seed, replicate, range and slot, and those of the mixing function.
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7)
MIXERS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def draw(seed: int, replicate: int, part: int, slots: np.ndarray, n: int) -> np.ndarray:
    """Numbers from 0 to n - 1 for these slots."""
    with np.errstate(over="ignore"):
        z = slots.astype(np.uint64) * np.uint64(FACTORS[3]) + np.uint64((seed * FACTORS[0] + replicate * FACTORS[1] + part * FACTORS[2]) % (1 << 64))
        for shift, factor in MIXERS:
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def shares(seed: int, replicate: int, sizes: np.ndarray) -> np.ndarray:
    """How many of a replicate's draws fall into each range; all of them into an only one."""
    total = int(sizes.sum())
    return sizes if len(sizes) == 1 else np.random.Generator(np.random.Philox(key=[seed, replicate])).multinomial(total, sizes / total)


def drawn_sums(cells: DataFrame, replicates: int, seed: int, first: int = 0, most: int = RANGE) -> DataFrame:
    """(replicate, target_period, total, rows): sums of (entity_key, target_period, total, rows) over the drawn entities, replicates numbered from `first`.

    A task holds the cells of its range, about `most` entities. Sizes of the ranges are collected.
    """
    entities = cells.select("entity_key").distinct().count()
    ranges = -(-entities // most)
    dealt = cells.repartition(1) if ranges <= 1 else cells.repartitionByRange(ranges, "entity_key")
    placed = dealt.sortWithinPartitions("entity_key").withColumn("part", F.spark_partition_id())
    if ranges > 1:
        placed = cut(placed)
        found = {r.part: r.n for r in placed.groupBy("part").agg(F.countDistinct("entity_key").alias("n")).collect()}
        sizes = np.array([found.get(k, 0) for k in range(max(found) + 1)], np.int64)
    else:
        sizes = np.array([entities], np.int64)

    def run(batches):
        keys, periods, values = [], [], []
        part = None
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0))
                periods.append(batch.column(1).to_numpy(zero_copy_only=False))
                values.append(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3)]))
                part = batch.column(4)[0].as_py()
        if part is None:
            return
        number = np.asarray(pa.chunked_array(keys).combine_chunks().dictionary_encode().indices)  # keys are sorted, so numbers are places
        period, place = np.unique(np.concatenate(periods), return_inverse=True)
        n = int(number[-1]) + 1
        table = np.zeros((n, len(period), 2))
        np.add.at(table, (number, place), np.concatenate(values))
        table = table.reshape(n, -1)
        out = []
        for replicate in range(first, first + replicates):
            wanted = int(shares(seed, replicate, sizes)[part])
            times = np.zeros(n)
            for start in range(0, wanted, SLOTS):
                times += np.bincount(draw(seed, replicate, part, np.arange(start, min(wanted, start + SLOTS)), n), minlength=n)
            out.append((times @ table).reshape(-1, 2))
        sums = np.concatenate(out)
        columns = [pa.array(np.repeat(np.arange(first, first + replicates, dtype=np.int32), len(period))), pa.array(np.tile(period, replicates), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, names=["replicate", "target_period", "total", "rows"])

    return placed.select("entity_key", F.col("target_period").cast("int"), "total", "rows", "part").mapInArrow(run, "replicate int, target_period int, total double, rows double")


def replicate_means(differences: DataFrame, replicates: int, seed: int, value: str = "difference", first: int = 0) -> DataFrame:
    """(replicate, balanced, periods): the mean over periods of the drawn rows' means; periods says how many it holds."""
    cells = differences.groupBy("entity_key", "target_period").agg(F.sum(value).alias("total"), F.count(value).alias("rows"))
    by_period = drawn_sums(cells, replicates, seed, first).groupBy("replicate", "target_period").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    means = by_period.where(F.col("rows") > 0).select("replicate", (F.col("total") / F.col("rows")).alias("mean"))
    return means.groupBy("replicate").agg(F.avg("mean").alias("balanced"), F.count("*").alias("periods"))


def interval(means: DataFrame, *more: Column, percent: float = 95.0) -> DataFrame:
    tail = (100 - percent) / 200
    p = F.percentile("balanced", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    return means.agg(F.count("*").alias("retained"), *more, p[0].alias("lower"), p[1].alias("median"), p[2].alias("upper"))


def clustered_skip(differences: DataFrame, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Replicates that miss a period are left out and counted."""
    means = replicate_means(differences, replicates, seed)
    wanted = differences.agg(F.countDistinct("target_period").alias("wanted"))
    kept = means.join(F.broadcast(wanted)).where(F.col("periods") == F.col("wanted"))
    return interval(kept).withColumn("skipped", F.lit(replicates) - F.col("retained"))


def clustered_drop(differences: DataFrame, replicates: int = 200, seed: int = 7) -> DataFrame:
    """A period that a replicate misses drops out of that replicate's mean."""
    return interval(replicate_means(differences, replicates, seed))


def clustered_redraw(differences: DataFrame, replicates: int = 200, seed: int = 7, spare: int = 2, most: int = 100) -> DataFrame:
    """Replicates that miss a period are drawn again: the first `replicates` complete ones.

    Attempts are drawn in blocks of spare times as many; with fewer complete ones in `most` times as many, `retained` says so and there is no interval.
    """
    wanted = differences.agg(F.countDistinct("target_period").alias("wanted"))
    kept, complete, first = None, 0, 0
    while first < most * replicates and complete < replicates:
        size = min(spare * replicates, most * replicates - first)
        means = replicate_means(differences, size, seed, first=first)
        block = cut(means.join(F.broadcast(wanted)).where(F.col("periods") == F.col("wanted")).select("replicate", "balanced"))
        kept, complete, first = block if kept is None else kept.union(block), complete + block.count(), first + size
        if first == size and not differences.take(1):
            break  # nothing to draw from
    kept = kept.withColumn("place", F.row_number().over(Window.orderBy("replicate"))).where(F.col("place") <= replicates)
    found = interval(kept, (F.max("replicate") + 1).cast("long").alias("attempts"))
    enough = F.col("retained") == replicates
    return found.withColumns({c: F.when(enough, F.col(c)) for c in ("lower", "median", "upper")})


def paired_mean(differences: DataFrame, replicates: int = 200, seed: int = 7) -> DataFrame:
    """The plain mean over drawn entities, each with the mean of its own differences."""
    own = differences.groupBy("entity_key").agg(F.lit(0).alias("target_period"), F.avg("difference").alias("total"), F.lit(1).alias("rows"))
    drawn = drawn_sums(own.where(F.col("total").isNotNull()), replicates, seed).groupBy("replicate").agg((F.sum("total") / F.sum("rows")).alias("balanced"))
    return interval(drawn)
