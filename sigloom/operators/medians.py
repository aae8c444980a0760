"""Exact medians of many groups without holding the values of a group in one task.

The values of a group are counted in the cells of a histogram, which merges across tasks. The
cells that hold the two middle places are kept, and cut again, until they hold few values; only
those are brought together. Counts, and so the places, are exact in every round.

`medians` takes one value per row, `vector_medians` the vectors of a database, which are counted
in Arrow batches: values of all genes are not made into rows.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.plans.shared import stored

# Values of a group that are brought together, at most.
BUFFER = 10_000
# Cells of a histogram.
CELLS = 256
# Groups whose bounds are broadcast (some 80 bytes each); those of more groups are joined.
BROADCAST_GROUPS = 200_000

# Values of vectors that are counted together, at most.
CHUNK = 4_000_000
# Bits of a value that a round fixes; a cell so has 65,536 parts at most.
DIGIT = 16

# log2 of the smallest double is -1074, and of none above 1024. With this added, the
# logarithm is above 0 for all, so that a sign can be put to it.
SHIFT, FAR = 1100.0, 2200.0


def _scale(x: Column) -> Column:
    """A logarithmic scale of both signs, rising with x; infinities have a place on it."""
    size = F.least(F.log2(F.abs(x)) + F.lit(SHIFT), F.lit(FAR))
    return F.when(x == 0.0, F.lit(0.0)).otherwise(F.signum(x) * size)


def _cell(x: Column, low: Column, high: Column, logarithmic: Column) -> Column:
    """The cell of x between low and high: rising with x; NaN is above all."""

    def at(y: Column) -> Column:
        # Halves, since the distance of two large numbers may be infinite.
        return F.when(logarithmic, _scale(y)).otherwise(y / 2.0)

    part = F.try_divide(at(x) - at(low), at(high) - at(low))
    cell = F.least(F.floor(part * F.lit(float(CELLS))), F.lit(CELLS - 1))
    return F.when(F.isnan(x), F.lit(CELLS)).otherwise(F.coalesce(cell, F.lit(0))).cast("int")


def medians(values: DataFrame, keys: list[str], column: str, buffer: int | None = None) -> DataFrame:
    """(keys, median) of a column of doubles; of an even number of values the middle of two.

    Nulls do not count, NaN is larger than all, and a group without values has no row. At most
    `buffer` values of a group come together, and CELLS counts of it for each task.
    """
    buffer = BUFFER if buffer is None else buffer
    x = F.col("_x")
    named = values.select(*keys, F.col(column).cast("double").alias("_x")).filter(x.isNotNull())
    number = F.when(~F.isnan(x), x)
    finite = (number > float("-inf")) & (number < float("inf"))
    groups = named.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("*").alias("inside"),
        F.lit(0).cast("long").alias("below"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        # With infinities, distances on the plain scale are infinite.
        (F.count(number) > F.count(F.when(finite, 1))).alias("logarithmic"),
    )
    open_, done = stored(groups, "medians"), []
    while open_.head(1):
        counted = _bounded(named, open_, keys).withColumn(
            "cell", _cell(x, F.col("low"), F.col("high"), F.col("logarithmic"))
        )
        cells = counted.groupBy(*keys, "cell", "n", "inside", "below", "logarithmic").agg(
            F.count("*").alias("count"), F.min("_x").alias("first"), F.max("_x").alias("last")
        )
        before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("below") + F.coalesce(F.sum("count").over(before), F.lit(0))
        lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        holds = [(F.col("start") <= k) & (k < F.col("start") + F.col("count")) for k in (lower, upper)]
        middle = (
            cells.withColumn("start", start)
            .filter(holds[0] | holds[1])
            .groupBy(*keys, "n", "inside", "logarithmic")
            .agg(
                F.count("*").alias("parts"),
                F.max("count").alias("count"),
                F.min("start").alias("start"),
                F.min("first").alias("low"),
                F.max("last").alias("high"),
                # Of two cells, the last value of the lower and the first of the upper one.
                (F.min("last") * 0.5 + F.max("first") * 0.5).alias("between"),
            )
        )
        one_value = F.col("low") == F.col("high")
        median = F.when(F.col("parts") == 2, F.col("between")).when(one_value, F.col("low"))
        state = stored(middle.withColumn("median", median), "medians")
        done.append(state.filter("median IS NOT NULL").select(*keys, "median"))
        rest = state.filter("median IS NULL").select(
            *keys,
            "n",
            F.col("count").alias("inside"),
            F.col("start").alias("below"),
            "low",
            "high",
            # A cell that still holds much of its group is cut on the other scale.
            ((F.col("count") * 4 > F.col("inside")) & ~F.col("logarithmic")).alias("logarithmic"),
        )
        few = rest.filter(F.col("inside") <= buffer)
        gathered = (
            _bounded(named, few, keys)
            .groupBy(*keys, "n", "below")
            .agg(F.array_sort(F.collect_list("_x")).alias("own"))
            .select(
                *keys,
                sum(
                    F.get("own", (k - F.col("below")).cast("int")) * 0.5 for k in (lower, upper)
                ).alias("median"),
            )
        )
        done.append(gathered)
        open_ = rest.filter(F.col("inside") > buffer)
    if not done:
        return groups.select(*keys, F.lit(None).cast("double").alias("median"))
    return reduce(DataFrame.unionByName, done)


def _bounded(named: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The values of the groups that lie between their bounds; NaN lies above all numbers."""
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    x, low, high = F.col("_x"), F.col("low"), F.col("high")
    return named.join(groups, keys).filter(
        ((x >= low) & (x <= high)) | (F.isnan(x) & (F.col("inside") == F.col("n")))
    )


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that rise with the doubles; NaN is above all, and -0.0 is 0.0."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    """The double that `_ordered` turns into key."""
    bits = key ^ (1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.uint64(bits).view(np.float64))


def _counter(length: int, done: int, bits: int, prefixes: np.ndarray, wanted: np.ndarray):
    """Counts by the next `bits` bits of the values that lie in wanted cells.

    A group is a place of a column of vectors. It has two cells at most (of the lower and of the
    upper middle value): the values whose first `done` bits are the prefix of the cell.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, column in enumerate(batch.columns):
                offsets = column.offsets.to_numpy().astype(np.int64)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                sizes = np.where(there, np.minimum(np.diff(offsets), length), 0)
                known = column.values.is_valid().to_numpy(zero_copy_only=False)
                flat = column.values.to_numpy(zero_copy_only=False)
                rows = max(1, CHUNK // max(length, 1))
                for at in range(0, len(sizes), rows):
                    n = sizes[at : at + rows]
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = np.repeat(offsets[:-1][at : at + rows], n) + place
                    place, own = place[known[own]], own[known[own]]
                    yield from _counts(number * length + place, _ordered(flat[own]))

    def _counts(group: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        for slot in (0, 1):
            inside = wanted[group, slot]
            if done:
                inside &= key >> np.uint64(64 - done) == prefixes[group, slot]
            if not inside.any():
                continue
            digit = (key[inside] >> np.uint64(64 - done - bits)) & np.uint64((1 << bits) - 1)
            cell = (group[inside] * 2 + slot) << bits | digit.astype(np.int64)
            found, n = np.unique(cell, return_counts=True)
            columns = [found >> bits, found & ((1 << bits) - 1), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["cell", "digit", "n"]
            )

    return counted


def vector_medians(vectors: DataFrame, length: int, buffer: int | None = None) -> DataFrame:
    """(index, one median for each column) of columns that hold vectors of doubles, by place from 1.

    As `medians`; entries beyond `length` do not count, and a place has a row if it has a value.
    Each round fixes the next bits of the middle values, in an order of doubles as integers, and
    the last one the rest, once no cell has more than `buffer` values. The driver holds four
    numbers for each place of a column.
    """
    buffer = BUFFER if buffer is None else buffer
    names = vectors.columns
    groups = len(names) * length
    prefixes, wanted = np.zeros((groups, 2), np.uint64), np.zeros((groups, 2), bool)
    wanted[:, 0] = True
    # For the lower and the upper middle of a group: prefix and place among the values with it.
    middles: dict[tuple[int, int], tuple[int, int]] = {}
    done, inside = 0, buffer + 1
    while done < 64 and (not done or middles):
        bits = min(DIGIT, 64 - done)
        if inside <= buffer and (2 * groups).bit_length() + 64 - done < 63:
            bits = 64 - done
        counter = _counter(length, done, bits, prefixes, wanted)
        counts = vectors.mapInArrow(counter, "cell long, digit long, n long")
        cells = Window.partitionBy("cell")
        before = cells.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.groupBy("cell", "digit").agg(F.sum("n").alias("n")).select(
            "cell",
            "digit",
            "n",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
            F.sum("n").over(cells).alias("total"),
        )
        if done:
            # Group, which middle, the cell it lies in, and its place there.
            rows = [(g * 2 + _slot(prefixes, g, own), k, at) for (g, k), (own, at) in middles.items()]
            places = vectors.sparkSession.createDataFrame(
                pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["cell", "which", "place"])
            )
            joined = placed.join(F.broadcast(places), "cell")
        else:
            both = F.array(*[
                F.struct(F.lit(k).alias("which"), F.floor((F.col("total") - 1 + k) / 2).alias("place"))
                for k in (0, 1)
            ])
            joined = placed.select("*", F.inline(both))
        at = F.col("place") - F.col("start")
        found = joined.filter((at >= 0) & (at < F.col("n"))).withColumn("at", at).collect()
        middles = {
            (r.cell // 2, r.which): (int(prefixes[r.cell // 2, r.cell % 2]) << bits | r.digit, r.at)
            for r in found
        }
        inside = max((r.n for r in found), default=0)
        done += bits
        prefixes, wanted = np.zeros((groups, 2), np.uint64), np.zeros((groups, 2), bool)
        for (g, k), (own, _) in sorted(middles.items()):
            slot = 1 if wanted[g, 0] and int(prefixes[g, 0]) != own else 0
            prefixes[g, slot], wanted[g, slot] = own, True
    halves = {key: _double(own) * 0.5 for key, (own, _) in middles.items()}
    index = sorted({g % length + 1 for g, _ in middles})
    columns = [pa.array(index, pa.int32())]
    for number in range(len(names)):
        keys = [number * length + i - 1 for i in index]
        own = [halves[g, 0] + halves[g, 1] if (g, 0) in halves else None for g in keys]
        columns.append(pa.array(own, pa.float64()))
    return vectors.sparkSession.createDataFrame(pa.table(columns, names=["index", *names]))


def _slot(prefixes: np.ndarray, group: int, own: int) -> int:
    """Which of the cells of a group has this prefix."""
    return 0 if int(prefixes[group, 0]) == own else 1
