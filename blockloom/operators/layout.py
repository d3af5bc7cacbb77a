"""Offsets: prefix sums, part splitting, ranges and gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from blockloom.operators.blocks import quotient


def prefix_offset(value: Column, by: list[str], order: list[str]) -> Column:
    """Exclusive running sum within by."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _starts(sums: DataFrame, width: int, levels: int) -> DataFrame:
    """(_stretch, _start) from (_stretch, _sum): stretches are dealt in longer ones, and those again."""
    before = lambda w: F.coalesce(F.sum("_sum").over(w.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not levels:
        return sums.select("_stretch", before(W.partitionBy()).alias("_start"))
    cut = sums.withColumn("_above", F.expr(f"_stretch div {width}"))
    above = _starts(cut.groupBy(F.col("_above").alias("_stretch")).agg(F.sum("_sum").alias("_sum")), width, levels - 1)
    inside = cut.select("_stretch", "_above", before(W.partitionBy("_above")).alias("_inside"))
    return inside.join(above.select(F.col("_stretch").alias("_above"), "_start"), "_above").select("_stretch", (F.col("_start") + F.col("_inside")).alias("_start"))


def global_offset(df: DataFrame, key: str, value: str, out: str, width: int = 4096, levels: int = 3) -> DataFrame:
    """Exclusive running sum over the whole table in the order of a unique whole-number key, without a window over all
    rows: keys are dealt in stretches of width, these in stretches of width stretches, and so on for so many levels. A
    window holds at most width rows, and the last one those of the key's range over width to the power levels + 1: with
    the defaults one row for keys below 2^48, 65,536 for any, however sparse they are."""
    cut = df.withColumn("_stretch", F.expr(f"{key} div {width}"))
    starts = _starts(cut.groupBy("_stretch").agg(F.sum(value).alias("_sum")), width, levels)
    within = F.coalesce(F.sum(value).over(W.partitionBy("_stretch").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_within", within).join(starts, "_stretch").withColumn(out, (F.col("_start") + F.col("_within")).cast("long")).drop("_stretch", "_within", "_start")


def resets(value: Column, by: list[str], order: list[str]) -> Column:
    """Part number from 0: a part begins wherever the value is below the one before it."""
    w = W.partitionBy(*by).orderBy(*order)
    return F.sum((value < F.lag(value).over(w)).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))


def part_name(stem: Column, number: Column, total: Column, ext: str) -> Column:
    """stem.ext for a single part, stem.N.ext (from 1) for several."""
    return F.when(total == 1, F.concat(stem, F.lit(f".{ext}"))).otherwise(F.concat(stem, F.lit("."), (number + 1).cast("string"), F.lit(f".{ext}")))


def greedy_split(df: DataFrame, by: str, order: list[str], size: str, cap: int, at_cap: bool = False, out: str = "part_no") -> DataFrame:
    """Each item's part number within its stream: a part is closed once its length is above cap (or at it, if at_cap),
    so its last item may reach past. Streams are read in order from sorted batches with only the open part's length
    kept, so they may be of any length; one stream is read by one task. Sizes that are null count as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, used, part, begun = None, 0, 0, False
        for batch in batches:
            keys, sizes = batch.column(by).to_pylist(), batch.column(size).fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            parts = np.empty(len(keys), dtype=np.int32)
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if not begun or keys[lo] != stream:
                    stream, used, part, begun = keys[lo], 0, 0, True
                ends = np.cumsum(sizes[lo:hi], dtype=np.int64)
                at, base = 0, 0
                while at < len(ends):
                    if used > cap or (at_cap and used == cap):
                        used, part = 0, part + 1
                    # the first item after which the part is closed
                    last = int(np.searchsorted(ends, cap - used + base, side="left" if at_cap else "right"))
                    last = min(max(last, at), len(ends) - 1)
                    parts[lo + at : lo + last + 1] = part
                    used += int(ends[last]) - base
                    at, base = last + 1, int(ends[last])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts)], [*batch.schema.names, out])

    fields = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, fields)


def locate(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Range join start <= point < end as an equality join: ranges are listed under each stretch of width they touch.
    Choose width near the usual length of a range; empty ranges match nothing."""
    listed = ranges.where(F.col(end) > F.col(start)).withColumn("_at", F.explode(F.sequence(quotient(F.col(start), width), quotient(F.col(end) - 1, width))))
    hit = points.withColumn("_at", quotient(F.col(point), width)).join(listed, "_at")
    return hit.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_at")


def islands(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions: by, first, last, length."""
    run = F.col(position) - F.row_number().over(W.partitionBy(*by).orderBy(position))
    return df.withColumn("_run", run).groupBy(*by, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def god_position(sector: Column) -> dict[str, Column]:
    """Where a hash-tree container keeps a 2048-byte sector: blocks of 4096, 204 data blocks to a subpart with a hash block
    before them, 203 subparts to a part with a master block before them."""
    block = quotient(sector, 2)
    in_part = block % (203 * 204)
    physical = in_part + quotient(in_part, 204) + 2
    return {"part_no": quotient(block, 203 * 204), "position": physical * 4096 + (sector % 2) * 2048}


def stfs_backing_block(block: Column, shift: int) -> Column:
    """Backing block of a logical block in a package whose hash tables take 1 << shift blocks: one table for every 170
    blocks, and one for every 170 * 170 of those once there are as many."""
    first = quotient(block + 170, 170) * (1 << shift) + block
    second = first + quotient(block + 28900, 28900) * (1 << shift)
    return F.when(block < 170, first).when(block < 28900, second).otherwise(second + (1 << shift))


def stfs_hash_block(block: Column, level: int, shift: int) -> Column:
    """Backing block of the hash table of this level, from 0 to 2, that a logical block comes under."""
    wide = 1 << shift
    group, span = 170 + wide, 28900 + 171 * wide  # backing blocks from one table of a level to the next
    if level == 0:
        later = quotient(block, 170) * group + (quotient(block, 28900) + 1) * wide + F.when(block >= 28900, wide).otherwise(0)
        return F.when(block < 170, F.lit(0).cast("long")).otherwise(later)
    if level == 1:
        return F.when(block < 28900, F.lit(group).cast("long")).otherwise(wide + quotient(block, 28900) * span)
    return F.lit(span).cast("long")


def stfs_walk(blocks: DataFrame, block: str, total: int) -> DataFrame:
    """(kind, block, address) of all that a read-only package of so many blocks holds: its data blocks, and with the first
    block of each group the group's hash table; tables of levels 1 and 2 are there from 171 and 28,901 blocks on."""
    b, address = F.col(block), lambda level: stfs_hash_block(F.col(block), level, 0)
    made = [F.struct(F.lit("data").alias("kind"), stfs_backing_block(b, 0).alias("address")), F.when(b % 170 == 0, F.struct(F.lit("level 0").alias("kind"), address(0).alias("address")))]
    if total > 170:
        made.append(F.when(b % 28900 == 0, F.struct(F.lit("level 1").alias("kind"), address(1).alias("address"))))
    if total > 28900:
        made.append(F.when(b == 0, F.struct(F.lit("level 2").alias("kind"), address(2).alias("address"))))
    return blocks.select(b.alias("block"), F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.kind", "block", "x.address")
