"""Trees kept as parent pointers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.operators.layout import global_offset


def build_paths(nodes: DataFrame, max_depth: int) -> DataFrame:
    """nodes (id, parent, name), roots with null parent -> id, path, reason.

    Each step joins a row's known ancestor with that ancestor's own, so a tree of depth d takes log2(d) joins, not d.
    A parent that doesn't exist, a cycle, or more than max_depth levels gives a null path and a reason."""
    at = nodes.select("id", F.col("parent").alias("up"), F.col("name").alias("path"), F.lit(False).alias("lost"))
    for _ in range(max(1, math.ceil(math.log2(max_depth)))):
        above = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("lost").alias("_lost"))
        joined = at.join(above, F.col("up") == F.col("_id"), "left")
        missing = F.col("up").isNotNull() & F.col("_id").isNull()
        at = joined.select(
            "id", F.when(F.col("up").isNotNull() & ~missing, F.col("_up")).alias("up"),
            F.when(F.col("_id").isNotNull(), F.concat("_path", F.lit("/"), "path")).otherwise(F.col("path")).alias("path"), (F.col("lost") | missing | F.coalesce("_lost", F.lit(False))).alias("lost"))
    reason = F.when(F.col("lost"), "parent missing").when(F.col("up").isNotNull(), "cycle or too deep")
    return at.select("id", F.when(reason.isNull(), F.col("path")).alias("path"), reason.alias("reason"))


def number_level(parents: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Breadth-first numbers of one level: parents (id, number) in order, each one's children sorted by lower-case name.
    A parent's children begin where those of the parents before it end; no window spans the level."""
    counts = parents.join(children.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    starts = global_offset(counts, "number", "n", "start").select(F.col("id").alias("parent"), "start")
    place = F.row_number().over(W.partitionBy("parent").orderBy(F.lower(name), "id"))
    return children.withColumn("place", place).join(starts, "parent").withColumn("number", F.col("start") + F.col("place") - 1).drop("place", "start")
