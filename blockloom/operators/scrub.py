"""Which sectors of a volume its directory tree uses, and what trimming and zeroing make of the rest.

Used sectors are kept as ranges, one for each entry or table, and merged: nothing is listed sector by sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SECTOR, DESCRIPTOR = 2048, 32


def used_ranges(entries: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, first, last): merged ranges of sectors, counted from the volume's root, that the descriptor, the root table and
    entries take. entries has (image_id, sector, size), images (image_id, root_sector, root_size)."""
    table = images.select("image_id", F.col("root_sector").alias("sector"), F.col("root_size").alias("size"))
    descriptor = images.select("image_id", F.lit(DESCRIPTOR).cast("long").alias("sector"), F.lit(SECTOR).cast("long").alias("size"))
    every = entries.select("image_id", F.col("sector").cast("long").alias("sector"), F.col("size").cast("long").alias("size")).unionByName(table.selectExpr("image_id", "CAST(sector AS BIGINT) AS sector", "CAST(size AS BIGINT) AS size")).unionByName(descriptor)
    taken = every.where("size > 0").select("image_id", F.col("sector").alias("first"), (F.col("sector") + F.expr(f"(size - 1) div {SECTOR}")).alias("last"))
    order = W.partitionBy("image_id").orderBy("first", "last")
    so_far = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = (so_far.isNull() | (F.col("first") > so_far + 1)).cast("int")
    grouped = taken.withColumn("begins", begins).withColumn("part", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy("image_id", "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("part")


def platform(path: Column, attributes: Column, order: Column) -> Column:
    """Aggregate: x360 or ogx by the first file, in the order given, that is named like a launch executable."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    launch = (attributes.bitwiseAND(F.lit(0x10)) == 0) & name.rlike(r"default\.(xex|xbe)")
    first = F.min(F.when(launch, F.struct(order.alias("o"), F.when(name.contains(".xex"), "x360").otherwise("ogx").alias("kind"))))
    return first["kind"]


def scrub_plan(entries: DataFrame, images: DataFrame, mode: str) -> DataFrame:
    """For each image its platform, sectors that stay (total_sectors), used ones (used_sectors) and those that become zeros
    (zero_sectors, null where the interior is left alone), or a reason. mode is trim (cut behind the last used byte,
    nothing zeroed), zero (keep the size) or partial (both). Only ogx images have interior sectors zeroed.
    images also has root_offset and file_size, entries path and attributes; entries count in the order of position."""
    found = entries.groupBy("image_id").agg(platform(F.col("path"), F.col("attributes"), F.col("position")).alias("platform"), F.max(F.col("sector").cast("long") * SECTOR + F.col("size")).alias("end"))
    used = used_ranges(entries, images).groupBy("image_id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("used_sectors"), F.max("last").alias("last_used"))
    all_ = images.join(found, "image_id", "left").join(used, "image_id", "left")
    up = lambda x: F.expr(f"({x} + {SECTOR - 1}) div {SECTOR}")
    all_ = all_.withColumn("extent", F.greatest(F.coalesce("end", F.lit(0).cast("long")), F.col("root_sector") * SECTOR + F.col("root_size")))
    all_ = all_.withColumn("full", up("greatest(file_size - root_offset, 0)"))
    reason = F.when(F.col("last_used") >= F.col("full"), "a used sector lies behind the image's end").when(F.col("platform").isNull(), "no launch executable")
    total = F.col("full") if mode == "zero" else up("extent")
    zeroed = F.when((F.col("platform") == "ogx") & F.lit(mode != "trim"), F.greatest(total, F.col("last_used") + 1) - F.col("used_sectors"))
    out = all_.withColumn("reason", reason)
    sound = F.col("reason").isNull()
    return out.select("image_id", "platform", F.when(sound, total).alias("total_sectors"), F.when(sound, F.col("used_sectors")).alias("used_sectors"), F.when(sound, zeroed).alias("zero_sectors"), "reason")
