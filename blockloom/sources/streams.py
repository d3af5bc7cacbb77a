"""Sector containers written as rows of pieces, in two phases: first every sector's stored size, from which parts, places and
names follow, then the bytes. No part is ever put together, so parts and sources may be larger than a task's memory."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.functions.patches import bytes_le
from blockloom.operators.blocks import quotient
from blockloom.operators.layout import greedy_split, part_name, prefix_offset
from blockloom.sources import formats as X


def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [X.cci_slot(s.as_py()) for s in batch.column("data")]
        yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("sector_no"), pa.array([s for s, _ in made], pa.binary()), pa.array([c for _, c in made], pa.bool_()), pa.array([len(s) for s, _ in made], pa.int64())], ["source_id", "sector_no", "slot", "compressed", "size"])


def words_le(words: Column) -> Column:
    """Aggregate result: an array of 32-bit numbers as bytes, the least first."""
    return F.unhex(F.array_join(F.transform(words, lambda w: F.hex(bytes_le(w))), ""))


def cci_pieces(sectors: DataFrame, cap: int = X.CCI_CAP) -> DataFrame:
    """(source_id, name, piece_no, data) from (source_id, sector_no, data): each part's header, its slots and its index. Joined
    in the order of piece_no they are the parts that the whole-image writer makes. Every source has one sector at least."""
    packed = sectors.select("source_id", "sector_no", "data").mapInArrow(slots, "source_id string, sector_no long, slot binary, compressed boolean, size long")
    placed = greedy_split(packed, "source_id", ["sector_no"], "size", cap - 32)
    at = prefix_offset(F.col("size"), ["source_id", "part_no"], ["sector_no"]) + 32
    placed = placed.withColumn("at", at)
    word = F.shiftright("at", 2).bitwiseOR(F.when(F.col("compressed"), F.lit(1 << 31)).otherwise(F.lit(0)).cast("long"))
    index = F.transform(F.array_sort(F.collect_list(F.struct("sector_no", word.alias("w")))), lambda x: x["w"])
    parts = placed.groupBy("source_id", "part_no").agg(F.count(F.lit(1)).alias("n"), F.max("sector_no").alias("last"), F.sum("size").alias("bytes"), index.alias("index"))
    total = F.count(F.lit(1)).over(W.partitionBy("source_id"))
    parts = parts.withColumn("name", part_name(F.col("source_id"), F.col("part_no"), total, "cci"))
    long_le = lambda x: F.concat(bytes_le(x), F.lit(bytes(4)))  # noqa: E731  # parts are below 4 GB of stored bytes
    wide_le = lambda x: F.concat(bytes_le(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), bytes_le(F.shiftrightunsigned(x, 32)))
    end = F.col("bytes") + 32
    head = F.concat(F.lit(b"CCIM" + struct.pack("<I", 32)), wide_le(F.col("n") * X.SECTOR), long_le(end), F.lit(struct.pack("<IBBH", X.SECTOR, 1, 2, 0)))
    tail = words_le(F.concat("index", F.array(quotient(end, 4))))
    around = parts.select("source_id", "name", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("piece_no"), head.alias("data")), F.struct((F.col("last") + 1).alias("piece_no"), tail.alias("data")))).alias("x")).select("source_id", "name", "x.*")
    return around.unionByName(placed.join(parts.select("source_id", "part_no", "name"), ["source_id", "part_no"]).select("source_id", "name", F.col("sector_no").alias("piece_no"), F.col("slot").alias("data")))
