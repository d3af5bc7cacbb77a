"""Sharding by balanced label propagation, in DataFrame operations alone.

Linked documents are those of equal text. A document starts in the shard its id's hash names. Those of one text and
one start (split further by hash, so that no cell of a very common text is large) are a cell, which moves as one. In
each turn every text's documents look at the shards their like are in and move towards the one that holds most of them
and still has room; where more want to come than the quota allows, a share picked by hash comes. What stays apart is
the cut. At last every document gets a gapless number within its shard, linked ones first, and the documents beyond a
shard's exact quota fill the places left in others: law `rows`, shard sizes differ by one row at most.

A document whose text is null, empty or unique has no links and goes where there is room. Rows that repeat an id are
so many documents. With fewer rows than shards some shards stay empty; an empty table gives an empty result. Only
doc_id and text are read, so other columns can't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.llm.common import Scratch, number_rows, table

SHARDS, TURNS, PARTS, SEED = 16, 4, 16, 5


def propagate(scratch: Scratch, cells: DataFrame, capacity: int, shards: int, turns: int) -> DataFrame:
    """cells (text_key, start, n) -> (text_key, start, shard): where each cell ends."""
    cells = scratch.write(cells.withColumn("shard", F.col("start") % shards), "cells")
    for turn in range(turns):
        held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        room = [capacity - held.get(s, 0) for s in range(shards)]
        rooms = F.array(*[F.lit(x) for x in room])
        at = F.element_at(rooms, F.col("shard") + 1)
        neighbours = cells.groupBy("text_key", "shard").agg(F.sum("n").alias("near"))
        # a shard without room attracts no one; ties go to a shard picked by hash, so that they spread
        pull = F.struct((at > 0).cast("int"), "near", F.xxhash64("text_key", "shard"), "shard")
        best = neighbours.groupBy("text_key").agg(F.max(pull).alias("best")).select("text_key", F.col("best.shard").alias("to"), F.col("best.near").alias("there"), (F.col("best.col1") > 0).alias("open"))
        here = W.partitionBy("text_key", "shard")
        wish = cells.withColumn("near", F.sum("n").over(here)).join(best, "text_key").withColumn("moves", F.col("open") & (F.col("to") != F.col("shard")) & ((F.col("there") >= F.col("near")) | (F.element_at(rooms, F.col("shard") + 1) < 0)))
        wish = scratch.write(wish, "wishes")
        asked = {r["to"]: r["n"] for r in wish.where("moves").groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        share = F.element_at(F.array(*[F.lit(min(1.0, max(0, room[s]) / asked[s]) if asked.get(s) else 0.0) for s in range(shards)]), F.col("to") + 1)
        chance = F.pmod(F.xxhash64("text_key", "to", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        whole = F.col("there") * F.lit(PARTS) < F.lit(capacity)  # a common text's cells come one by one, others all together
        chance = F.when(whole, chance).otherwise(F.pmod(F.xxhash64("text_key", "start", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
        moved = wish.select("text_key", "start", "n", F.when(F.col("moves") & (chance < share), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        before, cells = cells, scratch.write(moved, "cells")
        scratch.drop(before)
        scratch.drop(wish)
    return cells


def shard(docs: DataFrame, shards: int = SHARDS, turns: int = TURNS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shard")
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.pmod(F.xxhash64(F.col(doc_id), F.lit(SEED)), F.lit(shards * PARTS)).cast("int")
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.when(F.length(body) > 0, F.unhex(F.substring(F.sha2(body, 256), 1, 32))).alias("text_key"), start.alias("start"))
    narrow = scratch.write(narrow, "narrow")
    n = narrow.count()
    capacity = -(-n // shards)
    cells = narrow.where("text_key IS NOT NULL").groupBy("text_key", "start").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("all", F.sum("n").over(W.partitionBy("text_key"))).where("all > 1").drop("all")
    placed = propagate(scratch, cells, capacity, shards, turns)
    labelled = narrow.join(placed.select("text_key", "start", F.col("shard").alias("to")), ["text_key", "start"], "left")
    labelled = labelled.select("doc_id", "size", "text_crc32", F.coalesce("to", F.col("start") % shards).alias("first"), F.col("to").isNull().cast("int").alias("alone"), F.xxhash64("text_key").alias("like"), F.xxhash64("doc_id", "text_crc32").alias("mixed"))
    numbered = scratch.write(number_rows(scratch, labelled, ["first", "alone", "like", "mixed", "doc_id"], "place"), "numbered")
    counts = {r["first"]: r["n"] for r in numbered.groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    have = [counts.get(s, 0) for s in range(shards)]
    # the shards that hold most keep the odd rows, so that fewest move
    odd = set(sorted(range(shards), key=lambda s: (-have[s], s))[: n % shards])
    quota = [n // shards + (s in odd) for s in range(shards)]
    begin = [sum(have[:s]) for s in range(shards)]
    spare_before = [sum(max(0, have[u] - quota[u]) for u in range(s)) for s in range(shards)]
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), i + 1)
    rank = F.col("place") - pick(begin, F.col("first"))
    spare = rank - pick(quota, F.col("first")) + pick(spare_before, F.col("first"))
    gap_shard, gap_slot, filled = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        if (gap := quota[s] - have[s]) > 0:
            inside = (F.col("spare") >= filled) & (F.col("spare") < filled + gap)
            gap_shard = F.when(inside, F.lit(s)).otherwise(gap_shard)
            gap_slot = F.when(inside, F.col("spare") - filled + have[s]).otherwise(gap_slot)
            filled += gap
    stays = F.col("rank") < pick(quota, F.col("first"))
    out = numbered.withColumns({"rank": rank, "spare": spare})
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(stays, F.col("first")).otherwise(gap_shard).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(gap_slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, shards: int = SHARDS, turns: int = TURNS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with all their columns, and shard, slot and copy (from 1, among rows of one id and text). Of these a
    name that docs has gets underscores."""
    names = {}
    for n in ("shard", "slot", "copy"):
        names[n] = n
        while names[n].lower() in {c.lower() for c in docs.columns}:
            names[n] += "_"
    placed = shard(docs, shards, turns, doc_id, text).select("doc_id", "text_crc32", "shard", "slot")
    placed = placed.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    body = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    own = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text_crc32"), row.alias("row"))
    own = own.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "text_crc32").orderBy("text_crc32")))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_crc32") == F.col("b.text_crc32")) & (F.col("a.copy") == F.col("b.copy"))
    both = own.alias("a").join(placed.alias("b"), same)
    return both.select(*[F.col("a.row").getField(c).alias(c) for c in docs.columns], *[F.col(f"b.{n}").alias(names[n]) for n in names])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
