"""Offset, part and range queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.operators import layout as L
from blockloom.operators.blocks import ceil_div, quotient
from blockloom.plans.catalog import query, table

KEY = ["l_linenumber", "l_partkey", "l_suppkey", "size", "l_extendedprice"]
_ITEMS = "(SELECT *, CAST(l_quantity AS BIGINT) AS size FROM lineitem)"
_ORDERED = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, size, l_extendedprice"
_OFFSETS = f"SELECT *, CAST(coalesce(sum(size) OVER ({_ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM {_ITEMS}"
CAP = 65536
_DOC_OFFSETS = "SELECT doc_id, source, strlen(text) AS size, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents"
_ALLOC = "SELECT doc_id, greatest((strlen(text) + 4095) // 4096, 1) AS n, CAST(coalesce(sum(greatest((strlen(text) + 4095) // 4096, 1)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_block FROM documents"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long"))


def _offsets(spark, sf_dir):
    return _items(spark, sf_dir).withColumn("position", L.prefix_offset(F.col("size"), ["l_orderkey"], KEY))


@query(f"SELECT l_orderkey, l_linenumber, size, position FROM ({_OFFSETS})")
def q_prefix_offset(spark, sf_dir):
    return _offsets(spark, sf_dir).select("l_orderkey", "l_linenumber", "size", "position")


@query(f"SELECT l_orderkey, l_linenumber, position, CAST(lead(position) OVER ({_ORDERED}) - position AS BIGINT) AS length FROM ({_OFFSETS})")
def q_index_lengths(spark, sf_dir):
    after = F.lead("position").over(W.partitionBy("l_orderkey").orderBy(*KEY))
    return _offsets(spark, sf_dir).select("l_orderkey", "l_linenumber", "position", (after - F.col("position")).alias("length"))


@query(f"""WITH s AS (SELECT l_orderkey, l_shipdate >= lag(l_shipdate) OVER ({_ORDERED}) AS up, size FROM {_ITEMS})
SELECT l_orderkey, coalesce(bool_and(up), true) AS non_decreasing, count(*) AS entries, CAST(count(*) * 50 AS BIGINT) >= sum(size) AS within FROM s GROUP BY l_orderkey""")
def q_index_validate(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy(*KEY)
    s = _items(spark, sf_dir).select("l_orderkey", (F.col("l_shipdate") >= F.lag("l_shipdate").over(w)).alias("up"), "size")
    return s.groupBy("l_orderkey").agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("non_decreasing"), F.count(F.lit(1)).alias("entries"), (F.count(F.lit(1)) * 50 >= F.sum("size")).alias("within"))


@query("""SELECT event_id, user_id, CAST(sum(CASE WHEN value < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS part_no
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def q_part_resets(spark, sf_dir):
    part = F.coalesce(L.resets(F.col("value"), ["user_id"], ["ts", "event_id"]), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", "user_id", part.cast("long").alias("part_no"))


def _doc_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    return L.global_offset(docs, "doc_id", "size", "start")


@query(f"SELECT doc_id, start, CAST(start // {CAP} AS BIGINT) AS part_no, start // {CAP} <> (start + greatest(size, 1) - 1) // {CAP} AS crosses FROM ({_DOC_OFFSETS})")
def q_fixed_split(spark, sf_dir):
    end = F.col("start") + F.greatest("size", F.lit(1)) - 1
    return _doc_offsets(spark, sf_dir).select("doc_id", "start", quotient(F.col("start"), CAP).alias("part_no"), (quotient(F.col("start"), CAP) != quotient(end, CAP)).alias("crosses"))


@query("""WITH p AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST((count(*) + 9) // 10 AS BIGINT) AS parts FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(i AS INTEGER) AS part_no, CASE WHEN parts = 1 THEN 'c' || o_custkey || '.cci' ELSE 'c' || o_custkey || '.' || (i + 1) || '.cci' END AS name,
CAST(least(10, n - i * 10) AS BIGINT) AS entries FROM (SELECT *, unnest(generate_series(0, parts - 1)) AS i FROM p)""")
def q_part_names(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", ceil_div(F.col("n"), 10))
    each = p.withColumn("part_no", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    stem = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return each.select("o_custkey", "part_no", L.part_name(stem, F.col("part_no"), F.col("parts"), "cci").alias("name"), F.least(F.lit(10).cast("long"), F.col("n") - F.col("part_no") * 10).alias("entries"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
walk AS (SELECT o_custkey, o_orderkey, i, size AS used, 0 AS part_no FROM o WHERE i = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.i, CASE WHEN walk.used > 100000000 THEN o.size ELSE walk.used + o.size END,
    CASE WHEN walk.used > 100000000 THEN walk.part_no + 1 ELSE walk.part_no END FROM walk JOIN o ON o.o_custkey = walk.o_custkey AND o.i = walk.i + 1)
SELECT o_custkey, o_orderkey, CAST(part_no AS INTEGER) AS part_no FROM walk""")
def q_greedy_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))
    return L.greedy_split(o, "o_custkey", ["o_orderkey"], "size", 100_000_000).select("o_custkey", "o_orderkey", "part_no")


@query(f"""WITH d AS ({_DOC_OFFSETS}), q AS (SELECT unnest(generate_series(0, (SELECT CAST(max(start + size) AS BIGINT) - 1 FROM d), 10007)) AS point)
SELECT CAST(point AS BIGINT) AS point, doc_id, CAST(point - start AS BIGINT) AS inside FROM q JOIN d ON point >= start AND point < start + size""")
def q_locate_part(spark, sf_dir):
    d = _doc_offsets(spark, sf_dir).withColumn("end", F.col("start") + F.col("size"))
    points = d.agg(F.max("end").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1, F.lit(10007).cast("long"))).alias("point"))
    return L.locate(points, "point", d, "start", "end", 8192).select("point", "doc_id", (F.col("point") - F.col("start")).alias("inside"))


@query(f"""WITH d AS ({_DOC_OFFSETS}), q AS (SELECT unnest(generate_series(0, (SELECT CAST(max(start + size) AS BIGINT) - 1 FROM d), 2048)) AS point
  UNION SELECT start FROM d WHERE size > 0 UNION SELECT start + size - 1 FROM d WHERE size > 0)
SELECT CAST(point AS BIGINT) AS point, doc_id, CAST(point - start AS BIGINT) AS inside FROM q JOIN d ON point >= start AND point < start + size""")
def q_locate_boundaries(spark, sf_dir):
    """Every sector's first byte, and each document's first and last."""
    d = _doc_offsets(spark, sf_dir).withColumn("end", F.col("start") + F.col("size"))
    sectors = F.sequence(ceil_div(F.col("start"), 2048), quotient(F.col("end") - 1, 2048))
    inside = F.when(ceil_div(F.col("start"), 2048) <= quotient(F.col("end") - 1, 2048), F.transform(sectors, lambda s: s * 2048)).otherwise(F.array().cast("array<bigint>"))
    points = d.where("size > 0").select(F.explode(F.array_union(F.array("start", F.col("end") - 1), inside)).alias("point"))
    return L.locate(points, "point", d, "start", "end", 8192).select("point", "doc_id", (F.col("point") - F.col("start")).alias("inside"))


def _alloc(spark, sf_dir):
    n = F.greatest(ceil_div(F.octet_length("text"), 4096), F.lit(1).cast("long"))
    return L.global_offset(table(spark, sf_dir, "documents").select("doc_id", n.alias("n")), "doc_id", "n", "first_block")


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS n, first_block FROM ({_ALLOC})")
def q_block_alloc(spark, sf_dir):
    return _alloc(spark, sf_dir).select("doc_id", "n", "first_block")


@query(f"""WITH a AS ({_ALLOC}), q AS (SELECT unnest(generate_series(0, (SELECT CAST(max(first_block + n) AS BIGINT) - 1 FROM a), 7)) AS block)
SELECT CAST(block AS BIGINT) AS block, doc_id FROM q JOIN a ON block >= first_block AND block < first_block + n""")
def q_block_owner(spark, sf_dir):
    a = _alloc(spark, sf_dir).withColumn("end", F.col("first_block") + F.col("n"))
    blocks = a.agg(F.max("end").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1, F.lit(7).cast("long"))).alias("block"))
    return L.locate(blocks, "block", a, "first_block", "end", 8).select("block", "doc_id")


@query(f"""WITH a AS ({_ALLOC}), q AS (SELECT unnest(generate_series(0, (SELECT CAST(max(first_block + n) AS BIGINT) - 1 FROM a))) AS block)
SELECT CAST(block AS BIGINT) AS block, doc_id FROM q JOIN a ON block >= first_block AND block < first_block + n""")
def q_block_owners(spark, sf_dir):
    """Every block that is allocated."""
    a = _alloc(spark, sf_dir).withColumn("end", F.col("first_block") + F.col("n"))
    blocks = a.select(F.explode(F.sequence(F.col("first_block"), F.col("end") - 1)).alias("block"))
    return L.locate(blocks, "block", a, "first_block", "end", 8).select("block", "doc_id")


@query("""SELECT s AS sector, CAST(b // 41412 AS BIGINT) AS part_no, CAST((b % 41412 + (b % 41412) // 204 + 2) * 4096 + (s % 2) * 2048 AS BIGINT) AS position
FROM (SELECT o_orderkey * 13 AS s, (o_orderkey * 13) // 2 AS b FROM orders)""")
def q_remap(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 13).alias("sector"))
    return s.select("sector", *[x.alias(k) for k, x in L.god_position(F.col("sector")).items()])


@query("""SELECT block, shift, CAST(CASE WHEN block < 170 THEN a WHEN block < 28900 THEN a + ((block + 28900) // 28900) * f ELSE a + ((block + 28900) // 28900) * f + f END AS BIGINT) AS backing,
CAST(CASE WHEN block < 170 THEN 0 WHEN block < 28900 THEN block // 170 * s + f ELSE block // 170 * s + (block // 28900 + 1) * f + f END AS BIGINT) AS hash_0,
CAST(CASE WHEN block < 28900 THEN s ELSE f + block // 28900 * t END AS BIGINT) AS hash_1, CAST(t AS BIGINT) AS hash_2
FROM (SELECT o_orderkey * 5 AS block, shift, f, s, t, ((o_orderkey * 5 + 170) // 170) * f + o_orderkey * 5 AS a
      FROM orders, (VALUES (0, 1, 171, 29071), (1, 2, 172, 29242)) AS v(shift, f, s, t))""")
def q_stfs_addr(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 5).alias("block"))
    c = F.col("block")
    both = [b.select("block", F.lit(s).alias("shift"), L.stfs_backing_block(c, s).alias("backing"), *[L.stfs_hash_block(c, k, s).alias(f"hash_{k}") for k in range(3)]) for s in (0, 1)]
    return both[0].unionByName(both[1])


@query("""WITH n AS (SELECT count(*) AS total FROM lineitem), b AS (SELECT unnest(generate_series(0, (SELECT total FROM n) - 1)) AS block), u AS (
  SELECT 'data' AS kind, block, block + block // 170 + 1 + CASE WHEN block < 170 THEN 0 ELSE block // 28900 + 1 + CASE WHEN block < 28900 THEN 0 ELSE 1 END END AS address FROM b
  UNION ALL SELECT 'level 0', block, CASE WHEN block = 0 THEN 0 ELSE block // 170 * 171 + block // 28900 + 1 + CASE WHEN block < 28900 THEN 0 ELSE 1 END END FROM b WHERE block % 170 = 0
  UNION ALL SELECT 'level 1', block, CASE WHEN block = 0 THEN 171 ELSE 1 + block // 28900 * 29071 END FROM b, n WHERE block % 28900 = 0 AND total > 170
  UNION ALL SELECT 'level 2', block, 29071 FROM b, n WHERE block = 0 AND total > 28900)
SELECT kind, CAST(block AS BIGINT) AS block, CAST(address AS BIGINT) AS address, row_number() OVER (ORDER BY address) - 1 AS step FROM u""")
def q_interleave(spark, sf_dir):
    """The walk through a package of as many blocks as there are lines; without gaps, so each step is its own address."""
    total = table(spark, sf_dir, "lineitem").count()
    walked = L.stfs_walk(spark.range(total).withColumnRenamed("id", "block"), "block", total)
    return L.global_offset(walked.withColumn("one", F.lit(1).cast("long")), "address", "one", "step").select("kind", "block", "address", "step")


@query("SELECT name, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(size) AS BIGINT) AS size FROM (SELECT coalesce(source, 'none') || '.bin' AS name, strlen(text) AS size FROM documents) GROUP BY name")
def q_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit(".bin")).alias("name"), F.octet_length("text").cast("long").alias("size"))
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("size"))
