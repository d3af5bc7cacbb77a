"""Queries over entries inside images, sets of sectors, and bags of names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.operators import paths as P
from blockloom.operators.layout import islands
from blockloom.plans.catalog import query, table

# an order is an image of (part key, quantity) entries; its declared size comes from its total
_ENTRIES = "SELECT l_orderkey, l_linenumber, l_partkey AS sector, CAST(l_quantity AS BIGINT) * 100 AS size FROM lineitem"
_EXTENT = f"SELECT l_orderkey, CAST(greatest(max(sector * 2048 + size), 65536) AS BIGINT) AS extent, count(*) AS entries FROM ({_ENTRIES}) GROUP BY l_orderkey"
_IMAGES = f"""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 10 AS file_size, extent, coalesce(entries, 0) AS entries, o_orderstatus AS status FROM orders LEFT JOIN ({_EXTENT}) ON l_orderkey = o_orderkey"""


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("sector"), (F.col("l_quantity").cast("long") * 100).alias("size"))


@query(_EXTENT)
def q_max_extent(spark, sf_dir):
    end = F.max(F.col("sector") * 2048 + F.col("size"))
    return _entries(spark, sf_dir).groupBy("l_orderkey").agg(F.greatest(end, F.lit(65536).cast("long")).alias("extent"), F.count(F.lit(1)).alias("entries"))


def _images(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") * 10).cast("long").alias("file_size"), F.col("o_orderstatus").alias("status"))
    return o.join(q_max_extent(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("l_orderkey").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))


@query(f"SELECT o_orderkey, file_size, coalesce(extent, 0) AS extent, entries > 0 AND file_size >= extent AS complete FROM ({_IMAGES})")
def q_completeness(spark, sf_dir):
    i = _images(spark, sf_dir)
    complete = (F.col("entries") > 0) & F.coalesce(F.col("file_size") >= F.col("extent"), F.lit(False))
    return i.select("o_orderkey", "file_size", F.coalesce("extent", F.lit(0).cast("long")).alias("extent"), complete.alias("complete"))


@query(f"""SELECT l_orderkey, l_linenumber, sector, size, sector * 2048 + size <= CAST(floor(o_totalprice) AS BIGINT) * 10 AS in_bounds,
CASE WHEN sector * 2048 + size <= CAST(floor(o_totalprice) AS BIGINT) * 10 THEN NULL ELSE 'entry ends after the image' END AS reason FROM ({_ENTRIES}) JOIN orders ON o_orderkey = l_orderkey""")
def q_bounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.floor("o_totalprice") * 10).cast("long").alias("limit"))
    inside = F.col("sector") * 2048 + F.col("size") <= F.col("limit")
    return _entries(spark, sf_dir).join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "sector", "size", inside.alias("in_bounds"), F.when(~inside, "entry ends after the image").alias("reason"))


_KIND = """CASE WHEN entries = 0 AND status = 'F' THEN 'unresolved' WHEN entries = 0 THEN 'continuation' WHEN file_size >= extent THEN 'complete' ELSE 'header' END"""


@query(f"SELECT status, kind, count(*) AS images, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT *, {_KIND} AS kind FROM ({_IMAGES})) GROUP BY status, kind")
def q_classify(spark, sf_dir):
    none = F.col("entries") == 0
    kind = F.when(none & (F.col("status") == "F"), "unresolved").when(none, "continuation").when(F.col("file_size") >= F.col("extent"), "complete").otherwise("header")
    return _images(spark, sf_dir).groupBy("status", kind.alias("kind")).agg(F.count(F.lit(1)).alias("images"), F.sum("file_size").alias("bytes"))


_USED = "SELECT DISTINCT user_id, event_id % 61 AS sector FROM events"
_FREE = f"SELECT user_id, CAST(sector AS BIGINT) AS sector FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(0, 60)) AS sector) EXCEPT ({_USED})"


def _free(spark, sf_dir):
    used = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 61).alias("sector")).distinct()
    every = used.select("user_id").distinct().withColumn("sector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"))))
    return every.join(used, ["user_id", "sector"], "left_anti")


@query(f"SELECT user_id, sector, sector % 2 = 0 AS filler FROM ({_FREE})")
def q_zero_mask(spark, sf_dir):
    return _free(spark, sf_dir).withColumn("filler", F.col("sector") % 2 == 0)


@query(f"""WITH runs AS (SELECT user_id, min(sector) AS first, max(sector) AS last, count(*) AS n FROM (SELECT *, sector - row_number() OVER (PARTITION BY user_id ORDER BY sector) AS g FROM ({_FREE})) GROUP BY user_id, g)
SELECT user_id, CAST(min(first) AS BIGINT) AS first FROM runs WHERE n = 2 AND last < 60 GROUP BY user_id""")
def q_exact_run(spark, sf_dir):
    # a run is claimed only at exactly the length, the first one wins, and one still open at the end doesn't count
    runs = islands(_free(spark, sf_dir), ["user_id"], "sector")
    return runs.where((F.col("length") == 2) & (F.col("last") < 60)).groupBy("user_id").agg(F.min("first").alias("first"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_anti_reported(spark, sf_dir):
    reported = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(reported, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_custkey, o_orderpriority FROM orders EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def q_leftovers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderpriority").exceptAll(o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def q_priority_pick(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    # the first of a group is an aggregate, so it is combined before the shuffle
    first = F.min(F.struct(rank.alias("rank"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("x")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first).select("l_orderkey", "x.l_partkey", "x.l_linenumber")


@query("""WITH m AS (SELECT o_custkey, o_orderpriority AS title, 3 AS disc_count, o_orderkey % 5 AS disc FROM orders),
g AS (SELECT o_custkey, title, count(*) AS n, count(DISTINCT disc) AS d, min(disc) AS lo, max(disc) AS hi FROM m GROUP BY ALL)
SELECT o_custkey, title, n, CASE WHEN n > 1 AND d < n THEN 'duplicate' WHEN n > 1 AND (n > 3 OR lo = 0 OR hi > 3) THEN 'invalid' WHEN n > 1 THEN 'set' ELSE 'standalone' END AS kind FROM g""")
def q_group_rules(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 5).alias("disc"))
    g = m.groupBy("o_custkey", "title").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("disc")).alias("d"), F.min("disc").alias("lo"), F.max("disc").alias("hi"))
    several = F.col("n") > 1
    kind = F.when(several & (F.col("d") < F.col("n")), "duplicate").when(several & ((F.col("n") > 3) | (F.col("lo") == 0) | (F.col("hi") > 3)), "invalid").when(several, "set").otherwise("standalone")
    return g.select("o_custkey", "title", "n", kind.alias("kind"))


@query("""WITH f AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE name END AS name FROM (
  SELECT p_brand, p_partkey, split_part(p_name, ' ', 2) || p_size % 9 || CASE p_partkey % 4 WHEN 0 THEN '.1.cci' WHEN 1 THEN '.2.cci' WHEN 2 THEN '.1.cso' ELSE '.1' END AS name FROM part)),
l AS (SELECT p_brand, lower(name) AS low, min(name) AS name FROM f GROUP BY ALL)
SELECT a.p_brand, a.name AS first, b.name AS second FROM l a JOIN l b ON a.p_brand = b.p_brand AND right(a.low, 6) = '.1.cci' AND b.low = left(a.low, length(a.low) - 6) || '.2.cci'""")
def q_named_pair(spark, sf_dir):
    k = F.col("p_partkey")
    ending = F.when(k % 4 == 0, ".1.cci").when(k % 4 == 1, ".2.cci").when(k % 4 == 2, ".1.cso").otherwise(".1")
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), (F.col("p_size") % 9).cast("string"), ending)
    files = table(spark, sf_dir, "part").select("p_brand", F.when(k % 2 == 0, F.upper(name)).otherwise(name).alias("name"))
    return P.named_pairs(files, "p_brand", "name", ["cci", "cso", "ciso"])
