"""Scalar, lookup, tree and search queries."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.functions import bits as B
from blockloom.functions import titles as TT
from blockloom.operators import precedence as P
from blockloom.operators.layout import global_offset
from blockloom.operators.paths import with_overrides
from blockloom.operators.search import order_groups, search_groups
from blockloom.operators.trees import build_paths, number_level
from blockloom.plans.catalog import query, table


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("SELECT p_partkey, lpad(upper(to_hex(p_partkey * 40503)), 8, '0') AS id FROM part")
def q_hex_id(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", B.hex_id(F.col("p_partkey") * 40503).alias("id"))


@query("""SELECT p_partkey, CASE WHEN count(*) OVER w > 1 THEN p_name || ' (Disc ' || row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) || '/' || count(*) OVER w || ')' ELSE p_name END AS title
FROM part WINDOW w AS (PARTITION BY p_name, p_brand)""")
def q_disc_title(spark, sf_dir):
    w = W.partitionBy("p_name", "p_brand")
    return _part(spark, sf_dir).select("p_partkey", B.disc_title(F.col("p_name"), F.row_number().over(w.orderBy("p_partkey")), F.count(F.lit(1)).over(w)).alias("title"))


_VERSION = "concat_ws('.', CAST((v >> 28) & 15 AS VARCHAR), CAST((v >> 24) & 15 AS VARCHAR), CAST((v >> 8) & 65535 AS VARCHAR), CAST(v & 255 AS VARCHAR))"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST(v AS VARCHAR) WHEN base = 0 THEN {_VERSION} ELSE {_VERSION} || ' (base ' || {_VERSION.replace('(v', '(base').replace('CAST(v ', 'CAST(base ')} || ')' END AS version
FROM (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS v, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (p_partkey * 40503) % 4294967296 END AS base FROM part)""")
def q_version(spark, sf_dir):
    k = F.col("p_partkey")
    base = F.when(k % 3 == 0, F.lit(0).cast("long")).otherwise(k * 40503 % (1 << 32))
    return _part(spark, sf_dir).select("p_partkey", B.version_text(k * 2654435761 % (1 << 32), base, k % 5 == 0).alias("version"))


_CODES = "[28672, 20480, 851968, 4096, 16384, 524288, 589824, 33554432, 917504, 1, 2, 3, 8192, 32768, 36864, 65536, 131072, 196608, 262144, 327680, 393216, 458752, 655360, 720896, 786432, 983040, 1048576, 2097152, 3145728, 4194304, 5242880, 6291456, 0, 16711680]"
_TYPE_NAMES = "['gamesOnDemand', 'xboxOriginal', 'arcadeGame', 'xbox360Title', 'installedGame', 'gameDemo', 'video', 'communityGame', 'xna', 'savedGame', 'marketPlaceContent', 'publisher', 'iptvPauseBuffer', 'avatarAssetPack', 'avatarItem', 'profile', 'gamerPicture', 'theme', 'cacheFile', 'storageDownload', 'xboxSavedGame', 'xboxDownload', 'gamerTitle', 'installer', 'gameTrailer', 'licenseStore', 'movie', 'tv', 'musicVideo', 'gameVideo', 'podcastVideo', 'viralVideo']"
_TYPE_LABELS = "['Games on Demand', 'Xbox Original', 'Arcade Game', 'Xbox 360 Title', 'Installed Game', 'Game Demo', 'Video', 'Community Game', 'XNA', 'Saved Game', 'Marketplace Content', 'Publisher', 'IPTV Pause Buffer', 'Avatar Asset Pack', 'Avatar Item', 'Profile', 'Gamer Picture', 'Theme', 'Cache File', 'Storage Download', 'Xbox Saved Game', 'Xbox Download', 'Gamer Title', 'Installer', 'Game Trailer', 'License Store', 'Movie', 'TV', 'Music Video', 'Game Video', 'Podcast Video', 'Viral Video']"
_BOOTABLE = "(28672, 20480, 851968, 4096, 16384, 524288, 33554432, 917504)"


@query(f"""SELECT p_partkey, code, ({_TYPE_NAMES})[i] AS content_type, ({_TYPE_LABELS})[i] AS label, CASE WHEN i > 32 THEN NULL WHEN code IN {_BOOTABLE} THEN 'bootable' WHEN code = 65536 THEN 'profileAccount'
  WHEN code IN (1, 393216, 2, 36864, 720896) THEN 'titleAttached' ELSE 'standaloneAsset' END AS family, code IN {_BOOTABLE} AS needs_exe
FROM (SELECT p_partkey, CAST(p_partkey % 34 + 1 AS INTEGER) AS i, ({_CODES})[p_partkey % 34 + 1] AS code FROM part)""")
def q_family(spark, sf_dir):
    """Every content type's code and two that aren't known, dealt over the parts."""
    codes = F.array(*[F.lit(c) for _, c, _ in TT.CONTENT_TYPES], F.lit(0), F.lit(0xFF0000))
    code = F.element_at(codes, (F.col("p_partkey") % 34 + 1).cast("int"))
    parts = _part(spark, sf_dir).select("p_partkey", code.alias("code"))
    c = F.col("code")
    return parts.select("p_partkey", "code", TT.content_type(c).alias("content_type"), TT.content_label(c).alias("label"), TT.family(c).alias("family"), TT.boots(c).alias("needs_exe"))


@query("SELECT p_partkey, (p_size & 16) <> 0 AS is_dir, p_size | 7 AS with_media, p_size & ~6 AS cleared, (p_size & ~12) | 8 AS updated FROM part WHERE (p_size & 32) = 0")
def q_bitflags(spark, sf_dir):
    s = F.col("p_size")
    p = _part(spark, sf_dir).where(s.bitwiseAND(F.lit(32)) == 0)
    return p.select("p_partkey", (s.bitwiseAND(F.lit(16)) != 0).alias("is_dir"), s.bitwiseOR(F.lit(7)).alias("with_media"), s.bitwiseAND(F.lit(~6)).alias("cleared"), s.bitwiseAND(F.lit(~12)).bitwiseOR(F.lit(8)).alias("updated"))


@query("""SELECT event_id, CAST(((CAST(year(ts) - 1980 AS BIGINT) & 239) << 25) | (CAST(month(ts) AS BIGINT) << 21) | (CAST(day(ts) AS BIGINT) << 16)
| (CAST(hour(ts) AS BIGINT) << 11) | (CAST(minute(ts) AS BIGINT) << 5) | (CAST(floor(second(ts)) AS BIGINT) & 31) AS BIGINT) & 4294967295 AS packed FROM events""")
def q_dos_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", B.dos_time(F.col("ts")).alias("packed"))


@query(None)
def q_utf16(spark, sf_dir):
    data = B.utf16(F.col("p_name"), 40)
    return _part(spark, sf_dir).select("p_partkey", F.hex(data).alias("data"), B.from_utf16(data).alias("back"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events")
def q_kv_fields(spark, sf_dir):
    fields = F.from_json("props", "k STRING, none STRING")
    return table(spark, sf_dir, "events").select("event_id", fields["k"].alias("k"), fields["none"].alias("missing"))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS at, p_size % 7 AS value FROM (SELECT *, unnest(generate_series(0, p_size % 5 - 1)) AS i FROM part WHERE p_size % 5 > 0)")
def q_rle(spark, sf_dir):
    runs = _part(spark, sf_dir).where(F.col("p_size") % 5 > 0)
    return runs.select("p_partkey", F.posexplode(F.array_repeat(F.col("p_size") % 7, F.col("p_size") % 5)).alias("at", "value"))


@query("""SELECT p_partkey, CAST(sum((((p_partkey & 1023) >> b & 1) << (2 * b)) | (((p_partkey * 7 & 1023) >> b & 1) << (2 * b + 1))) AS BIGINT) AS code
FROM part, (SELECT unnest(generate_series(0, 9)) AS b) GROUP BY p_partkey""")
def q_morton(spark, sf_dir):
    k = F.col("p_partkey")
    low = lambda x: x.bitwiseAND(F.lit(1023).cast("long"))
    return _part(spark, sf_dir).select("p_partkey", B.morton(low(k), low(k * 7)).alias("code"))


_WIDE = "(((({v}) * 255 + {add}) // {div}) + (({v}) * 255 + {add})) // {div}"


@query(f"""SELECT p_partkey, {_WIDE.format(v="c >> 11", add=16, div=32)} AS r, {_WIDE.format(v="c >> 5 & 63", add=32, div=64)} AS g, {_WIDE.format(v="c & 31", add=16, div=32)} AS b,
(c >> 11) << 3 AS r0, (c >> 5 & 63) << 2 AS g0, (c & 31) << 3 AS b0 FROM (SELECT p_partkey, p_partkey * 40503 % 65536 AS c FROM part)""")
def q_rgb565(spark, sf_dir):
    c = F.col("p_partkey") * 40503 % 65536
    both = B.rgb565(c, True) + B.rgb565(c, False)
    return _part(spark, sf_dir).select("p_partkey", *[x.alias(n) for x, n in zip(both, ("r", "g", "b", "r0", "g0", "b0"))])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_name AS title, lpad(upper(to_hex(l_partkey)), 8, '0') AS id
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey""")
def q_dim_lookup(spark, sf_dir):
    # no hint: whether the dimension is sent to every task hangs on its size, which Catalyst knows
    titles = _part(spark, sf_dir).where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    return table(spark, sf_dir, "lineitem").join(titles, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "title", B.hex_id(F.col("l_partkey")).alias("id"))


_SOURCES = """SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 851968 END AS ov, CASE WHEN o_orderkey % 3 = 0 THEN 65536 END AS hd, CASE WHEN o_orderkey % 2 = 0 THEN 28672 END AS de,
CASE WHEN o_orderkey % 7 = 0 THEN 16711680 END AS raw, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS title_ov, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 2500 END AS exe,
CASE WHEN o_orderkey % 8 = 0 THEN 'own' END AS name_ov, CASE WHEN o_orderkey % 10 = 0 THEN 'header' END AS name_hd, o_orderkey % 2 = 1 AS signed, CAST(o_orderkey % 3 AS INTEGER) AS discs FROM orders"""


@query(f"""WITH s AS ({_SOURCES}), t AS (SELECT *, coalesce(title_ov, exe, CASE WHEN coalesce(ov, hd, de) IN {_BOOTABLE} THEN NULL ELSE 0 END) AS title_id FROM s)
SELECT k, coalesce(ov, hd, de, raw, 28672) AS content_type, CASE WHEN k % 6 = 0 THEN '0102030405' WHEN k % 9 = 0 THEN 'AABBCCDDEE' ELSE '0000000000' END AS console_id, title_id,
CASE WHEN title_id IS NULL THEN 'no launch executable names a title' END AS title_reason, coalesce(name_ov, name_hd, p_name) AS display_name,
coalesce(name_ov, CASE WHEN discs > 1 THEN p_name || ' (Disc 1/' || discs || ')' ELSE p_name END) AS tree_title,
CASE WHEN NOT signed THEN coalesce(de, 20480) WHEN de = 28672 THEN 16384 END AS tree_type, CASE WHEN signed AND coalesce(de, 20480) <> 28672 THEN 'only games on demand can be signed' END AS tree_reason,
CASE WHEN k % 3 = 0 THEN 'executable' WHEN k % 4 = 0 THEN 'header' END AS thumbnail, CASE WHEN k % 6 = 0 THEN o_custkey ELSE k END AS profile_id
FROM t LEFT JOIN part ON p_partkey = title_id""")
def q_precedence(spark, sf_dir):
    """Every field that several places may name, over orders that name them in all combinations; part is the title table."""
    s = table(spark, sf_dir, "orders").selectExpr(*_SOURCES.replace("\n", " ").removeprefix("SELECT ").removesuffix(" FROM orders").split(", "))
    c = {n: F.col(n) for n in s.columns}
    title_id, reason = P.package_title_id(c["title_ov"], c["exe"], F.coalesce("ov", "hd", "de"))
    titles = _part(spark, sf_dir).select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("listed"))
    s = s.withColumns({"title_id": title_id, "title_reason": reason}).join(titles, "title_id", "left")
    own = lambda n, x: F.when(F.col("k") % n == 0, x)
    console = P.identifier(own(6, F.unhex(F.lit("0102030405"))), own(9, F.unhex(F.lit("AABBCCDDEE"))), 5)
    tree_type, tree_reason = P.tree_type(c["signed"], F.coalesce("de", F.lit(TT.CODES["xboxOriginal"])))
    return s.select(
        "k", P.package_type(c["ov"], c["hd"], c["de"], c["raw"]).alias("content_type"), F.hex(console).alias("console_id"), "title_id", "title_reason", P.package_name(c["name_ov"], c["name_hd"], F.col("listed")).alias("display_name"),
        P.tree_title(c["name_ov"], F.col("listed"), F.lit(1), c["discs"]).alias("tree_title"), tree_type.alias("tree_type"), tree_reason.alias("tree_reason"),
        P.thumbnail(own(3, F.lit("executable")), own(4, F.lit("header"))).alias("thumbnail"), P.profile_id(own(6, F.col("o_custkey")), F.col("k")).alias("profile_id"),
    )


@query("""SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS content, CASE WHEN s_suppkey % 2 = 1 THEN 'override of another size' END AS reason
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def q_override(spark, sf_dir):
    """Part names as files; suppliers replace those of their number, every second one by a longer one, which isn't taken."""
    files = _part(spark, sf_dir).select("p_partkey", F.col("p_name").cast("binary").alias("content"))
    over = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")).join(_part(spark, sf_dir), "p_partkey")
    over = over.select("p_partkey", F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("!")).cast("binary").alias("content"))
    return with_overrides(files, over, ["p_partkey"]).select("p_partkey", F.col("content").cast("string").alias("content"), "reason")


def _nodes(spark, sf_dir):
    region = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent", "r_name AS name")
    nation = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "n_name")
    supplier = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey)", "concat('n', CASE WHEN s_suppkey = 3 THEN 99 ELSE s_nationkey END)", "s_name")
    return region.union(nation).union(supplier)


@query("""SELECT 's' || s_suppkey AS id, CASE WHEN n_name IS NULL THEN NULL ELSE r_name || '/' || n_name || '/' || s_name END AS path, CASE WHEN n_name IS NULL THEN 'parent missing' END AS reason
FROM supplier LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey = 3 THEN 99 ELSE s_nationkey END LEFT JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, NULL FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region""")
def q_tree_paths(spark, sf_dir):
    return build_paths(_nodes(spark, sf_dir), 4)


_NATIONS = "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_regionkey, lower(n_name), 'n' || n_nationkey) - 1 AS number FROM nation"


@query(f"""WITH n AS ({_NATIONS}) SELECT 's' || s_suppkey AS id, row_number() OVER (ORDER BY n.number, lower(s_name), 's' || s_suppkey) - 1 AS number FROM supplier JOIN n ON n_nationkey = s_nationkey""")
def q_bfs_number(spark, sf_dir):
    regions = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(r_regionkey AS BIGINT) AS number")
    nations = number_level(regions, table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "n_name AS name"), "name")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS id", "concat('n', s_nationkey) AS parent", "s_name AS name")
    return number_level(nations.select("id", "number"), suppliers, "name").select("id", F.col("number").cast("long").alias("number"))


@query("""SELECT name, first, CAST(coalesce(sum(length(name) + 1) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS name_offset
FROM (SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS first FROM part GROUP BY 1)""")
def q_intern(spark, sf_dir):
    names = _part(spark, sf_dir).groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("first"))
    return global_offset(names.withColumn("size", (F.length("name") + 1).cast("long")), "first", "size", "name_offset").select("name", "first", "name_offset")


_L = "(SELECT l_orderkey AS o, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)"
_SUBSETS = f"""SELECT o, 1 AS k, count(*) AS n FROM {_L} WHERE q = 60 GROUP BY o
UNION ALL SELECT a.o, 2, count(*) FROM {_L} a JOIN {_L} b ON a.o = b.o AND a.i < b.i WHERE a.q + b.q = 60 GROUP BY a.o
UNION ALL SELECT a.o, 3, count(*) FROM {_L} a JOIN {_L} b ON a.o = b.o AND a.i < b.i JOIN {_L} c ON a.o = c.o AND b.i < c.i WHERE a.q + b.q + c.q = 60 GROUP BY a.o"""


def _sizes(spark, sf_dir):
    # orders whose items can't reach the target never leave the JVM
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(q).alias("sizes"), F.sum(q).alias("total")).where("total >= 60")


@query(f"SELECT o AS l_orderkey, CAST(arg_min(k, k) AS INTEGER) AS k, CAST(arg_min(n, k) AS BIGINT) AS subsets FROM ({_SUBSETS}) GROUP BY o")
def q_subset_sum(spark, sf_dir):
    """As far as its SQL goes: subsets of up to three lines, without a budget. q_subset_search has the operator's limits."""
    return search_groups(_sizes(spark, sf_dir), "l_orderkey", "sizes", 60, most=3, nodes=sys.maxsize).drop("reason")


@query(None)
def q_subset_search(spark, sf_dir):
    """The operator's own limits: up to 8 lines; an order whose search takes more steps than its budget is a row with a reason."""
    return search_groups(_sizes(spark, sf_dir), "l_orderkey", "sizes", 60)


@query(f"""WITH t AS (SELECT o FROM {_L} GROUP BY o HAVING count(*) = 3)
SELECT a.o AS l_orderkey, concat_ws('-', CAST(a.i AS VARCHAR), CAST(b.i AS VARCHAR), CAST(c.i AS VARCHAR)) AS ordering, a.q * 4 + b.q * 2 + c.q AS position
FROM t JOIN {_L} a ON a.o = t.o JOIN {_L} b ON b.o = t.o AND b.i <> a.i JOIN {_L} c ON c.o = t.o AND c.i <> a.i AND c.i <> b.i""")
def q_permute(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))))
    three = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("x")).where(F.size("x") == 3)
    orders = F.array(*[F.array(*map(F.lit, p)) for p in ((1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1))])
    each = three.select("l_orderkey", "x", F.explode(orders).alias("p"))
    q = [F.element_at("x", F.col("p")[i])["q"] for i in range(3)]
    return each.select("l_orderkey", F.array_join(F.col("p").cast("array<string>"), "-").alias("ordering"), (q[0] * 4 + q[1] * 2 + q[2]).alias("position"))


@query(None)
def q_orderings(spark, sf_dir):
    """Orderings of the lines of every order, within the operator's limit of 2,000 an order; complete tells where it cuts."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("x"))
    return order_groups(lines.select("l_orderkey", F.transform("x", lambda x: x["q"]).alias("q")), "l_orderkey", "q")


@query(f"""SELECT a.o AS l_orderkey, count(*) AS winners, count(DISTINCT least(a.q, b.q) || ',' || greatest(a.q, b.q)) > 1 AS ambiguous
FROM {_L} a JOIN {_L} b ON a.o = b.o AND a.i < b.i WHERE a.q + b.q BETWEEN 55 AND 60 GROUP BY a.o""")
def q_ambiguity(spark, sf_dir):
    # pairs of an order's own few items, made inside the row rather than by a self join
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"))
    pairs = F.flatten(F.transform("q", lambda a, i: F.transform(F.slice("q", i + 2, F.size("q")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    wins = sizes.select("l_orderkey", F.filter(pairs, lambda p: (p["a"] + p["b"]).between(55, 60)).alias("w")).where(F.size("w") > 0)
    return wins.select("l_orderkey", F.size("w").cast("long").alias("winners"), (F.size(F.array_distinct("w")) > 1).alias("ambiguous"))
