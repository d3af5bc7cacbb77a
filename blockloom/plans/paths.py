"""Path, name and format-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.operators import paths as P
from blockloom.plans.catalog import query, table

_PATHS = r"SELECT page_id, html, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html", P.url_path(F.col("url")).alias("path"))


@query("""SELECT page_id, CASE WHEN starts_with(html, '<!DOC') THEN 'doctype' WHEN starts_with(html, '<htm') THEN 'html' WHEN starts_with(html, '<?xm') THEN 'xml'
WHEN length(html) > 144 AND html LIKE '%</html>' THEN 'trailer' ELSE 'raw' END AS format FROM pages""")
def q_detect_magic(spark, sf_dir):
    h = F.col("html")
    named = F.when(h.startswith("<!DOC"), "doctype").when(h.startswith("<htm"), "html").when(h.startswith("<?xm"), "xml").when((F.length(h) > 144) & h.endswith("</html>"), "trailer").otherwise("raw")
    return table(spark, sf_dir, "pages").select("page_id", named.alias("format"))


@query("""WITH c(prio, place, magic) AS (VALUES (1, 16, 'lang="de"'), (2, 22, 'lang="fr"'), (3, 22, 'lang="en"'), (4, 22, 'lang="'))
SELECT page_id, CAST(arg_min(prio, prio) AS INTEGER) AS prio, arg_min(magic, prio) AS magic FROM pages, c WHERE substr(html, place, length(magic)) = magic GROUP BY page_id""")
def q_first_match(spark, sf_dir):
    # four candidates in probe order: a fixed table, so the match is one CASE ladder and nothing is joined
    probes = [(1, 16, 'lang="de"'), (2, 22, 'lang="fr"'), (3, 22, 'lang="en"'), (4, 22, 'lang="')]
    prio, magic = F.lit(None).cast("int"), F.lit(None).cast("string")
    for p, place, m in reversed(probes):
        hit = F.substring("html", place, len(m)) == m
        prio, magic = F.when(hit, p).otherwise(prio), F.when(hit, m).otherwise(magic)
    return table(spark, sf_dir, "pages").select("page_id", prio.alias("prio"), magic.alias("magic")).where("prio IS NOT NULL")


@query(f"""SELECT page_id, ext, starts_with(html, magic) AS matched FROM (SELECT *, regexp_extract(path, '\\.([a-z0-9]+)$', 1) AS ext FROM ({_PATHS}))
JOIN (VALUES ('html', '<!DOCTYPE'), ('xml', '<?xml'), ('php', '<')) AS m(e, magic) ON e = ext""")
def q_magic_check(spark, sf_dir):
    magics = F.create_map(*[F.lit(x) for x in ("html", "<!DOCTYPE", "xml", "<?xml", "php", "<")])
    p = _paths(spark, sf_dir).withColumn("ext", F.regexp_extract("path", r"\.([a-z0-9]+)$", 1)).withColumn("magic", F.try_element_at(magics, F.col("ext")))
    return p.where("magic IS NOT NULL").select("page_id", "ext", F.col("html").startswith(F.col("magic")).alias("matched"))


@query(f"""SELECT split_part(path, '/', 1) AS host, NOT bool_or(regexp_matches(lower(path), '\\.(xml|zip)$')) AND bool_or(regexp_matches(lower(path), '\\.(html|php)$')) AS looks_site,
bool_or(len(string_split(path, '/')) <= 4 AND regexp_matches(lower(path), '(^|/)en/[^/]*$')) AS looks_english, count(*) AS entries FROM ({_PATHS}) GROUP BY host""")
def q_dir_shape(spark, sf_dir):
    low = F.lower("path")
    shape = [(~F.bool_or(low.rlike(r"\.(xml|zip)$")) & F.bool_or(low.rlike(r"\.(html|php)$"))).alias("looks_site"), F.bool_or((F.size(F.split("path", "/")) <= 4) & low.rlike("(^|/)en/[^/]*$")).alias("looks_english"), F.count(F.lit(1)).alias("entries")]
    return _paths(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("host")).agg(*shape)


_SUFFIX = f"""SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
TRY_CAST(nullif(regexp_extract(path, '([0-9]+)$', 1), '') AS BIGINT) AS idx FROM ({_PATHS})"""


def _suffixed(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("page_id", P.parent(F.col("path")).alias("dir"), P.last(F.col("path")).alias("name"), P.number_at_end(F.col("path")).alias("idx"))


@query(f"""SELECT dir, count(*) AS parts, CAST(coalesce(sum(CASE WHEN idx IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS leftover, list(idx ORDER BY idx) FILTER (WHERE idx IS NOT NULL) AS indexes FROM ({_SUFFIX}) GROUP BY dir HAVING count(idx) > 0""")
def q_group_dirs(spark, sf_dir):
    g = _suffixed(spark, sf_dir).groupBy("dir").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("idx").isNull().cast("long")).alias("leftover"), F.array_sort(F.collect_list("idx")).alias("indexes"))
    return g.where(F.size("indexes") > 0)


@query("""SELECT o_custkey, max(idx) = count(*) - 1 AND min(idx) = 0 AND count(DISTINCT idx) = count(*) AS contiguous, count(*) AS n
FROM (SELECT o_custkey, o_orderkey % 8 AS idx FROM orders) GROUP BY o_custkey""")
def q_contiguous(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 8).alias("idx"))
    # distinct indexes of a group are few, so they are counted in the first pass
    return o.groupBy("o_custkey").agg(((F.max("idx") == F.count(F.lit(1)) - 1) & (F.min("idx") == 0) & (F.size(F.collect_set("idx")) == F.count(F.lit(1)))).alias("contiguous"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, dir, row_number() OVER (PARTITION BY dir ORDER BY coalesce(idx, 9223372036854775807), name, page_id) AS place FROM ({_SUFFIX})")
def q_natural_sort(spark, sf_dir):
    w = W.partitionBy("dir").orderBy(F.coalesce("idx", F.lit((1 << 63) - 1)), "name", "page_id")
    return _suffixed(spark, sf_dir).select("page_id", "dir", F.row_number().over(w).cast("long").alias("place"))


@query(f"SELECT path AS normal, count(*) AS n, count(*) > 1 AS repeated FROM ({_PATHS}) GROUP BY path")
def q_norm_paths(spark, sf_dir):
    awkward = F.concat(F.lit("\\/"), F.col("path"))
    n = _paths(spark, sf_dir).select(P.normalise(awkward).alias("normal")).groupBy("normal").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("repeated", F.col("n") > 1)


@query(f"""SELECT page_id, name, length(name) > 0 AND name NOT IN ('.', '..') AND NOT contains(name, '/') AND NOT contains(name, '\\') AND NOT contains(name, chr(0)) AS safe
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN split_part(path, '/', 3) WHEN 1 THEN '..' WHEN 2 THEN path ELSE '' END AS name FROM ({_PATHS}))""")
def q_safe_path(spark, sf_dir):
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.split_part("path", F.lit("/"), F.lit(3))).when(k == 1, "..").when(k == 2, F.col("path")).otherwise("")
    return _paths(spark, sf_dir).select("page_id", name.alias("name")).select("page_id", "name", P.safe_component(F.col("name")).alias("safe"))


@query(f"""SELECT DISTINCT host AS folder, split_part(rest, '/', 1) AS name, contains(rest, '/') AS is_dir
FROM (SELECT split_part(path, '/', 1) AS host, substr(path, length(split_part(path, '/', 1)) + 2) AS rest FROM ({_PATHS}) WHERE contains(path, '/')) WHERE split_part(rest, '/', 1) <> ''""")
def q_dir_children(spark, sf_dir):
    return P.children(_paths(spark, sf_dir), "path", F.split_part("path", F.lit("/"), F.lit(1)))


@query(f"SELECT page_id, path FROM ({_PATHS}) WHERE NOT starts_with(upper(ltrim(path, '/\\')), 'BLOG.')")
def q_prefix_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(~F.upper(F.regexp_replace("path", r"^[/\\]+", "")).startswith("BLOG.")).select("page_id", "path")


@query("""SELECT p_partkey, p_name, p_brand, p_partkey % 5 IN (0, 1, 4) AS launch FROM part WHERE lower(p_brand) = lower('BRAND#1') OR lower(p_name) = lower('RED Widget')""")
def q_ci_lookup(spark, sf_dir):
    """Rows found whatever their case, and whether a path made for each is the root's launch file."""
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, "default.xbe").when(k == 1, "my Default.XBE").when(k == 2, "a/default.xbe").when(k == 3, "default.xex").otherwise("DEFAULT.xbe")
    p = table(spark, sf_dir, "part").where((F.lower("p_brand") == "brand#1") | (F.lower("p_name") == "red widget"))
    return p.select("p_partkey", "p_name", "p_brand", P.is_root_launch(path).alias("launch"))
