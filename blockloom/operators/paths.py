"""Paths and names as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def url_path(url: Column) -> Column:
    """A URL as a relative path: scheme, query and fragment removed."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://", "")


def normalise(path: Column) -> Column:
    """Backslashes become slashes, leading slashes go."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def safe_component(name: Column) -> Column:
    return (F.length(name) > 0) & (name != ".") & (name != "..") & ~name.contains("/") & ~name.contains("\\") & ~name.contains("\0")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def last(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def number_at_end(name: Column) -> Column:
    """The number a name ends with, else null."""
    digits = F.regexp_extract(name, r"([0-9]+)$", 1)
    return digits.try_cast("long")


def children(paths: DataFrame, path: str, folder: Column) -> DataFrame:
    """Direct children of each row's folder: a nested path counts as one directory row."""
    rest = F.expr(f"substring({path}, length(_folder) + 2)")
    below = paths.withColumn("_folder", folder).where(F.col(path).startswith(F.concat("_folder", F.lit("/")))).withColumn("_rest", rest)
    name = F.split_part("_rest", F.lit("/"), F.lit(1))
    return below.select(F.col("_folder").alias("folder"), name.alias("name"), F.col("_rest").contains("/").alias("is_dir")).where("name <> ''").distinct()


def is_root_launch(path: Column) -> Column:
    """A path at the root that ends in default.xbe, in any case."""
    return ~path.contains("/") & F.lower(path).endswith("default.xbe")


def named_pairs(files: DataFrame, by: str, name: str, extensions: list[str]) -> DataFrame:
    """(by, first, second): files of a group named stem.1.ext and stem.2.ext, whatever their case. Of names that differ only
    in case the least counts."""
    parts = F.regexp_extract(F.lower(name), rf"^(.*)\.([12])\.({'|'.join(extensions)})$", 0)
    stem, number = F.regexp_replace(parts, r"\.[12](\.[^.]*)$", "$1"), F.regexp_extract(parts, r"\.([12])\.[^.]*$", 1)
    halves = files.where(parts != "").select(by, F.col(name).alias("name"), stem.alias("stem"), number.alias("n"))
    pair = [F.min(F.when(F.col("n") == k, F.col("name"))).alias(c) for k, c in (("1", "first"), ("2", "second"))]
    return halves.groupBy(by, "stem").agg(*pair).where("first IS NOT NULL AND second IS NOT NULL").drop("stem")


def with_overrides(files: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """files (keys, content) with the content of overrides in its place, and a reason where its size isn't the same; one of
    another size isn't taken."""
    new = overrides.select(*keys, F.col("content").alias("_new"))
    both = files.join(new, keys, "left")
    fits = F.octet_length("_new") == F.octet_length("content")
    wrong = F.col("_new").isNotNull() & ~F.coalesce(fits, F.lit(False))
    return both.withColumn("reason", F.when(wrong, "override of another size")).withColumn("content", F.when(fits, F.col("_new")).otherwise(F.col("content"))).drop("_new")


def checked_listing(files: DataFrame, by: str, path: str) -> DataFrame:
    """files with their normalised path and, where a path is empty, has an unsafe component or repeats another of its
    group, a reason."""
    n = F.col("normal")
    seen = F.count(F.lit(1)).over(W.partitionBy(by, "normal"))
    unsafe = F.exists(F.split(n, "/"), lambda c: ~safe_component(c))
    reason = F.when(F.coalesce(F.length(path), F.lit(0)) == 0, "empty path").when(unsafe, "unsafe path").when(seen > 1, "repeated path")
    return files.withColumn("normal", normalise(F.coalesce(F.col(path), F.lit("")))).withColumn("reason", reason)


def looks_extracted(path: Column) -> Column:
    """Aggregate over a folder's paths: of those at its top, one is an executable and none a container."""
    top = ~path.contains("/")
    return ~F.bool_or(top & F.lower(path).rlike(r"[^/]\.(iso|cso|cci|zar)$")) & F.bool_or(top & F.lower(path).rlike(r"[^/]\.(xbe|xex)$"))


def looks_god(path: Column) -> Column:
    """Aggregate: some path of four components at most ends in Data… within a folder of extension .data."""
    p = F.lower(path)
    return F.bool_or((F.size(F.split(p, "/")) <= 4) & p.rlike(r"(^|/)[^/]+\.data/data[^/]*$"))


def detect_dir(paths: DataFrame, by: str, path: str) -> DataFrame:
    """Each folder's format: god, else extracted, else null."""
    kind = F.when(looks_god(F.col(path)), "god").when(looks_extracted(F.col(path)), "extracted")
    return paths.groupBy(by).agg(kind.alias("format"))
