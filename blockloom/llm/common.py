"""What several operators share: scratch tables, global numbering, connected components, grouped Arrow streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as every word count here has it.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with more than so many a part of all rows are broadcast in joins: there can't be more than SHARE of them.
SHARE = 10_000
FEW_EDGES, FEW_TASKS = 250_000, 8
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where it is unset and all tasks run in this process
    (tests) one of our own is set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="blockloom-")
        sc.setCheckpointDir(root)
    return root


class Scratch:
    """Written tables that cut lineage and survive a lost executor. What was shuffled for a table is freed once it is
    written. drop() removes those no longer needed, close() all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", {}
        self.written = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{self.written}"
        self.written += 1
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, df: DataFrame | None) -> None:
        for path, kept in list(self.paths.items()):
            if kept is df:
                self.delete(path)
                del self.paths[path]

    def close(self) -> None:
        """For callers that have kept what they need: nothing that reads these tables works afterwards."""
        self.delete(self.root)
        self.paths.clear()

    def delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def frequent(counted: DataFrame, rows: int) -> DataFrame:
    """Of (key, n) those with more than a SHARE-th of so many rows: at most SHARE keys, which may be broadcast."""
    return counted.where(F.col("n") > rows / SHARE)


def with_counted(rows: DataFrame, counted: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with a written table of one row a key, n of which is how many of rows hold it. Frequent keys are joined
    where their rows are, so that no task gets all rows of a key."""
    hot = frequent(counted, rows.count())
    keys = F.broadcast(hot.select(*key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(counted.join(keys, key, "left_anti"), key))


def recurring(scratch: Scratch, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a written table whose key occurs more than once, and how often (n)."""
    return with_counted(rows, scratch.write(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often"), key)


def number_rows(scratch: Scratch, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 in the order given, without a window over all rows: rows are dealt by range,
    counted by partition, and each gets its partition's offset plus its place. order must tell rows apart,
    or those it doesn't may swap numbers."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = scratch.write(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # one row for each partition
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["_n"]
    starts = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(0))
    if len(offsets) <= 64:
        numbered = placed.withColumn(name, starts[part].cast("long") + F.col("_at").bitwiseAND((1 << 33) - 1))
    else:
        small = spark.createDataFrame(offsets, "_part long, _start long")
        numbered = placed.withColumn("_part", part).join(F.broadcast(small), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start")
    return numbered.drop("_at")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (a, b).

    Alternates large-star and small-star steps until each id has one edge, to an id that has none but those. Steps join the
    edges with one row a vertex, those of many edges by a broadcast, so no vertex's neighbours are gathered in a task. Of
    at most FEW_EDGES edges, which are counted before each step, all vertices' rows are broadcast (8 MB at most) and the
    step's stages have few tasks."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.write(e, "edges")

    def state(x: DataFrame) -> tuple[int, int]:
        """Edges, and ids that aren't settled yet."""
        ends = x.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("x")).select("x.*")
        each = fewer(ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")))
        n, wrong = each.agg(F.sum("down"), F.sum(((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).cast("long"))).first()
        return n or 0, wrong or 0

    few = e.count() <= FEW_EDGES
    fewer = lambda x: x.coalesce(FEW_TASKS) if few else x
    n, open_ = state(e)
    while open_:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        if few := n <= FEW_EDGES:
            met = both.join(F.broadcast(fewer(low).select("a", "m")), "a")
        else:
            hubs = frequent(low, 2 * n).select("a", "m")
            met = both.join(F.broadcast(hubs), "a").unionByName(both.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low.select("a", "m"), "a"))
        large = fewer(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = fewer(large.groupBy("a").agg(F.min("b").alias("m")))
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(F.broadcast(down) if few else down, "a").select(F.explode(pairs).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        after = scratch.write(fewer(small), "edges")
        scratch.drop(e)
        (n, open_), e = state(after), after
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From Arrow batches sorted by key, one table for each run of equal keys; only the run at hand is kept."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)
