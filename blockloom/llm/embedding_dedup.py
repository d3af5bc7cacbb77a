"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Vectors of one label and length start in one node of each tree. A node of more than LEAF vectors is split along a random
projection, at the place between two of its quantiles where gap and balance are best, so that a cut seldom goes through
a crowd; vectors within a margin of it go to both sides, at most SPILLS times on a path, so a tree holds at most
2 to the power SPILLS copies of a vector however deep it is. Each level of a tree has one direction, so all projections
are taken in one pass and the splits are plain aggregates and joins. Vectors of a leaf are compared with each other in
double precision, and links are united.

The number of trees follows from the target recall and the size of the largest label: a pair at the threshold is parted
by a level with a chance that comes from its projected difference and the margin, and levels double with the size.

A node whose spread along STUCK directions on end is below that of a cluster of vectors that are mostly linked (TIGHT)
isn't split: its pairs are compared in full, block by block, whatever its size, since most of them are links that are to
be counted. Nodes of equal members, from other trees, are compared once. A pair may meet in several leaves; it is counted
only in the one of lowest key, which each row finds from the list of leaves its vectors are in. So no pair leaves a task:
a task gives link counts and at most one edge fewer than its vectors.

Equal vectors are one vertex with a count. Vectors that are null, empty or zero, or hold a null or a number that isn't
finite, and those whose label or id is null, link with nothing. Rows that repeat an id and its vector count as copies
of each other; with different vectors they are one vertex of the graph. An empty table gives an empty result. Only the
three columns named are read."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import Scratch, components, partitions, runs, table

LEAF, BLOCK, SPILLS, STUCK, SEED, RECALL = 384, 1024, 2, 2, 17, 0.995
#: In standard deviations of the projected difference of a pair at the threshold: the margin on each side of a split, and
#: the spread up to which a node is a cluster of vectors that are mostly linked.
MARGIN, TIGHT = 0.3, 0.85
#: Quantiles of a node's projections; it is split between two of them.
QUANTILES = [k / 20 for k in range(1, 20)]


def parted(threshold: float, margin: float) -> float:
    """Chance that a level parts a pair at the threshold, for directions of all vectors evenly spread: the chance to lie
    on both sides of the cut, farther from it than the margin."""
    x = 2 * margin
    beyond = 2 * (math.exp(-x * x / 2) / math.sqrt(2 * math.pi) - x * math.erfc(x / math.sqrt(2)) / 2)
    return math.sqrt(2 - 2 * threshold) / math.sqrt(2 * math.pi) * beyond


def forest(threshold: float, vectors: int, leaf: int, recall: float = RECALL) -> tuple[int, int]:
    """Trees, and levels at most, for a largest label of so many vectors. Spill lasts for about half of the levels."""
    depth = max(0.0, math.log2(max(vectors, 1) / leaf))
    together = (1 - (parted(threshold, MARGIN) + parted(threshold, 0.0)) / 2) ** depth
    trees = 1 if together == 1 else max(2, math.ceil(math.log(1 - recall) / math.log(1 - together)))
    return trees, 12 + 2 * math.ceil(depth)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[lo:hi] for lo, hi in zip(ends, ends[1:])]


def project(trees: int, levels: int):
    """(id, label, dim, tree, at): the projections of a vector on a tree's directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = vectors_of(batch.column("embedding"))
            dims = np.array([len(x) for x in rows])
            for d in np.unique(dims).tolist() if len(rows) else []:
                if d not in directions:
                    g = np.random.default_rng([SEED, d]).standard_normal((d, trees * levels))
                    directions[d] = g / np.linalg.norm(g, axis=0)
                at = np.flatnonzero(dims == d)
                p = (unit(np.stack([rows[i] for i in at])) @ directions[d]).astype(np.float32)
                ids, labels = (pa.array(batch.column(c).take(pa.array(at))) for c in ("id", "label"))
                for t in range(trees):
                    own = np.ascontiguousarray(p[:, t * levels : (t + 1) * levels]).ravel()
                    lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * levels, own)
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), t, np.int32)), lists], ["id", "label", "dim", "tree", "at"])

    return run


def compare(threshold: float):
    """For each task its vectors' link counts and the edges that connect them: (id, n, to), one of n and to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "task"):
            part = part.combine_chunks().to_batches()[0]
            if part.num_rows < 2:
                continue
            ids, copies, block = (part.column(c).to_numpy() for c in ("id", "copies", "block"))
            x = unit(np.stack(vectors_of(part.column("embedding"))))
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if (low := block.min()) != block.max():  # two blocks of a node meet here: only pairs across
                near &= (block == low)[:, None] != (block == low)[None, :]
            at = np.flatnonzero(near.any(axis=1))
            if not len(at):
                continue
            near, ids, copies = near[np.ix_(at, at)], ids[at], copies[at]
            root = np.arange(len(at))
            while True:
                low_root = np.minimum(root, np.where(near, root[None, :], len(at)).min(axis=1))
                if (low_root == root).all():
                    break
                root = low_root
            own, lists = part.column("key")[0].as_py(), part.column("leaves")
            earlier = [(i, k) for i, j in enumerate(at.tolist()) for k in lists[j].as_py() if k < own]
            often = Counter(k for _, k in earlier)
            seen = {k: i for i, k in enumerate(k for k, n in often.items() if n > 1)}
            if seen:
                r, c = zip(*[(i, seen[k]) for i, k in earlier if k in seen])
                member = np.zeros((len(at), len(seen)), dtype=np.float32)
                member[r, c] = 1
                near &= member @ member.T < 0.5  # else an earlier leaf has the pair
            n = near @ copies.astype(np.float64)
            linked = np.flatnonzero(n > 0)
            child = np.flatnonzero(root != np.arange(len(at)))
            out = [np.concatenate((ids[linked], ids[child])), [*n[linked].astype(np.int64).tolist(), *[None] * len(child)], [*[None] * len(linked), *ids[root[child]].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["id", "n", "to"])

    return run


def distinct_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves of (key, id), of those with equal members one; with n, their size. Members are told by hashes of their ids."""
    sums = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    sized = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *sums)
    return leaves.join(sized.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"), "key")


def near_vectors(rows: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", leaf: int = LEAF, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark = rows.sparkSession
    scratch, n_parts = Scratch(spark, "vectors"), partitions(spark)
    v, odd = F.col("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)
    own = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("embedding"))
    own = own.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({h: F.when(F.col("sound"), F.xxhash64(F.lit(h), "label", "embedding")) for h in ("h1", "h2")})
    own = scratch.write(own, "rows")
    classes = own.where("sound").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = scratch.write(classes, "classes")

    largest = classes.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    trees, levels = forest(threshold, largest, leaf, recall)
    level = classes.select("id", "label", "embedding").mapInArrow(project(trees, levels), "id long, label long, dim int, tree int, at array<float>")
    level = level.select(F.xxhash64("tree", "label", "dim").alias("key"), "id", "dim", "at", F.lit(0).alias("tight"), F.lit(0).alias("spilled"))
    gap = lambda i: F.struct(((F.col("q")[i + 1] - F.col("q")[i]) * F.least(i + 1.5, 18.5 - i)).alias("score"), ((F.col("q")[i] + F.col("q")[i + 1]) / 2).alias("cut"))
    leaves, spent = None, []
    for depth in range(levels):
        level = scratch.write(level, "level")
        p, of_pair = F.col("at")[depth], F.sqrt(F.lit(2 - 2 * threshold) / F.col("dim"))
        nodes = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("tight").alias("before"), F.percentile_approx(p, QUANTILES, 1000).alias("q")).where("n > 1")
        spread = (F.col("q")[18] - F.col("q")[0]) / 3.29  # of a normal distribution this is the standard deviation
        nodes = nodes.withColumn("tight", F.when(spread <= of_pair * TIGHT, F.col("before") + 1).otherwise(0))
        nodes = nodes.withColumn("cut", F.array_max(F.transform(F.sequence(F.lit(0), F.lit(17)), gap))["cut"])
        nodes = scratch.write(nodes.select("key", "n", "tight", "cut"), "nodes")
        spent += [level, nodes]
        ends = (F.col("n") <= leaf) | (F.col("tight") >= STUCK) | F.lit(depth == levels - 1)
        here = level.join(nodes.where(ends).select("key"), "key").select("key", "id")
        leaves = here if leaves is None else leaves.unionByName(here)
        rest = nodes.where(~ends)
        if not rest.limit(1).count():
            break
        split = level.drop("tight").join(rest.select("key", "tight", "cut"), "key")
        spills = (F.abs(p - F.col("cut")) <= of_pair * MARGIN) & (F.col("spilled") < SPILLS)
        split = split.withColumn("both", spills).withColumn("side", F.explode(F.when(F.col("both"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((p > F.col("cut")).cast("int")))))
        level = split.select(F.xxhash64("key", "side").alias("key"), "id", "dim", "at", "tight", (F.col("spilled") + F.col("both").cast("int")).alias("spilled"))
    leaves = scratch.write(distinct_leaves(leaves), "leaves")
    for x in spent:
        scratch.drop(x)
    lists = leaves.groupBy("id").agg(F.collect_set("key").alias("leaves"))  # at most 2 to the power SPILLS for each tree
    blocks = F.when(F.col("n") <= max(leaf, block), 1).otherwise(F.ceil(F.col("n") / F.lit(float(block))).cast("int"))
    dealt = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "key", "block", "id")
    full = dealt.join(classes.select("id", "copies", "embedding").join(lists, "id"), "id")
    found = full.select("task", "key", "block", "id", "copies", "embedding", "leaves").repartition(n_parts, "task").sortWithinPartitions("task").mapInArrow(compare(threshold), "id long, n long, to long")
    found = scratch.write(found, "found")
    links = found.where("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("links"))
    joined = components(scratch, found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = classes.select("h1", "h2", "id", "copies").join(links, "id", "left").join(joined, "id", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = own.select(F.col("id").alias("vec_id"), "h1", "h2").join(named, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP9_SQL = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93),
reach AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(least(coalesce(low.y, vec_id), vec_id) AS BIGINT) AS component_id,
       vec_id <= coalesce(low.y, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
