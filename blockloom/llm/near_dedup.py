"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the hashes of its distinct shingles of five words (fewer words: the whole sequence as one).
Equal sets are one vertex from the start. Each set has a sketch of minwise values. In each of several trees all sets
start in one node, which deals them out by their minwise value under the tree's own hash function, so trees are
independent there. A node of more than LEAF sets chooses again, twice in a round: first by one more value, after that by
one or, with chance BRANCH, two, picked by the node's own hash among CHOICES values. A node of at most LEAF sets is
compared exhaustively. A path makes at most DEPTH choices.

The trees follow from the target recall, set by set. A pair at the threshold stays together after a number of choices
with the survival chance of the branching process. If no node of a set's first trees was large, a pair it is in was
parted in all of them with too small a chance already. Sets from large nodes go on with more trees, until the chance, by the
choices that were made around them and averaged over the spread of sketch agreement, is small enough: a pair has all
trees of whichever of its sets leaves first. So the work grows only where common shingles make it needed.

A node that a choice didn't shrink enough (ALIKE), or that made all a path may make, is taken to hold sets that are alike. Its
sets are compared in blocks together with common pivots, which links almost all of them. Those that are then not of the
node's main component are compared with every set of the node, so that no pair that meets in such a node is lost,
whatever its size.

Comparison is in two steps: sketches tell which sets of a leaf may be linked (by COMPARED values of their own, with a
bound that costs a tenth of the links that may be lost), and the full sets, made again from the whole texts, confirm
each link: all intersections of a list of at most LEAF sets are one product of the matrix that says which set holds
which shingle.

Null, empty and blank texts have no shingles and stand alone. Rows that repeat an id are one vertex. A null id stands
alone with a null component. An empty table gives an empty result. Only doc_id and text are read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.llm.common import Scratch, components, partitions, runs, table

WORDS, LEAF, DEPTH, BRANCH, RECALL = 5, 1024, 13, 0.3, 0.99999
#: Minwise values of a sketch: one for each tree, those compared in leaves, and those that deeper nodes choose among.
TREES, COMPARED, CHOICES = 40, 64, 152
COORDINATES = TREES + COMPARED + CHOICES
PLAIN = 2  # so many choices of a path don't branch
MORE_TREES = 8  # for sets from large nodes; twice as many each time after
ROUNDS = 1 + (DEPTH - 1) // 2  # the first makes one choice, the others two
PIVOTS, PIVOT_TREES, ALIKE, STUCK, FEW, REMEMBERED, REMEMBERED_BYTES = 16, 3, 0.9, 1, 6, 200_000, 64
U = np.uint64
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
STEPS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler(dict):
    """word -> its 64-bit hash, words of at most REMEMBERED_BYTES kept; call it for a text's set."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= REMEMBERED_BYTES:
            self[word] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > REMEMBERED:
            self.clear()
        k = min(WORDS, len(words))
        out = np.full(len(words) - k + 1, U(k), dtype=np.uint64)
        for i in range(k):
            out += mix(h[i : len(h) - k + 1 + i] + STEPS[i]) * STEPS[i]
        return np.unique(mix(out))


def sketch(s: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The set's minwise values: for trees in 32 bits, for comparison in 8, for choices in 16."""
    low = np.full(COORDINATES, U(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    base = s ^ (s >> U(32))
    for lo in range(0, len(s), 4096):
        np.minimum(low, np.multiply.outer(FACTORS, base[lo : lo + 4096]).min(axis=1), out=low)
    low >>= U(16)
    return low[:TREES].astype(np.uint32).tobytes(), (low[TREES : TREES + COMPARED] >> U(8)).astype(np.uint8).tobytes(), (low[TREES + COMPARED :] >> U(8)).astype(np.uint16).tobytes()


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sets = [shingle(x.as_py()) for x in part.column("text")]
            totals = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + U(1))))) for s in sets]
            made = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.array([t[i] for t in totals], dtype=np.uint64).view(np.int64)) for i in (0, 1)], *[pa.array([m[i] for m in made], pa.binary()) for i in range(3)]],
                ["doc_id", "n_shingles", "h1", "h2", "wide", "low", "sketch"])


SKETCHES = "doc_id long, n_shingles long, h1 long, h2 long, wide binary, low binary, sketch binary"


def survival(similarity: float, choices: int, agreement: float | None = None) -> float:
    """Chance that two sets of this similarity share a node after so many choices; after the first one they agree in this
    share of the values to choose from."""
    s = similarity if agreement is None else agreement
    lost = 0.0
    for _ in range(choices - PLAIN):
        lost = (1 - s + s * lost) * (1 - BRANCH * s + BRANCH * s * lost)
    return similarity * s ** (min(choices, PLAIN) - 1) * (1 - lost)


def agreement(similarity: float, coordinates: int) -> list[float]:
    """Chances that the sketches of two sets of this similarity agree in 0, 1, ... coordinates."""
    return [math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m) for m in range(coordinates + 1)]


def cases(threshold: float, step: int = 4) -> list[tuple[float, float]]:
    """(chance, share of values that agree) for a pair at the threshold, step counts in one, with the least one's share."""
    chances = agreement(threshold, CHOICES)
    binned = [(sum(chances[m : m + step]), m / CHOICES) for m in range(0, CHOICES + 1, step)]
    return [(p, share) for p, share in binned if p > 1e-12]


def allowed(recall: float = RECALL) -> float:
    """The chance to be parted in all trees that a pair at the threshold may have; the tenth left is for least_agreement."""
    return 0.9 * (1 - recall)


def first_trees(threshold: float, recall: float = RECALL) -> int:
    """Trees after which a pair at the threshold that no large node holds is lost with the chance allowed at most."""
    return math.ceil(math.log(allowed(recall)) / math.log(1 - threshold))


def parted(threshold: float) -> list[list[float]]:
    """For each case, the logarithm of the chance that a tree parts a pair, by choices from 1 to DEPTH."""
    return [[math.log(1 - survival(threshold, c, share)) for c in range(1, DEPTH + 1)] for _, share in cases(threshold)]


def least_agreement(threshold: float, recall: float = RECALL) -> int:
    """Of COMPARED coordinates, how many must agree: a pair at the threshold has fewer with a tenth of chance 1 - recall at most."""
    least, below = 0, 0.0
    for p in agreement(threshold, COMPARED):
        below += p
        if below > 0.1 * (1 - recall):
            return least
        least += 1
    return least


def child(choice: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix(choice ^ mix((at.astype(np.uint64) << U(32)) | values.astype(np.uint64)))


def branch(keys: np.ndarray, values: np.ndarray, twice: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Child keys and, for each, the row it is of. The choice hangs on the node's key alone."""
    choice, n = mix(keys), values.shape[1]
    one = (choice % U(n)).astype(np.int64)
    other = (one + 1 + (choice >> U(32)).astype(np.int64) % (n - 1)) % n
    again = np.flatnonzero((mix(choice) >> U(11)).astype(np.float64) / (1 << 53) < BRANCH) if twice else np.empty(0, np.int64)
    rows = np.concatenate((np.arange(len(keys)), again))
    at = np.concatenate((one, other[again]))
    return child(choice[rows], at, values[rows, at]), rows


def matrix(batch: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(batch.num_rows, -1)


def first_level(trees: range):
    """The nodes that each tree deals the sets to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column("id").to_numpy(), matrix(batch, "wide", np.uint32)
            for t in trees:
                keys = child(np.full(len(ids), mix(np.array([t], dtype=np.uint64))[0]), np.full(len(ids), t), values[:, t % TREES])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), t, np.int32)), pa.array(np.full(len(ids), 1 << 60, np.int64)), *[pa.array(np.full(len(ids), x, np.int32)) for x in (0, 1)]], ["key", "id", "tree", "parent", "stuck", "choices"])

    return run


def next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of large nodes after two more choices, so that few rounds are needed."""
    for batch in batches:
        values, n, made, own = matrix(batch, "sketch", np.uint16), *(batch.column(c).to_numpy() for c in ("n", "choices", "key"))
        out = []
        for rows, twice in ((np.flatnonzero(made < PLAIN), False), (np.flatnonzero(made >= PLAIN), True)):
            keys, of = branch(own[rows].view(np.uint64), values[rows], twice)
            rows = rows[of]
            keys, of = branch(keys, values[rows])
            out.append((keys, rows[of]))
        at = np.concatenate([rows for _, rows in out])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys for keys, _ in out]).view(np.int64)), *[pa.array(batch.column(c).to_numpy()[at]) for c in ("id", "tree")], pa.array((n[at] * ALIKE).astype(np.int64)),
             pa.array(batch.column("stuck").to_numpy()[at]), pa.array((made[at] + 2).astype(np.int32))], ["key", "id", "tree", "parent", "stuck", "choices"])


LEVEL = "key long, id long, tree int, parent long, stuck int, choices int"


def grow(scratch: Scratch, sets: DataFrame, trees: range, leaf: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, list[DataFrame]]:
    """Leaves (key, id) of these trees; nodes of sets that are alike (key, id, tree, n), if any; of sets that were in large
    nodes the choices each tree made around them (id, tree, choices), if any were; and the tables those are read from."""
    level = sets.select("id", "wide").mapInArrow(first_level(trees), LEVEL)
    leaves, alike, deep, spent = None, None, None, []
    both = lambda x, y: y if x is None else x.unionByName(y)
    for depth in range(ROUNDS):
        level = scratch.write(level, "level")
        stuck = F.when(F.col("n") >= F.col("of") * ALIKE, F.col("before") + 1).otherwise(0)
        counts = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("of"), F.first("stuck").alias("before"), F.first("choices").alias("choices")).where("n > 1")
        counts = scratch.write(counts.select("key", "n", "choices", stuck.alias("stuck")), "counts")
        spent += [level, counts]
        if depth:
            deep = both(deep, level.select("id", "tree", "choices"))
        leaves = both(leaves, level.join(counts.where(F.col("n") <= leaf).select("key"), "key").select("key", "id"))
        # a node that a choice hardly shrinks, or of the last round, is compared in blocks
        stop = F.lit(depth == ROUNDS - 1) | (F.col("stuck") >= STUCK)
        large = counts.where(F.col("n") > leaf).withColumn("stop", stop)
        found = {r["stop"]: r["count"] for r in large.groupBy("stop").count().collect()}
        if found.get(True):
            alike = both(alike, level.join(large.where("stop").select("key", "n"), "key").select("key", "id", "tree", "n"))
        if not found.get(False):
            break
        nodes = large.where("NOT stop").select("key", F.struct("key", "n", "stuck", "choices").alias("node"))
        rest = level.select("key", "id", "tree").join(nodes, "key").select("id", F.struct("node.*", "tree").alias("node"))
        each, rows = by_id(scratch, rest, "node", sets.select("id", "sketch"))
        spent.append(each)
        level = rows.select("node.*", "id", "sketch").mapInArrow(next_level, LEVEL)
    leaves = scratch.write(leaves, "leaves")
    alike = alike if alike is None else scratch.write(alike, "alike")
    return leaves, alike, deep, spent


def unsettled(scratch: Scratch, before: DataFrame | None, deep: DataFrame | None, trees: int, threshold: float) -> DataFrame | None:
    """Sets that need more trees, with the logarithm of each case's chance to be parted so far. before has those of the
    sets that took part, null if all sets did for the first time."""
    if before is None and deep is None:
        return None
    chances, logs = [p for p, _ in cases(threshold)], parted(threshold)
    names = [f"a{k}" for k in range(len(chances))]
    at = lambda k: F.element_at(F.array(*[F.lit(x) for x in logs[k]]), F.least("choices", F.lit(DEPTH)))
    if deep is None:
        own = before.withColumn("deep", F.lit(0)).withColumns({f"d{k}": F.lit(0.0) for k in range(len(names))})
    else:
        deep = deep.groupBy("id", "tree").agg(F.max("choices").alias("choices"))
        own = deep.groupBy("id").agg(F.count(F.lit(1)).alias("deep"), *[F.sum(at(k)).alias(f"d{k}") for k in range(len(names))])
        own = before.join(own, "id", "left").fillna(0, ["deep"]).fillna(0.0, [f"d{k}" for k in range(len(names))]) if before is not None else own.withColumns({n: F.lit(0.0) for n in names})
    now = own.select("id", *[(F.col(n) + F.col(f"d{k}") + (F.lit(trees) - F.col("deep")) * F.lit(math.log(1 - threshold))).alias(n) for k, n in enumerate(names)])
    lost = sum((F.lit(p) * F.exp(n) for p, n in zip(chances, names)), F.lit(0.0))
    left = scratch.write(now.where(lost > allowed()), "unsettled")
    return left if left.limit(1).count() else None


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def promising(threshold: float):
    """For each leaf the parts of it that sketches connect: (list, root, id), root being the part's first id."""
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, roots, members = [], [], []
        for part in runs(batches, "list"):
            part = part.combine_chunks().to_batches()[0]
            ids, s = part.column("id").to_numpy(), matrix(part, "low", np.uint8)
            groups, step = Union(len(ids)), max(1, (1 << 22) // (COMPARED * len(ids)))
            for lo in range(0, len(ids), step):
                same = (s[lo : lo + step, None, :] == s[None, lo:, :]).sum(axis=2, dtype=np.uint8)
                for i, j in zip(*np.nonzero(same >= least)):
                    if i < j:
                        groups.join(lo + int(i), lo + int(j))
            of = [groups.root(i) for i in range(len(ids))]
            size = np.bincount(of, minlength=len(ids))
            at = [i for i in range(len(ids)) if size[of[i]] > 1]
            if at:
                key = part.column("list")[0].as_py()
                lists += [key ^ (of[i] * 0x5DEECE66D) for i in at]
                roots += [ids[of[i]] for i in at]
                members += [ids[i] for i in at]
            if len(lists) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lists, roots, members)], ["list", "root", "id"])
                lists, roots, members = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lists, roots, members)], ["list", "root", "id"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return len(a) > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; only shingles that two sets share take part, a stretch of them at a time."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(starts) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(number, (lo, lo + 4096))
        member = np.zeros((len(sets), 4096), dtype=np.float32)
        member[owner[a:b], number[a:b] - lo] = 1
        out += member @ member.T
    return out


def connect(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first one of its component under links within the list."""
    n = len(sets)
    if n <= FEW:
        groups = Union(n)
        for j in range(1, n):
            for i in range(j):
                if groups.root(i) != groups.root(j) and linked(sets[i], sets[j], percent):
                    groups.join(i, j)
        return [groups.root(i) for i in range(n)]
    both, size = intersections(sets), np.array([len(x) for x in sets])
    near = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (size > 0)[:, None] & (size > 0)[None, :]
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(near, root[None, :], n).min(axis=1))
        if (low == root).all():
            return root.tolist()
        root = low


def confirm(percent: int):
    """Links that connect each list as its full sets do: at most one fewer than its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, a, b = Shingler(), [], []
        for part in runs(batches, "list"):
            ids = part.column("id").to_pylist()
            root = connect([shingle(x.as_py()) for x in part.column("text")], percent)
            at = [i for i in range(len(ids)) if root[i] != i and ids[i] != ids[root[i]]]
            a += [ids[root[i]] for i in at]
            b += [ids[i] for i in at]
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def by_id(scratch: Scratch, rows: DataFrame, value: str, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, value) joined with other on id, and the table it is read from. An id's values, as many as the trees' choices
    make, go through the join as one row; they are written first, so that their size is known and other stays where it is
    if they are few."""
    each = scratch.write(rows.groupBy("id").agg(F.collect_list(value).alias(f"{value}s")), "each")
    return each, each.join(other, "id").withColumn(value, F.explode(f"{value}s")).drop(f"{value}s")


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; links are 100 * intersection >= percent * union."""
    spark, threshold = docs.sparkSession, percent / 100
    scratch, n_parts = Scratch(spark, "near"), partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = scratch.write(rows.mapInArrow(sketches, SKETCHES), "sketches")
    classes = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("wide", "low", "sketch")])
    classes = scratch.write(classes, "classes")
    own = scratch.write(made.select("doc_id", "n_shingles", "h1", "h2"), "own")
    scratch.drop(made)

    leaves, alike, still, done, more_trees = None, None, None, 0, first_trees(threshold)
    both = lambda x, y: x if y is None else y if x is None else x.unionByName(y)
    while True:
        part = classes if still is None else scratch.write(classes.join(still.select("id"), "id", "left_semi"), "classes")
        found, found_alike, deep, spent = grow(scratch, part, range(done, done + more_trees), LEAF)
        leaves, alike = both(leaves, found), both(alike, found_alike)
        still = unsettled(scratch, still, deep, more_trees, threshold)
        for x in spent:
            scratch.drop(x)
        if still is None:
            break
        done, more_trees = done + more_trees, MORE_TREES if not done else 2 * more_trees

    # leaves of equal members, from other trees or choices, are compared once
    members = leaves.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    lists = members.select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("id"))
    near = by_id(scratch, lists, "list", classes.select("id", "low"))[1].select("list", "id", "low").repartition(n_parts, "list").sortWithinPartitions("list", "id")
    maybe = scratch.write(near.mapInArrow(promising(threshold), "list long, root long, id long"), "maybe")
    clusters = components(scratch, maybe.select(F.col("root").alias("a"), F.col("id").alias("b")))
    sized = clusters.join(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    small = sized.where(F.col("size") <= LEAF).select(F.col("component").alias("list"), "id")
    large_ids = sized.where(F.col("size") > LEAF).select("id")
    todo = small.unionByName(maybe.join(large_ids, "id").select("list", "id").distinct())
    chunk = lambda key: F.pmod(F.xxhash64(key, "id"), F.ceil(F.col("n") / F.lit(float(LEAF))))
    if alike is not None:
        early = alike.withColumn("turn", F.row_number().over(W.partitionBy("id").orderBy("tree", "key"))).where(F.col("turn") <= PIVOT_TREES)
        blocks = early.select(F.xxhash64("key", chunk("key")).alias("list"), "id")
        is_pivot = F.pmod(F.xxhash64("id", "key", F.lit(1)), F.lit(1 << 30)) < F.lit(float(PIVOTS << 30)) / F.col("n")
        pivots = early.where(is_pivot).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(float(LEAF))) - 1)))
        todo = todo.unionByName(blocks).unionByName(pivots.select(F.xxhash64("key", "c").alias("list"), "id")).distinct()

    def links(lists: DataFrame) -> DataFrame:
        with_text = by_id(scratch, lists, "list", rows.select(F.col("doc_id").alias("id"), "text"))[1].select("list", "id", "text")
        return scratch.write(with_text.repartition(n_parts, "list").sortWithinPartitions("list", "id").mapInArrow(confirm(percent), "a long, b long"), "links")

    edges = links(todo)
    joined = components(scratch, edges)
    if alike is not None:
        # the sets of a node that aren't of its main component meet every set of the node
        at = alike.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        per = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
        nodes = per.where(F.col("all") > F.col("most")).withColumn("rest", F.col("all") - F.col("most"))
        open_ = scratch.write(at.join(nodes, "key").select("key", "id", "n", "rest", (F.col("component") != F.col("main")).alias("apart")), "open")
        if open_.limit(1).count():
            half = float(LEAF // 2)
            mine = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("rest") / F.lit(half)))
            theirs = F.pmod(F.xxhash64("key", "id"), F.ceil(F.col("n") / F.lit(half)))
            span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / F.lit(half)) - 1))
            apart = open_.where("apart").withColumn("x", mine).withColumn("y", span("n"))
            all_ = open_.withColumn("x", span("rest")).withColumn("y", theirs)
            again = apart.select(F.xxhash64("key", "x", "y").alias("list"), "id").unionByName(all_.select(F.xxhash64("key", "x", "y").alias("list"), "id")).distinct()
            more = links(again)
            if more.limit(1).count():
                joined = components(scratch, edges.unionByName(more))
    named = classes.select("h1", "h2", "id").join(joined, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    out = own.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
