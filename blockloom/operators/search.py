"""Bounded combinatorial search, one group of candidates at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, islice, permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES, FRAGMENTS, ORDERINGS = 20_000, 8, 2_000
#: Groups whose orderings are joined from a table: so many items at most, each so large; then positions stay below 63 bits.
LONGEST, WIDEST = 30, 1 << 30


class Budget:
    """Search steps that are left."""

    def __init__(self, nodes: int = NODES):
        self.left = nodes

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def subsets_of_size(sizes: list[int], k: int, target: int, exact: bool, budget: Budget) -> list[tuple[int, ...]]:
    """Index sets of k fragments whose sum is the target, or reaches it, tightest first. Fragments are tried from the
    largest down; a branch ends when even the largest or smallest that remain can't meet the target."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    v = [sizes[i] for i in order]
    total = [0]
    for x in v:
        total.append(total[-1] + x)
    found: list[tuple[int, ...]] = []

    def go(at: int, left: int, need: int, picked: tuple[int, ...]) -> None:
        if not budget.spend():
            return
        if left == 0:
            if need == 0 or (not exact and need < 0):
                found.append(tuple(sorted(order[i] for i in picked)))
            return
        for i in range(at, len(v) - left + 1):
            if total[i + left] - total[i] < need:
                return  # the largest that remain are too small
            if exact and total[-1] - total[len(v) - left] > need:
                return  # the smallest that remain are too large
            if exact and v[i] > need - (total[-1] - total[len(v) - left + 1] if left > 1 else 0):
                continue
            go(i + 1, left - 1, need - v[i], (*picked, i))

    go(0, k, target, ())
    return sorted(found, key=lambda s: (sum(sizes[i] for i in s), s))


def matching_subsets(sizes: list[int], target: int, exact: bool = True, most: int = FRAGMENTS, budget: Budget | None = None) -> list[tuple[int, ...]]:
    """The subsets of the least size that has any."""
    budget = budget or Budget()
    for k in range(1, min(len(sizes), most) + 1):
        if found := subsets_of_size(sizes, k, target, exact, budget):
            return found
    return []


def orderings(items: tuple, most: int = ORDERINGS) -> Iterator[tuple]:
    for n, p in enumerate(permutations(items)):
        if n == most:
            return
        yield p


def _ordering_table(tail: int, most: int) -> pa.Table:
    """For each number of items: its first most orderings, and the weight in each of each of its last tail items; no others
    change their place in these. A row of -1 is met by orderings that are made elsewhere."""
    rows = [(-1, "", False, *[0] * tail)]
    for n in range(LONGEST + 1):
        m = min(n, tail)
        head = [str(i + 1) for i in range(n - m)]
        for p in orderings(tuple(range(m)), most):
            weights = dict(zip(p, (1 << m - 1 - j for j in range(m))))
            rows.append((n, "-".join([*head, *(str(n - m + i + 1) for i in p)]), factorial(n) <= most, *(weights.get(i, 0) for i in range(tail))))
    fields = [("n", pa.int32()), ("ordering", pa.string()), ("complete", pa.bool_()), *((f"w{i}", pa.int64()) for i in range(tail))]
    return pa.Table.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], schema=pa.schema([pa.field(*f, nullable=False) for f in fields]))


def order_groups(groups: DataFrame, key: str, items: str, most: int = ORDERINGS) -> DataFrame:
    """From one row a group, with its items' values in an array: a row for each of the first most orderings, with the places
    from 1 joined by dashes, position (values weighted by powers of two, the last by one; null beyond 63 bits or where a value
    is null) and complete (false if the group has more orderings). Orderings come from a table of bounded size that is joined
    by the number of items. Groups of more items than it has, or of values whose position might need more than 63 bits, are
    ordered one by one, on the way to the join."""
    tail = next(m for m in count(1) if factorial(m) >= most)
    # without a table where it would be large: all groups are then ordered one by one
    longest = LONGEST if most <= ORDERINGS else -1
    numbers = [f"t{i}" for i in range(tail)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.bool_())
        names = [key, "n", "fixed", *numbers, "own", "own_position", "own_complete"]
        for batch in batches:
            known, values = pa.compute.greater_equal(batch.column("n"), 0), batch.column(items)
            short = batch.drop_columns([items]).filter(known)
            if short.num_rows:
                yield pa.RecordBatch.from_arrays([*short.columns, *(pa.nulls(short.num_rows, k) for k in kinds)], names)
            for g, v in zip(*(c.filter(pa.compute.invert(known)).to_pylist() for c in (batch.column(key), values))):
                found = orderings(tuple(range(len(v))), most)
                while some := list(islice(found, ORDERINGS)):
                    at = [None if None in v else sum(v[i] << len(p) - 1 - j for j, i in enumerate(p)) for p in some]
                    own = (["-".join(str(i + 1) for i in p) for p in some], [x if x is not None and abs(x) < 1 << 63 else None for x in at], [factorial(len(v)) <= most] * len(some))
                    zeros = pa.array([0] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(some), pa.int64()), pa.array([-1] * len(some), pa.int32()), *[zeros] * (tail + 1), *map(pa.array, own, kinds)], names)

    q, n = F.col(items), F.size(items)
    small = F.coalesce((n <= longest) & F.forall(items, lambda x: F.coalesce(x.between(-WIDEST, WIDEST), F.lit(False))), F.lit(False))
    only = lambda x: F.coalesce(F.when(small, x), F.lit(0)).cast("long")
    m = F.least(n, F.lit(tail))
    fixed = F.when(n > tail, F.aggregate(F.slice(items, 1, n - m), F.lit(0).cast("long"), lambda a, x: a * 2 + x) * (1 << tail))
    last = [only(F.get(q, n - m + i)).alias(t) for i, t in enumerate(numbers)]
    dealt = groups.select(F.col(key).cast("long").alias(key), F.when(small, n).otherwise(-1).alias("n"), only(fixed).alias("fixed"), *last, F.when(~small, q).alias(items))
    columns = ", ".join(f"{c} long NOT NULL" for c in ("fixed", *numbers))
    dealt = dealt.mapInArrow(run, f"{key} long, n int NOT NULL, {columns}, own string, own_position long, own_complete boolean")
    each = dealt.join(F.broadcast(groups.sparkSession.createDataFrame(_ordering_table(tail, most if longest > 0 else 0))), "n")
    position = sum((F.col(t) * F.col(f"w{i}") for i, t in enumerate(numbers)), F.col("fixed"))
    return each.select(key, F.coalesce("own", "ordering").alias("ordering"), F.when(F.col("n") < 0, F.col("own_position")).otherwise(position).alias("position"), F.coalesce("own_complete", "complete").alias("complete"))


def search_groups(groups: DataFrame, key: str, sizes: str, target: int, exact: bool = True, most: int = FRAGMENTS, nodes: int = NODES) -> DataFrame:
    """From one row a group, with its sizes in an array: key, k (fragments in the least subset), subsets (how many) and
    reason. Groups come in Arrow batches, many to a call; those without a match give no row. A group whose search takes
    more than nodes steps gives a row with a reason instead of a count that may be partial."""

    def search(g: int, s: list[int]) -> Iterator[tuple]:
        found = matching_subsets(s, target, exact, most, budget := Budget(nodes))
        if budget.left < 0:
            yield g, None, None, "search budget spent"
        elif found:
            yield g, len(found[0]), len(found), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in search(g, s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], [key, "k", "subsets", "reason"])

    return groups.select(key, sizes).mapInArrow(run, f"{key} long, k int, subsets long, reason string")
