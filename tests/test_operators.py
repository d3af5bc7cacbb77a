import hashlib
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.operators import blocks, layout, paths, search, trees


def test_blocks_of_awkward_payloads(spark):
    df = spark.createDataFrame([(1, b""), (2, None), (3, b"x" * 1024), (4, b"y" * 1025)], "id int, payload binary")
    got = sorted((r.id, r.block_no, len(r.block)) for r in blocks.split_blocks(df, "payload", 512).collect())
    assert got == [(3, 0, 512), (3, 1, 512), (4, 0, 512), (4, 1, 512), (4, 2, 1)]


def test_hash_rollup_levels(spark):
    data = bytes(range(256)) * 600
    df = spark.createDataFrame([(1, data)], "id int, payload binary")
    b = blocks.split_blocks(df, "payload", 512).withColumn("sha1", F.sha1("block"))
    pieces = [hashlib.sha1(data[i : i + 512]).digest() for i in range(0, len(data), 512)]
    subs = [hashlib.sha1(b"".join(pieces[i : i + 204]).ljust(4096, b"\0")).digest() for i in range(0, len(pieces), 204)]
    want = hashlib.sha1(b"".join(subs).ljust(4096, b"\0")).hexdigest()
    for n in (1, 2, 8):
        row = blocks.hash_rollup(b.repartition(n), ["id"]).first()
        assert (row.master, row.n_blocks) == (want, len(pieces))


def test_hash_rollup_beyond_one_upper_list(spark):
    """All blocks enter the digest: lists of 204 as one part, more in parts of 203 that chain as in write_god."""
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    for n in (204 * 204, 204 * 204 + 1, 204 * 203 * 2 + 5):
        pieces = [bytes.fromhex(digest(i)) for i in range(n)]
        subs = [hashlib.sha1(b"".join(pieces[i : i + 204]).ljust(4096, b"\0")).digest() for i in range(0, n, 204)]
        parts = [subs] if len(subs) <= 204 else [subs[i : i + 203] for i in range(0, len(subs), 203)]
        want = b""
        for p in reversed(parts):
            want = hashlib.sha1((b"".join(p) + want).ljust(4096, b"\0")).digest()
        b = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("block_no"), F.sha1(F.col("id").cast("string").cast("binary")).alias("sha1"))
        row = blocks.hash_rollup(b, ["doc"]).first()
        assert (row.master, row.n_blocks) == (want.hex(), n)


def test_greedy_boundary(spark):
    """A part is closed once it is above its cap, or at it; batches and streams of any length."""
    rows = [("a", k, n) for k, n in enumerate((5, 5, 1, 20, 1, 0))] + [(None, 0, 30), (None, 1, 1), ("z", 0, None)]
    rows += [("long", k, k * 7 % 13) for k in range(25_000)]
    df = spark.createDataFrame(rows, "id string, k int, size long").repartition(3)
    for at_cap in (False, True):
        got = {(r.id, r.k): r.part_no for r in layout.greedy_split(df, "id", ["k"], "size", 10, at_cap).collect()}
        want, used, part, last = {}, 0, 0, 0
        for i, k, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            if k == 0:
                used, part = 0, 0
            if used > 10 or (at_cap and used == 10):
                used, part = 0, part + 1
            want[(i, k)] = part
            used += n or 0
        assert got == want
    assert [want[("a", k)] for k in range(6)] == [0, 0, 1, 1, 2, 2]


def test_global_offset_of_sparse_keys(spark):
    keys = [(k * 0x9E3779B97F4A7C15) % (1 << 63) for k in range(1000)] + [0, 1, (1 << 63) - 1]
    df = spark.createDataFrame([(k, i % 5) for i, k in enumerate(keys)], "id long, v long")
    want, total = {}, 0
    for k, v in sorted((k, i % 5) for i, k in enumerate(keys)):
        want[k], total = total, total + v
    assert {r.id: r.o for r in layout.global_offset(df, "id", "v", "o").collect()} == want


def test_global_offset_is_partition_invariant(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    want, total = {}, 0
    for i in range(5000):
        want[i] = total
        total += i % 7
    for n in (1, 8):
        assert {r.id: r.o for r in layout.global_offset(df.repartition(n), "id", "v", "o", 100).collect()} == want


def test_rechunk(spark):
    rows = [("a", 0, b"abc"), ("a", 1, b""), ("a", 2, None), ("a", 3, bytes(range(200))), ("a", 4, b"z"), ("b", 0, b"12345678"), ("c", 0, None)]
    got = {(r.g, r.chunk_no): bytes(r.block) for r in blocks.rechunk(spark.createDataFrame(rows, "g string, k int, p binary"), ["g"], "k", "p", 8).collect()}
    whole = {g: b"".join(p or b"" for x, _, p in rows if x == g) for g in "abc"}
    assert got == {(g, i // 8): w[i : i + 8] for g, w in whole.items() for i in range(0, len(w), 8)}


def test_build_paths_reports_cycles_and_orphans(spark):
    rows = [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("o", "gone", "O"), ("p", "o", "P")]
    got = {r.id: (r.path, r.reason) for r in trees.build_paths(spark.createDataFrame(rows, "id string, parent string, name string"), 8).collect()}
    assert got["c"] == ("A/B/C", None) and got["x"] == (None, "cycle or too deep") and got["o"] == (None, "parent missing") == got["p"]


def test_paths(spark):
    df = spark.createDataFrame([("\\\\a/b\\c.12",), ("x",)], "p string")
    assert [r[0] for r in df.select(paths.normalise(F.col("p"))).collect()] == ["a/b/c.12", "x"]
    assert [r[0] for r in df.select(paths.number_at_end(F.col("p"))).collect()] == [12, None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=8), st.integers(1, 30), st.booleans())
def test_subset_search_equals_brute_force(sizes, target, exact):
    want = []
    for k in range(1, len(sizes) + 1):
        want = [c for c in combinations(range(len(sizes)), k) if (sum(sizes[i] for i in c) == target if exact else sum(sizes[i] for i in c) >= target)]
        if want:
            break
    assert sorted(search.matching_subsets(sizes, target, exact, budget=search.Budget(10**6))) == sorted(want)


def test_subset_search_is_bounded():
    budget = search.Budget()
    assert search.matching_subsets([1000] * 300, 999_999, budget=budget) == []
    assert search.NODES - budget.left < 100
