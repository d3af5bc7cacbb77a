import importlib.util
import random
import sys
from itertools import combinations, islice, permutations
from math import factorial

import pytest

import __spark_entry__ as entry
from blockloom.operators.search import order_groups, search_groups
from blockloom.plans import registered
from tests.compare import same

QUERIES, ORACLES = registered()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    got, want = same(spark, sf, QUERIES[name], ORACLES[name])
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("gone", ["blockloom.llm", "corpus_pipeline", "xxhash"])
def test_entry_without_text_operators(monkeypatch, gone):
    """Whatever of the text operators can't be imported, the other queries are there."""
    for name in [n for n in sys.modules if n.startswith(("blockloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    spec = importlib.util.spec_from_file_location("fresh_entry", entry.__file__)
    fresh = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(fresh)
    assert fresh.queries() == QUERIES and fresh.oracle_sql() == ORACLES


def test_utf16_round_trip(spark, sf):
    rows = QUERIES["q_utf16"](spark, sf).collect()
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert all(r.back == names[r.p_partkey] and bytes.fromhex(r.data) == names[r.p_partkey].encode("utf-16-be").ljust(80, b"\0") for r in rows)


def test_orderings_equal_brute_force(spark, tmp_path):
    orders = {n: [(3 * i + n) % 7 + 1 for i in range(n)] for n in range(1, 8)} | {70: [50] * 70}
    rows = [(o, i, 1, 1, 1.0, float(q)) for o, s in orders.items() for i, q in enumerate(s)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in QUERIES["q_orderings"](spark, str(tmp_path)).collect() if r.l_orderkey < 7)
    want = [(o, "-".join(str(i + 1) for i in p), sum(s[i] * 2 ** (len(s) - 1 - j) for j, i in enumerate(p)), True) for o, s in orders.items() if o < 7 for p in permutations(range(len(s)))]
    assert got == sorted(want)
    cut = [r for r in QUERIES["q_orderings"](spark, str(tmp_path)).collect() if r.l_orderkey >= 7]
    assert len(cut) == 4000 and not any(r.complete for r in cut) and all(r.position is None for r in cut if r.l_orderkey == 70)


def test_orderings_are_joined_and_equal_brute_force(spark, tmp_path):
    """Rows are made by a join, not one by one in Python, whatever the number of items; long groups and values beyond the table's are exact too."""
    rng = random.Random(4)
    groups = {n: [rng.randint(-50, 50) for _ in range(n)] for n in (*range(13), 29, 30, 31, 40)}
    groups |= {100: [1 << 30] * 30, 101: [(1 << 30) + 1, -5, 7], 102: [-(1 << 30)] * 9, 103: [1 << 62, 1 << 61], 104: [1 << 62, -(1 << 62), (1 << 61) - 1], 105: [3, None, 4], 106: [5] * 62, 107: [-1] + [0] * 63}
    df = spark.createDataFrame(list(groups.items()), "g long, q array<long>")
    for most in (0, 1, 2, 7, 2000, 2001):
        got = sorted(map(tuple, order_groups(df, "g", "q", most).collect()), key=repr)
        want = []
        for g, s in groups.items():
            for p in islice(permutations(range(len(s))), most):
                x = None if None in s else sum(s[i] << len(s) - 1 - j for j, i in enumerate(p))
                want.append((g, "-".join(str(i + 1) for i in p), x if x is not None and -(1 << 63) < x < 1 << 63 else None, factorial(len(s)) <= most))
        assert got == sorted(want, key=repr), most
    spark.createDataFrame([(o, i, 1, 1, 1.0, 2.0) for o in range(9) for i in range(o + 1)], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = QUERIES["q_orderings"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("BroadcastHashJoin") < plan.index("MapInArrow") and plan.count("collect_list") == 2  # partial and final


def test_every_block_and_boundary_is_looked_up(spark, tmp_path):
    texts = ["", "a", "b" * 4096, "c" * 4097, "d" * 30_000, "", "e" * 2048, "f" * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    owner = [i for i, t in enumerate(texts) for _ in range(max(1, -(-len(t) // 4096)))]
    assert sorted((r.block, r.doc_id) for r in QUERIES["q_block_owners"](spark, str(tmp_path)).collect()) == list(enumerate(owner))
    whole, starts = [i for i, t in enumerate(texts) for _ in t], {}
    for p, i in enumerate(whole):
        starts.setdefault(i, p)
    points = {p for p in range(0, len(whole), 2048)} | {p for i, p in starts.items()} | {p + len(texts[i]) - 1 for i, p in starts.items()}
    got = sorted((r.point, r.doc_id, r.inside) for r in QUERIES["q_locate_boundaries"](spark, str(tmp_path)).collect())
    assert got == [(p, whole[p], p - starts[whole[p]]) for p in sorted(points)]


def test_subset_search_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    orders = {o: [rng.randint(1, 40) for _ in range(rng.randint(1, 9))] for o in range(60)}
    orders |= {100: [15] * 4, 101: [12] * 5, 102: [10] * 6, 103: [7, 7, 7, 7, 8, 8, 8, 8], 104: [1] * 70, 105: [2] * 29 + [1] * 29}
    spark.createDataFrame([(o, float(q)) for o, s in orders.items() for q in s], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: (r.k, r.subsets, r.reason) for r in QUERIES["q_subset_search"](spark, str(tmp_path)).collect()}
    want = {}
    for o, s in orders.items():
        for k in range(1, min(len(s), 8) + 1) if len(s) < 10 else ():
            if n := sum(sum(c) == 60 for c in combinations(s, k)):
                want[o] = (k, n, None)
                break
    assert {o: r for o, r in got.items() if o < 104} == want and {k for k, _, _ in want.values()} >= {2, 3, 4, 5, 6, 8}
    assert 104 not in got and 105 not in got  # sums of 8 lines stay below 60
    many = spark.createDataFrame([(1, [3, 2, 1] * 30)], "o long, sizes array<long>")
    assert [tuple(r) for r in search_groups(many, "o", "sizes", 17).collect()] == [(1, None, None, "search budget spent")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
