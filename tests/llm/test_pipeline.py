"""Each stage on what the one before kept, against a plain version."""

from collections import Counter

import pytest

import corpus_pipeline
from blockloom.llm import decontamination, language, mixing, sharding
from tests.llm.fixtures import AWKWARD, documents, folder
from tests.llm.test_native_and_counts import check_shards
from tests.llm.test_pairs import closure, least_edits, shingles


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    own = spark.read.parquet(f"{sf}/documents.parquet")
    odd = documents(spark, AWKWARD + [None], start=10_000).select(own.columns)
    docs = own.unionByName(odd)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    kept = [spark.read.parquet(f"{root}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], str(root)).write.parquet(f"{root}/{i}")
        kept.append(spark.read.parquet(f"{root}/{i}"))
    return [k.collect() for k in kept], kept


def test_columns_stay(stages):
    _, frames = stages
    assert all(f.columns == frames[0].columns for f in frames[1:-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_language_keeps_documents_with_text(stages):
    before, after = stages[0][:2]
    kept = {r.doc_id for r in after}
    for r in before:
        letters = any(c.isalpha() for c in r.text or "")
        assert letters or r.doc_id not in kept
        assert r.doc_id in kept or not letters or r.doc_id >= 10_000
    assert language.REJECT_BELOW < 0.5


def test_one_document_of_each_group_stays(stages):
    before, after = stages[0][1:3]
    before = sorted(before, key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in before]
    roots = closure(len(before), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert sorted(r.doc_id for r in after) == sorted({before[i].doc_id for i in roots})


def test_no_item_stays(spark, sf, stages):
    before, after = stages[0][2:4]
    items = [decontamination.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = set()
    for r in before:
        t = decontamination.normalise(r.text or "")
        if any(p in t for p in items):
            held.add(r.doc_id)
    kept = {r.doc_id for r in after}
    assert held and not held & kept
    edits = {r.doc_id: min(least_edits(p, decontamination.normalise(r.text or "")) - len(p) // 20 for p in items) for r in before[::7]}
    assert all((r.doc_id in kept) == (edits[r.doc_id] > 0) for r in before[::7])


def test_mixture_emits_what_it_takes(stages):
    frames = stages[1]
    want = {r.doc_id: r.copies for r in mixing.with_copies(frames[3]).collect()}
    assert Counter(r.doc_id for r in stages[0][4]) == Counter({k: n for k, n in want.items() if n})


def test_shards_hold_every_row(stages):
    mixed, sharded = stages[0][4:6]
    assert Counter(mixed) == Counter(type(mixed[0])(*r[: len(mixed[0])]) for r in sharded) and stages[1][5].columns == [*stages[1][4].columns, "shard", "slot", "copy"]
    assert len({(r.doc_id, r.text, r.copy) for r in sharded}) == len(sharded)
    check_shards(sharded)


def test_shards_keep_awkward_rows(spark):
    rows = [(None, "a", 1), (None, "a", 2), (None, None, 3), (7, "b", 4), (7, "b", 5), (7, "c", 6), (8, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SLOT int")
    out = sharding.with_shards(df)
    assert out.columns == ["doc_id", "text", "SLOT", "shard", "slot_", "copy"]
    assert sorted(r.SLOT for r in out.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert sharding.with_shards(df.limit(0)).count() == 0


def test_empty_documents_pass_through(spark, stages, tmp_path):
    empty = stages[1][0].limit(0)
    d = folder(tmp_path, documents=empty, benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0
