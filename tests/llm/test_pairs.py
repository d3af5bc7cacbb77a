import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import decontamination, embedding_dedup, near_dedup, suffix_dedup
from tests.llm.fixtures import AWKWARD, documents, folder


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def closure(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def copies(seed=1, families=12, alone=40, group=130):
    """Families of edited texts, one of them larger than a leaf, and unrelated texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage, texts = " ".join(word() for _ in range(40)), []
    for f in range(families):
        base = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(group if f == 0 else rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [f"{' '.join(word() for _ in range(60))} {passage}" for _ in range(alone)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("leaf", [near_dedup.LEAF, 24])
def test_op4_equals_brute_force(spark, tmp_path, monkeypatch, leaf):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)  # small leaves: nodes of copies are compared in blocks
    texts = AWKWARD + copies() + ["A b C d E", "a B c D e"]
    sets = [shingles(t) for t in texts]
    want = closure(len(texts), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    d = folder(tmp_path, documents=documents(spark, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op4_near_dedup(spark, d).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}


def test_op4_empty_and_null_ids(spark):
    df = documents(spark, ["a b c"])
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    rows = near_dedup.near_duplicates(df.union(df).union(df.selectExpr("CAST(NULL AS BIGINT)", *df.columns[1:]))).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in sorted(rows, key=lambda r: (r.doc_id is None))] == [(0, 0, True), (0, 0, True), (None, None, True)]


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("choices", [1, 2, 3, 6])
def test_op4_links_survive(percent, choices):
    """Pairs at the threshold whose nodes stay large for so many choices, in as many trees as are reckoned for them: the
    lost are no more than the recall allows, give or take what a sample of this size does."""
    rng, n, pairs, threshold = np.random.default_rng(percent + choices), 400, 2000, percent / 100
    apart = n * (100 - percent) // 100
    sets = [near_dedup.mix(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(pairs)]
    made = [[near_dedup.sketch(s[part]) for s in sets] for part in (slice(apart // 2, None), slice(None, n - apart + apart // 2))]
    wide, deep = ([np.stack([np.frombuffer(m[i], kind) for m in side]) for side in made] for i, kind in ((0, np.uint32), (2, np.uint16)))
    logs, chances = near_dedup.parted(threshold), [p for p, _ in near_dedup.cases(threshold)]
    trees = near_dedup.first_trees(threshold) if choices == 1 else next(t for t in range(1, 999) if sum(p * np.exp(t * x[choices - 1]) for p, x in zip(chances, logs)) <= near_dedup.allowed())
    met = np.zeros(pairs, dtype=bool)
    for t in range(trees):
        at = np.flatnonzero(wide[0][:, t % near_dedup.TREES] == wide[1][:, t % near_dedup.TREES])
        keys = near_dedup.child(np.full(len(at), t, np.uint64), np.full(len(at), t), wide[0][at, t % near_dedup.TREES])
        for c in range(2, choices + 1):
            one, rows = near_dedup.branch(keys, deep[0][at], c > near_dedup.PLAIN)
            other, _ = near_dedup.branch(keys, deep[1][at], c > near_dedup.PLAIN)  # the choices hang on the key alone, so both have the same
            keys, at = one[one == other], at[rows[one == other]]
        met[at] = True
    assert pairs - met.sum() <= 1


def test_op4_reckons_with_its_choices():
    assert 1 + 2 * (near_dedup.ROUNDS - 1) == near_dedup.DEPTH
    for s in (0.8, 0.85, 0.95):
        assert (1 - s) ** near_dedup.first_trees(s) <= near_dedup.allowed()
        assert sum(near_dedup.agreement(s, near_dedup.COMPARED)[: near_dedup.least_agreement(s)]) + near_dedup.allowed() <= 1 - near_dedup.RECALL + 1e-12
        assert abs(sum(p for p, _ in near_dedup.cases(s)) - 1) < 1e-9
        assert near_dedup.survival(s, 1) == s and near_dedup.survival(s, 2) == s * s and near_dedup.survival(s, 9) < near_dedup.survival(s, 3)


def test_op4_sets_of_large_nodes_get_more_trees(spark, monkeypatch):
    """With small leaves, sets that share a common passage go on beyond the first trees; those alone don't."""
    monkeypatch.setattr(near_dedup, "LEAF", 24)
    asked = []
    grow = near_dedup.grow
    monkeypatch.setattr(near_dedup, "grow", lambda scratch, sets, trees, leaf: asked.append((trees, sets.count())) or grow(scratch, sets, trees, leaf))
    near_dedup.near_duplicates(documents(spark, copies())).count()
    assert len(asked) > 1 and asked[0][0] == range(near_dedup.first_trees(0.85)) and asked[1][1] < asked[0][1]
    assert all(a[0].stop == b[0].start for a, b in zip(asked, asked[1:]))


def test_intersections_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 5000, 8000, 8000)]
    got = near_dedup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(6) for j in range(6) if i != j)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", min_size=1, max_size=12), st.integers(0, 5))
def test_myers_equals_dynamic_programming(text, pattern, most):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    best = min(row[1:], default=len(pattern))
    got = decontamination.myers(pattern, text, most)
    assert (got[0] if got else None) == (best if min(best, len(pattern)) <= most and text and best <= most else None)


def plain(text):
    return " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def least_edits(pattern, text):
    """Least edit distance of pattern to any part of text, by a table of all its prefixes and all places of the text."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    row = np.zeros(len(codes) + 1, dtype=np.int64)
    step = np.arange(len(codes) + 1)
    for i, c in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step  # a step to the right costs one
    return int(row.min())


def test_op2_bitmap_holds_every_gram(spark):
    grams = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 500)
    bits = decontamination.bitmap(spark.createDataFrame([(int(g),) for g in grams], "gram long"), 1 << 22)
    places = [(int(g) % (1 << 64) >> k) % (1 << 22) for g in grams for k in decontamination.SHIFTS]
    assert {i for i in np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()} == set(places)


def test_op2_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 40))) for _ in range(20)]
    items += ["the cat", "word", "é ß", "cat sat on the mat", "x", "nineteen characters", "twenty characters ab", "bed fad cab deaf head abc", "!? ", items[0]]
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    texts = list(AWKWARD) + [items[3][: len(items[3]) // 20 * 19], "sword", "a word", "\0word\0", " ".join(items) * 3 + filler() * 1500 + items[5]]
    for item in items:
        for edits in (0, 2, 30):
            w = list(item)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(f"{filler()} {''.join(w).upper()}! {filler()}")
    texts += [filler() for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    d = folder(tmp_path, documents=documents(spark, texts), benchmark=bench)
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.op2_decontamination(spark, d).collect()}
    want = {}
    for i, t in enumerate(texts):
        n = plain(t)
        for k, item in enumerate(items):
            p = plain(item)
            if len(p) < 20:
                if p and f" {p} " in f" {n} ":
                    want[i, k] = 0
            elif (least := least_edits(p, n)) <= len(p) // 20:
                want[i, k] = least
    assert got == want and len(want) >= 40
    assert all(decontamination.normalise(items[r.item_id]) == plain(texts[r.doc_id])[: r.end][-len(plain(items[r.item_id])) :] for r in decontamination.op2_decontamination(spark, d).where("distance = 0").collect())
    odd = spark.createDataFrame([(1, items[0], 5), (1, "clean", 6), (None, items[0], 7), (None, "clean", 8), (None, None, 9)], "doc_id long, text string, same long")
    assert sorted(r.same for r in decontamination.without_items(odd, bench).collect()) == [6, 8, 9]
    clean = decontamination.without_items(spark.read.parquet(f"{d}/documents.parquet"), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontamination.find_items(documents(spark, texts).limit(0), bench).count() == 0
    assert decontamination.find_items(documents(spark, texts), bench.limit(0)).count() == 0


def test_op9_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(24)
        for _ in range(900 if c == 0 else rng.integers(1, 8)):
            rows.append((centre + rng.standard_normal(24) * 0.16).astype(np.float32).tolist())
    rows += rows[:5] + [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    labels = [None if i % 50 == 49 else 0 if i < 900 else i % 3 for i in range(len(rows))]
    df = spark.createDataFrame([(i, v, g, -1) for i, (v, g) in enumerate(zip(rows, labels))], "vec_id long, embedding array<float>, label int, n_links int")
    ok = [g is not None and bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v) for v, g in zip(rows, labels)]
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if o else None for v, o in zip(rows, ok)]
    linked = np.zeros((len(rows), len(rows)), dtype=bool)
    for g in {(labels[i], len(rows[i])) for i in range(len(rows)) if ok[i]}:
        at = [i for i in range(len(rows)) if ok[i] and (labels[i], len(rows[i])) == g]
        x = np.stack([unit[i] for i in at])
        linked[np.ix_(at, at)] = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    d = folder(tmp_path, embeddings=df)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.op9_embedding_dedup(spark, d).collect()}
    found, true = sum(n for n, _ in got.values()), int(linked.sum())
    assert all(got[i][0] <= linked[i].sum() for i in got) and found >= 0.99 * true > 1000
    comps = closure(len(rows), lambda i, j: linked[i, j])
    assert np.mean([got[i][1] == comps[i] for i in got]) > 0.99
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def removed(texts):
    data = {i: (t or "").encode() for i, t in enumerate(texts)}
    seen = defaultdict(list)
    for i, b in data.items():
        for p in range(len(b) - 199):
            seen[b[p : p + 200]].append((i, p))
    marks = {i: bytearray(len(b)) for i, b in data.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                marks[i][p : p + 200] = b"\1" * 200
    out = {}
    for i, b in data.items():
        m = marks[i]
        kept = bytes(x for x, k in zip(b, m) if not k)
        out[i] = (len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_op10_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(12)]
    line = "this line of one hundred and fifty bytes or so is in every text but is too short alone " * 2
    texts = list(AWKWARD[:7]) + ["y" * 900, "the cat sat. " * 100, None, ""]
    for _ in range(60):
        cut = lambda p: p[rng.randrange(len(p) // 2 + 1) :][: rng.randint(50, 700)]
        texts.append(" ".join(rng.choice([word() + " " + word(), cut(rng.choice(passages)), line[:150], "Z"]) for _ in range(rng.randint(1, 9))))
    texts += [texts[-1], texts[-1], "q" * 199]
    d = folder(tmp_path, documents=documents(spark, texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10_suffix_dedup(spark, d).collect()}
    assert got == removed(texts)


@pytest.mark.parametrize("crowd", [1, 20_000])
def test_op10_crowded_grams_and_awkward_ids(spark, crowd):
    """Grams of many anchors are counted by whole spans; ids may be null, repeat or be too large for a double."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    tail = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 400)))
    texts = [tail() + passage[rng.randrange(300) :][: rng.randint(150, 600)] + tail() for _ in range(40)] + ["ab" * 300, "short", None]
    texts += texts[:3]
    ids = [None, None, 7, 7, (1 << 53) + 1, (1 << 53) + 2, *range(100, 100 + len(texts) - 6)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, crowd=crowd).collect())
    assert got == Counter((i, *removed(texts)[n]) for n, i in enumerate(ids))


def test_op10_empty(spark):
    assert suffix_dedup.remove_repeats(documents(spark, ["x"]).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=6, max_size=6), max_size=6), min_size=1, max_size=5))
def test_loser_tree_sorts_and_knows_prefixes(runs):
    made = []
    for r in runs:
        coded, last = [], b""
        for s in sorted(x.encode() for x in r):
            coded.append((suffix_dedup.shared(last, s) if last else 0, s))
            last = s
        made.append(coded)
    out = [(h, item[1]) for h, item in suffix_dedup.LoserTree(made)]
    assert [s for _, s in out] == sorted(x.encode() for r in runs for x in r)
    assert all(h == suffix_dedup.shared(a, b) for (_, a), (h, b) in zip(out, out[1:]))


def test_anchor_pieces_agree(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000, dtype=np.uint8)
    whole = suffix_dedup.anchors(data)[0]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert (suffix_dedup.anchors(data)[0] == whole).all()
    assert np.diff(np.concatenate(([-1], whole))).max() <= suffix_dedup.SPAN - suffix_dedup.K + 1
