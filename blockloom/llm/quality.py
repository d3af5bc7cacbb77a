"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are column expressions. Small trees are grown on a bounded sample of labelled statistics; every
path from a root to a node is a rule, a conjunction of comparisons. A logistic model over rules and clipped linear
terms is fitted with an L1 penalty, which leaves few rules with weight, and these become one column expression. Only
statistics of the sample come to the driver, never texts.

Null text counts as empty; an empty text gets the score its zero statistics earn. Without labels of both kinds the score
is the share of label 1 among those there are (0.5 without any). Labels that repeat an id are so many examples; null
labels are left out. Repeated rows and ties get equal scores. Only the text's column is read; no label, language,
source or id enters a score."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import held_out, table

#: At most so many labelled documents are learned from, those of the smallest hashes.
SAMPLE = 12_000
TREES, DEPTH, LEAF, L1, SEED = 24, 3, 25, 0.002, 3


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")


def pieces(text: str) -> dict[str, Column]:
    """What the statistics are made of; each is reckoned once."""
    t = F.col(text)
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    return {
        "_chars": F.length(t).cast("double"),
        "_words": F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(t, r"\n"), lambda x: x != ""),
        "_no_upper": without(r"\p{Lu}+"),
        "_no_letter": without(r"\p{L}+"),
        "_no_digit": without(r"\p{Nd}+"),
        "_no_mark": without(r"[#$%&*|@~^_<>{}=+\\\[\]/]+"),
        "_no_shout": without(r"[!?]+"),
        "_no_stop": without(r"[.,;:]+"),
    }


def statistics() -> dict[str, Column]:
    c = F.col
    n = F.size("_words").cast("double")
    return {
        "length": F.log1p("_chars"),
        "words": F.log1p(n),
        "word_length": share(c("_chars"), n + 1),
        "distinct": share(F.size(F.array_distinct("_words")).cast("double"), n),
        "lines": share(F.size("_lines").cast("double"), n + 1),
        "distinct_lines": share(F.size(F.array_distinct("_lines")).cast("double"), F.size("_lines").cast("double")),
        "upper": share(c("_chars") - c("_no_upper"), c("_chars") - c("_no_letter")),
        "letters": share(c("_chars") - c("_no_letter"), c("_chars")),
        "digits": share(c("_chars") - c("_no_digit"), c("_chars")),
        "marks": share(c("_chars") - c("_no_mark"), c("_chars")),
        "shouts": share(c("_chars") - c("_no_shout"), c("_chars")),
        "stops": share(c("_chars") - c("_no_stop"), c("_chars")),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct _statistics; the pieces are dropped again."""
    t = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return t.withColumns(pieces("_text")).withColumn("_statistics", F.struct(*[x.alias(k) for k, x in statistics().items()])).drop("_text", *pieces("_text"))


@dataclass
class Model:
    names: list[str]
    bias: float
    #: (weight, ((statistic, above, threshold), ...)): 1 where all comparisons hold
    rules: list[tuple[float, tuple]] = field(default_factory=list)
    #: (weight, statistic, low, high, mean, scale)
    linear: list[tuple] = field(default_factory=list)

    def column(self, at: str = "_statistics") -> Column:
        total = F.lit(self.bias)
        for w, tests in self.rules:
            held = None
            for name, above, cut in tests:
                x = F.col(f"{at}.{name}")
                one = x > cut if above else x <= cut
                held = one if held is None else held & one
            total = total + F.when(held, F.lit(w)).otherwise(0.0)
        for w, name, low, high, mean, scale in self.linear:
            total = total + F.lit(w) * (F.least(F.greatest(F.col(f"{at}.{name}"), F.lit(low)), F.lit(high)) - mean) / scale
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same law in numpy, for tests."""
        at = {n: i for i, n in enumerate(self.names)}
        total = np.full(len(x), self.bias)
        for w, tests in self.rules:
            total += w * np.all([(x[:, at[n]] > cut) == above for n, above, cut in tests], axis=0)
        for w, n, low, high, mean, scale in self.linear:
            total += w * (np.clip(x[:, at[n]], low, high) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, g: np.ndarray, depth: int, leaf: int, path: tuple, out: list, tried: np.ndarray) -> np.ndarray:
    """A regression tree for g; appends every path to out and returns the fitted values."""
    if path:
        out.append(path)
    best = (1e-12, None, None)
    if depth and len(g) >= 2 * leaf:
        for j in tried:
            order = np.argsort(x[:, j], kind="stable")
            v, total = x[order, j], np.cumsum(g[order])
            k = np.arange(leaf, len(g) - leaf + 1)
            k = k[v[k - 1] < v[np.minimum(k, len(g) - 1)]] if len(k) else k
            k = k[k < len(g)]
            if len(k):
                left = total[k - 1]
                gain = left**2 / k + (total[-1] - left) ** 2 / (len(g) - k) - total[-1] ** 2 / len(g)
                if gain.max() > best[0]:
                    i = k[int(gain.argmax())]
                    best = (float(gain.max()), int(j), float((v[i - 1] + v[i]) / 2))
    _, j, cut = best
    if j is None:
        return np.full(len(g), g.mean() if len(g) else 0.0)
    fitted, up = np.empty(len(g)), x[:, j] > cut
    for side in (False, True):
        fitted[up == side] = grow(x[up == side], g[up == side], depth - 1, leaf, (*path, (j, side, cut)), out, tried)
    return fitted


def lasso(z: np.ndarray, y: np.ndarray, l1: float, turns: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty by accelerated proximal steps; the bias is free."""
    n, d = z.shape
    full = np.column_stack([np.ones(n), z])
    v = np.ones(d + 1)
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (full.T @ (full @ v)))
    w = np.zeros(d + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(turns):
        grad = full.T @ (1 / (1 + np.exp(-full @ ahead)) - y) / n
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, l1: float = L1) -> Model:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model(names, float(np.log(p / (1 - p))))
    rng, leaf = np.random.default_rng(SEED), min(leaf, max(2, len(y) // 20))
    paths: list[tuple] = []
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):  # each tree is grown on half the rows, towards what the others leave
        rows = rng.random(len(y)) < 0.5
        g = y - 1 / (1 + np.exp(-score))
        tried = rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False)
        own: list[tuple] = []
        grow(x[rows], g[rows], depth, leaf, (), own, tried)
        paths += own
        for p in own:
            if len(p) == max(map(len, own)):
                held = np.all([(x[:, j] > cut) == side for j, side, cut in p], axis=0)
                score[held] += 1.5 * g[held].mean() if held.any() else 0
    paths = list(dict.fromkeys(paths))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    mean, scale = clipped.mean(0), np.maximum(clipped.std(0), 1e-9) / 0.4
    held = np.column_stack([np.all([(x[:, j] > cut) == side for j, side, cut in p], axis=0) for p in paths] or [np.zeros(len(y))]).astype(float)
    bias, w = lasso(np.column_stack([held, (clipped - mean) / scale]), y.astype(float), l1)
    k = len(paths)
    rules = [(float(w[i]), tuple((names[j], side, cut) for j, side, cut in p)) for i, p in enumerate(paths) if w[i]]
    linear = [(float(w[k + j]), names[j], float(low[j]), float(high[j]), float(mean[j]), float(scale[j])) for j in range(x.shape[1]) if k + j < len(w) and w[k + j]]
    return Model(names, bias, rules, linear)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    names = list(statistics())
    known = labels.where(~held_out(doc_id) & F.col("quality").isNotNull()).select(F.col(doc_id), F.col("quality").cast("int").alias("_quality"))
    known = known.orderBy(F.xxhash64(doc_id, F.lit(SEED)), doc_id, "_quality").limit(sample)  # bounded, so it may be broadcast
    rows = with_statistics(docs.select(doc_id, text).join(F.broadcast(known), doc_id), text).select(doc_id, "_quality", "_statistics.*").orderBy(doc_id, "_quality").limit(4 * sample).toPandas()
    return fit(rows[names].to_numpy(float), rows["_quality"].to_numpy(float), names)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_statistics(docs).select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
