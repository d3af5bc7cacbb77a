"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

A text is lower-cased and what isn't a letter becomes one space; its n-grams of 1 to 3 characters are hashed into
FEATURES bins. A bin's weight is its share of the text's n-grams times log((1 + documents) / (1 + documents with it)) + 1,
counted over all documents that may be learned from. A bounded sample, balanced over languages, trains the weights with
follow-the-regularised-leader steps under an elastic-net penalty; a tenth of it sets the temperature.

A text that is null or without a letter is `und`, score 0. Other texts get the likeliest learned language and its
calibrated probability. With nothing to learn from every text is `und`. Documents with null language aren't learned
from. Equal texts get equal answers. Columns other than those named are neither read nor changed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import held_out, table

FEATURES = 1 << 15
#: At most so many documents are trained on (about so many; a language's share is drawn by hash).
SAMPLE, EPOCHS, SEED = 2_400, 3, 7
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.0002
SCALE, CHUNK = 40.0, 400_000
REJECT_BELOW = 0.35

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each of the first 65,536 code points: itself if a letter, else a space."""
    if not _letters:
        _letters.append(np.array([i if chr(i).isalpha() else 32 for i in range(1 << 16)], dtype=np.uint32))
    return _letters[0]


def grams(text: str) -> np.ndarray | None:
    """The bins of a text's n-grams, each as often as it occurs; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) and codes.max() >= 1 << 16:
        codes = np.array([c if c < 1 << 16 or chr(c).isalpha() else 32 for c in codes.tolist()], dtype=np.uint32)
        mapped = np.where(codes < 1 << 16, letters()[np.minimum(codes, 65535)], codes)
    else:
        mapped = letters()[codes]
    space = mapped == 32
    if space.all():
        return None
    keep = ~space
    keep[1:] |= ~space[:-1]  # of a run of spaces the first
    a = np.concatenate(([32], mapped[keep], [32])).astype(np.uint32)
    two = a[:-1] * np.uint32(0x9E3779B1) ^ a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ a[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    return np.concatenate((a * np.uint32(0x165667B1) >> shift, two * np.uint32(0x2C1B3C6D) >> shift, three * np.uint32(0x297A2D39) >> shift)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # of bins by languages, the document weights multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            bins = grams(text) if text and self.languages else None
            if bins is None:
                names.append("und")
                scores.append(0.0)
                continue
            total = np.zeros(len(self.languages))
            for lo in range(0, len(bins), CHUNK):  # a very long text's matrix stays small
                total += self.weights[bins[lo : lo + CHUNK]].sum(axis=0, dtype=np.float64)
            z = (total * (SCALE / len(bins)) + self.bias) / self.temperature
            p = np.exp(z - z.max())
            k = int(p.argmax())
            names.append(self.languages[k])
            scores.append(float(p[k] / p.sum()))
        return names, scores


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, features: int, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after epochs over rows of (bins, values), each coordinate with its own rate."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
    weight = lambda z, n: np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], features), np.append(rows[i][1] * SCALE, 1.0)
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weight(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the true languages likeliest."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.2), np.log(5.0), 60)):
        s = logits / t
        m = s.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(s - m).sum(axis=1)) + m[:, 0] - s[np.arange(len(y)), y]).mean()) if len(y) else 0.0
        best = min(best, (loss, float(t)))
    return best[1]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From rows (text, lang, seed); rows without language are left out."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, langs = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=bool), {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                bins = grams(text.as_py())
                if bins is not None:
                    seen[:] = False
                    seen[bins] = True
                    df += seen
                    langs[lang.as_py()] = langs.get(lang.as_py(), 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bin": pa.array([*at.tolist(), *[-1] * len(langs)], pa.int32()), "lang": pa.array([*[None] * len(at), *langs], pa.string()), "n": pa.array([*df[at].tolist(), *langs.values()], pa.int64())})

    counted = known.select("text", "lang").mapInArrow(count, "bin int, lang string, n long").groupBy("bin", "lang").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()  # one row a bin and a language
    df = np.zeros(FEATURES)
    of_bins = rows[rows["bin"] >= 0]
    df[of_bins["bin"].to_numpy()] = of_bins["n"]
    langs = dict(sorted((str(k), int(v)) for k, v in zip(rows["lang"][rows["bin"] < 0], rows["n"][rows["bin"] < 0])))
    if not langs:
        return Model([], np.zeros((FEATURES, 0), dtype=np.float32), np.zeros(0))
    idf = np.log((1 + sum(langs.values())) / (1 + df)) + 1
    languages, each = list(langs), max(1, sample // len(langs))
    chances = F.create_map(*[F.lit(x) for k, v in langs.items() for x in (k, min(1.0, each / v))])
    chance = F.coalesce(F.try_element_at(chances, F.col("lang")), F.lit(0.0))
    picked = known.where(F.pmod(F.xxhash64("seed", F.lit(SEED)), F.lit(1 << 20)) < chance * (1 << 20))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang, seed in zip(*(batch.column(c) for c in ("text", "lang", "seed"))):
                bins = grams(text.as_py())
                if bins is not None:
                    at, n = np.unique(bins, return_counts=True)
                    out.append((seed.as_py(), lang.as_py(), at.astype(np.int32), (n / len(bins)).astype(np.float32)))
            yield pa.RecordBatch.from_pydict({"seed": pa.array([x[0] for x in out], pa.int64()), "lang": pa.array([x[1] for x in out], pa.string()), "bins": pa.array([x[2] for x in out], pa.list_(pa.int32())), "tf": pa.array([x[3] for x in out], pa.list_(pa.float32()))})

    features = picked.mapInArrow(featurise, "seed long, lang string, bins array<int>, tf array<float>")
    got = features.orderBy(F.xxhash64("seed", "lang"), F.xxhash64("bins", "tf")).limit(2 * sample).toPandas().sort_values(["seed", "lang"], ignore_index=True, kind="stable")
    x = [(np.asarray(at), np.asarray(tf, dtype=np.float64) * idf[np.asarray(at)]) for at, tf in zip(got["bins"], got["tf"])]
    y = got["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    last = np.arange(len(x)) % 10 == 9
    w, bias = ftrl([r for r, k in zip(x, last) if not k], y[~last], FEATURES, len(languages))
    logits = np.array([SCALE * v @ w[at] + bias for (at, v), k in zip(x, last) if k]).reshape(-1, len(languages))
    return Model(languages, (w * idf[:, None]).astype(np.float32), bias, temperature(logits, y[last]))


def identify(spark: SparkSession, text: Column, model: Model) -> Column:
    """struct<lang, score> for each text."""
    sent = spark.sparkContext.broadcast(model)  # FEATURES weights of 4 bytes for each language that was learned

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = sent.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": names, "score": scores})

    return predict(F.coalesce(text, F.lit("")))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select("text", "lang", F.xxhash64("doc_id").alias("seed"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(learnable(docs))
    found = docs.select("doc_id", held_out().alias("held_out"), identify(spark, F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
