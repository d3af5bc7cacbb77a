"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models over the characters + to z are counted from labelled samples, with one added to each count. A
long token with a digit and a letter that no pattern's match touches is a secret (kind `markov`) if its log-likelihood
ratio, random against identifier, is at least MARGIN for each pair of characters. The two models meet in one array of
log ratios, so a token's score is one fold over its characters inside a SQL expression; everything is DataFrame
functions.

Samples come from about SAMPLE documents, picked by hash: random strings are what the fixed patterns find there (TOKENS
of them at most) and as many digests; identifiers are tokens that split into frequent words (TOKENS at most), and joins of
these words and a few seed words the way identifiers, paths and slugs are. Frequent words are the WORDS that most of these
documents hold. Held-out samples are kept apart by their number.

Positions are code points. They come from the text between the matches (split) and the matches themselves, which
alternate: each match is a row, a running sum over the matches of a document places them, and running extremes tell
which tokens touch a match, so the work grows in proportion to the matches, however many a text has. Null and empty texts
have no spans. Repeated rows get equal results, each. An empty table gives an empty result. Other columns aren't read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.llm.common import table

#: Fixed patterns of the base kinds, in their order, with the group whose length counts and the least length.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
CANDIDATE, LEAST, MARGIN = r"[A-Za-z0-9+/_=-]{20,}", 20, 0.35
FIRST, WIDTH = ord("+"), ord("z") - ord("+") + 1
TOKENS, SAMPLE, WORDS, LONGEST, BLOCK = 2000, 20_000, 400, 200, 4096
SEED_WORDS = "get set user name list item value index count read write file path open close node table key map load store make test start run event client server request config option default stream update result status type class data size line page body".split()


def picked(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About so many rows, by hash."""
    share = min(1.0, sample / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(1 << 30)) < share * (1 << 30))


def corpus_words(docs: DataFrame, text: str, most: int = WORDS) -> list[str]:
    """The words in lower case that most documents hold."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{2,12}\b"), F.lit(0)))).alias("word"))
    return sorted(r["word"] for r in found.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect())


def tokens(docs: DataFrame, text: str, patterns: list[tuple], most: int = TOKENS) -> DataFrame:
    """token, number: what the patterns' groups match, at most so many, picked by hash; long ones are cut."""
    each = [F.regexp_extract_all(F.col(text), F.lit(p), F.lit(g)) for p, g in patterns]
    found = docs.where(F.col(text).rlike("|".join(f"(?:{p})" for p, _ in patterns)))
    found = found.select(F.explode(F.flatten(F.array(*each))).alias("token")).select(F.substring("token", 1, LONGEST).alias("token")).where(F.length("token") >= 8).distinct()
    return found.orderBy(F.xxhash64("token"), "token").limit(most).select("token", F.pmod(F.xxhash64("token", F.lit(1)), F.lit(1 << 31)).alias("number"))


def samples(docs: DataFrame, text: str = "text", n: int = TOKENS) -> DataFrame:
    """Labelled samples (token, random, number)."""
    spark = docs.sparkSession
    docs = picked(docs).where(F.length(text) > 0)
    frequent = corpus_words(docs, text)
    vocabulary = frequent + [w for w in SEED_WORDS if w not in set(frequent)]
    w = F.array(*[F.lit(x) for x in vocabulary])
    word = lambda k: F.element_at(w, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(vocabulary))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    size = (F.col("id") % 24 + 20).cast("int")
    plain = F.base64(F.unhex(digest))
    drawn = F.when(F.col("id") % 3 == 0, plain).when(F.col("id") % 3 == 1, digest).otherwise(F.regexp_replace(plain, "[^A-Za-z0-9]", ""))
    number = F.concat(F.lit("_"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3000)).cast("string"))
    parts = F.array(*[word(k) for k in range(4)])
    joined = (
        F.when(F.col("id") % 6 == 0, F.concat(F.array_join(parts, "_"), number)).when(F.col("id") % 6 == 1, F.concat(F.array_join(F.transform(parts, F.initcap), ""), F.regexp_replace(number, "_", "")))
        .when(F.col("id") % 6 == 2, F.upper(F.concat(F.array_join(parts, "_"), number))).when(F.col("id") % 6 == 3, F.concat(F.array_join(parts, "/"), F.regexp_replace(number, "_", "-")))
        .when(F.col("id") % 6 == 4, F.concat(F.array_join(parts, ""), number)).otherwise(F.array_join(F.slice(F.concat(parts, F.array(F.regexp_replace(number, "_", "")), parts), 3, 5), "-"))
    )
    ids = spark.range(n)
    made = ids.select(F.substring(drawn, F.lit(1), size).alias("token"), F.lit(1).alias("random"), F.col("id").alias("number")).unionByName(ids.select(joined.alias("token"), F.lit(0).alias("random"), F.col("id").alias("number")))
    secret = tokens(docs, text, [(x[1], x[2]) for x in BASE], n).select("token", F.lit(1).alias("random"), "number")
    known = F.array(*[F.lit(x) for x in vocabulary])
    pieces = F.filter(F.split(F.regexp_replace("token", "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+"), lambda x: x != "")
    named = tokens(docs, text, [(CANDIDATE, 0)], 4 * n).where(F.size(pieces) > 1).where(F.forall(pieces, lambda x: F.array_contains(known, F.lower(x)))).limit(n)
    return made.unionByName(secret).unionByName(named.select("token", F.lit(0).alias("random"), "number"))


def place(character: Column) -> Column:
    return F.ascii(character) - FIRST


def fit(labelled: DataFrame) -> list[float]:
    """Log of P(next | character) under random strings over that under identifiers, for each pair of characters."""
    kept = labelled.where(F.col("token").rlike(rf"^[+-z]{{2,}}$"))
    pairs = kept.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: place(F.substring("token", i, F.lit(1))) * WIDTH + place(F.substring("token", i + 1, F.lit(1))))).alias("pair"))
    counts = [[1.0] * WIDTH**2, [1.0] * WIDTH**2]  # the samples' pairs: at most WIDTH squared rows a label
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] += r["count"]
    sums = [[sum(c[i * WIDTH : (i + 1) * WIDTH]) for i in range(WIDTH)] for c in counts]
    return [round(math.log(counts[1][i] / sums[1][i // WIDTH]) - math.log(counts[0][i] / sums[0][i // WIDTH]), 4) for i in range(WIDTH**2)]


def ratio(token: Column, model: Column) -> Column:
    """A token's log-likelihood ratio, from its characters in blocks."""
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    inside = lambda chars: F.aggregate(F.sequence(F.lit(1), F.size(chars) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(model, place(F.element_at(chars, i)) * WIDTH + place(F.element_at(chars, i + 1)) + 1))
    begins = F.sequence(F.lit(1), F.length(token) - 1, F.lit(BLOCK))
    return F.aggregate(begins, F.lit(0.0), lambda acc, at: acc + let(F.split(F.substring(token, at, F.lit(BLOCK + 1)), ""), inside))


def pieces(text: Column, kind: int, pattern: str, group: int, least: int, score: Column | None = None) -> Column:
    """The pattern's leftmost non-overlapping matches in order: array of (kind, gap before it, size, token). The token is null
    where the group is shorter than least or the score isn't met."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), parts.alias("part"))

    def one(x: Column) -> Column:
        kept = F.length(x["part"]) >= least
        kept = kept & score(x["hit"]) if score else kept
        return F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), F.when(kept, x["hit"]).alias("token"))

    return F.when(text.rlike(pattern), F.transform(zipped, one)).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,token:string>>"))


def scan(docs: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind number, end, token), each sorted."""
    logs = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    secret = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (ratio(t, logs) >= margin * (F.length(t) - 1))
    body, markov = F.coalesce(F.col(text), F.lit("")), len(BASE)
    found = F.concat(*[pieces(body, k, *x[1:]) for k, x in enumerate(BASE)], pieces(body, markov, CANDIDATE, 0, LEAST, secret))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), found.alias("found"))
    each = rows.select("doc_id", "row", F.posexplode_outer("found").alias("at", "x")).select("doc_id", "row", "at", "x.*")
    so_far = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("token").isNotNull() & (F.col("kind") < markov)
    before = W.partitionBy("row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("last", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    touched = (F.coalesce("last", F.lit(0)) > F.col("start")) | (F.coalesce("next", F.col("end")) < F.col("end"))
    span = F.struct("start", "kind", "end", "token")
    gathered = each.groupBy("row", "doc_id").agg(F.collect_list(F.when(base, span)).alias("base"), F.collect_list(F.when(F.col("token").isNotNull() & (F.col("kind") == markov) & ~touched, span)).alias("added"))
    return gathered.select("doc_id", F.array_sort("base").alias("base"), F.array_sort("added").alias("added"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x[0]) for x in BASE], F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(samples(docs)))
    n = [F.size(F.filter("base", (lambda k: lambda s: s["kind"] == k)(k))).cast("long").alias(f"n_{x[0]}") for k, x in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_markov"))
