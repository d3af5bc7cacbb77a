"""Mixing sources to target weights.

Words are summed by source; sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by
weight. No source is repeated more than max_rate times: what is above goes to the others by weight until none is above.
A source's rate is its target over its size. Each document is emitted floor(rate) times, plus once more if a number in
[0, 1) drawn from the hash of seed and id is below the fraction. The numbers of a source are turned round [0, 1) by one
of DRAWS equal steps, which leaves each of them evenly spread: the step whose words come nearest to the source's target,
the first of equals.

Null text: size 0. Documents of size 0 and sources without words get copies by the same law (rate 0 if the source is
empty) and take nothing. Rows that repeat an id share its draw. An empty table gives an empty result. Extra columns
stay, whatever their names: what the operator adds goes by names that the table doesn't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import WORD, Scratch, frequent, number_rows, table

MAX_RATE, SEED, WEIGHTS, DRAWS = 3, 11, (1, 2, 3), 64
#: Sources are broadcast up to so many rows and bytes of names; beyond, only the frequent ones are.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """In [0, 1): the first 52 bits of an MD5."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def turned(number: Column, step: Column) -> Column:
    """A number of [0, 1) moved on by step of DRAWS equal steps, round the end. Exact in doubles."""
    x = number + step / F.lit(float(DRAWS))
    return x - F.floor(x)


def rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def fraction() -> Column:
    return rate() - F.floor(rate())


def with_rates(rows: DataFrame, rates: DataFrame, source: str, columns: dict[str, str]) -> DataFrame:
    """rows joined with their source's columns of rates, under the names given; a source that is null is one of its own.
    Many sources are joined by a shuffle, but for those that hold many rows."""
    n, chars, total = rates.agg(F.count(F.lit(1)), F.sum(F.octet_length("source")), F.sum("n")).first()
    added = lambda x: [F.col(f"r.{k}").alias(v) for k, v in x.items()]

    def joined(part: DataFrame, how: str = "inner") -> DataFrame:
        both = rows.alias("d").join(part.alias("r"), F.col(f"d.`{source}`").eqNullSafe(F.col("r.source")), how)
        return both.select("d.*") if how == "left_anti" else both.select("d.*", *added(columns))

    if n <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_BYTES:
        return joined(F.broadcast(rates))
    often = frequent(rates, total)
    apart = joined(F.broadcast(often), "left_anti")
    rest = apart.alias("d").join(rates.alias("r"), F.col(f"d.`{source}`").eqNullSafe(F.col("r.source")))
    return joined(F.broadcast(often)).unionByName(rest.select("d.*", *added(columns)))


def source_rates(sized: DataFrame, scratch: Scratch, max_rate: int = MAX_RATE, weights: tuple = WEIGHTS) -> DataFrame:
    """From a written table (source, size, number) of documents: source, n (documents), source_size, target and step."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).withColumn("last", F.col("source").isNull())
    ranked = number_rows(scratch, by_source, ["last", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = scratch.write(ranked.withColumn("weight", weight), "sources")
    cap = F.col("source_size").cast("double") * max_rate
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while total:  # each turn caps at least one more source, mostly many
        above = cap < F.lit(level) * F.col("weight")
        spent, open_weight = sources.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        now = (total - spent) / open_weight if open_weight else level
        if now <= level:
            break
        level = now
    targets = sources.select("source", "n", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))
    tried = with_rates(sized, targets, "source", {"source_size": "source_size", "target": "target"})
    steps = [F.sum(F.when(turned(F.col("number"), F.lit(k)) < fraction(), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(DRAWS)]
    sums = tried.groupBy("source").agg(*steps, F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n"))
    off = lambda k: F.abs((F.col(f"s{k}") + F.floor(rate()) * F.col("source_size")).cast("double") - F.col("target"))
    nearest = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("step")) for k in range(DRAWS)]))["step"]
    return scratch.write(sums.select("source", "n", "source_size", "target", nearest.alias("step")), "rates")


def sized(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), draw(F.col(doc_id), seed).alias("number"))


def copies(number: Column) -> Column:
    return (F.floor(rate()) + (turned(number, F.col("step")) < fraction()).cast("long")).cast("long")


def with_copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, max_rate: int = MAX_RATE) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(sized(docs, text, source, doc_id, seed), "sized")
    found = with_rates(rows, source_rates(rows, scratch, max_rate), "source", {k: k for k in ("source_size", "target", "step")})
    return found.select("doc_id", "source", "size", "source_size", "target", copies(F.col("number")).alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, max_rate: int = MAX_RATE) -> DataFrame:
    """The mixture itself: the rows of docs, each as often as the mix takes it."""
    scratch, prefix = Scratch(docs.sparkSession, "mix"), "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rows = scratch.write(sized(docs, text, source, doc_id, seed).select("source", "size", "number"), "sized")
    rates = source_rates(rows, scratch, max_rate)
    rates = scratch.write(rates.select("source", "n", F.floor(rate()).alias("whole"), fraction().alias("part"), "step"), "rates")
    own = {k: prefix + k for k in ("whole", "part", "step")}
    found = with_rates(docs, rates, source, own)
    n = F.col(own["whole"]) + (turned(draw(F.col(doc_id), seed), F.col(own["step"])) < F.col(own["part"])).cast("long")
    return found.withColumn(prefix + "copy", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source),
stepped AS (
  SELECT *, 3.0 * source_size / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3.0 * source_size) OVER before, 0) AS spent, coalesce(sum(w) OVER before, 0) AS used
  FROM by_source WINDOW before AS (ORDER BY 3.0 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(CAST(total - spent AS DOUBLE) / CAST(all_w - used AS DOUBLE), ratio) AS l FROM stepped
  WHERE CAST(total - spent AS DOUBLE) / CAST(all_w - used AS DOUBLE) <= ratio),
rates AS (
  SELECT source, source_size, least(CAST(3.0 * source_size AS DOUBLE), coalesce(l, 0) * w) AS target FROM by_source, level),
drawn AS (
  SELECT doc_id, sized.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source),
steps AS (
  SELECT source, k, any_value(target) AS target, floor(any_value(rate)) * any_value(source_size)
         + sum(CASE WHEN (u + k / 64.0::DOUBLE) - floor(u + k / 64.0::DOUBLE) < rate - floor(rate) THEN size ELSE 0 END) AS words
  FROM drawn, range(64) AS r(k) GROUP BY source, k),
step AS (SELECT source, k FROM steps QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(CAST(words AS DOUBLE) - target), k) = 1)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN (u + k / 64.0::DOUBLE) - floor(u + k / 64.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn JOIN step ON drawn.source IS NOT DISTINCT FROM step.source
"""
