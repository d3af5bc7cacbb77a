"""Payloads as rows of fixed-size blocks, and digests over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def quotient(x: Column, by: int) -> Column:
    """Integer quotient of a number that isn't negative, without doubles."""
    return F.call_function("div", x.cast("long"), F.lit(by).cast("long"))


def ceil_div(x: Column, by: int) -> Column:
    return quotient(x + F.lit(by - 1), by)


def align_up(x: Column, to: int) -> Column:
    return x + (F.lit(to) - x % F.lit(to)) % F.lit(to)


def split_blocks(df: DataFrame, payload: str, size: int, number: str = "block_no", block: str = "block") -> DataFrame:
    """A row for each block of a binary payload; the last may be shorter, an empty payload has none. Null payloads have none."""
    n = F.octet_length(payload)
    many = df.where(n > 0).withColumn(number, F.explode(F.sequence(F.lit(0), quotient(n - 1, size).cast("int"))))
    return many.withColumn(block, F.substring(F.col(payload), F.col(number) * size + 1, F.lit(size))).drop(payload)


def ordered_digest(digests: Column, order: Column, width: int = 4096) -> Column:
    """Aggregate: SHA-1 of the hexadecimal digests joined in order and zero-padded to width bytes. For groups of bounded size."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order.alias("o"), digests.alias("d"))))
    return F.sha1(F.unhex(F.rpad(F.array_join(F.transform(sorted_, lambda x: x["d"]), ""), width * 2, "0")))


def hash_rollup(blocks: DataFrame, keys: list[str], number: str = "block_no", digest: str = "sha1", fan_in: int = 204) -> DataFrame:
    """Two levels: digest lists of fan_in blocks each, then the list of those. Each level groups fan_in rows at most on its
    lower level. Where the upper list would hold more than fan_in digests it is dealt in parts of fan_in - 1, and from the
    last part to the first each list also gets the digest of the next, so that the first one's digest covers every block."""
    lower = blocks.withColumn("sub_no", quotient(F.col(number), fan_in)).groupBy(*keys, "sub_no").agg(ordered_digest(F.col(digest), F.col(number)).alias("sub"), F.count(F.lit(1)).alias("n"))
    upper = lower.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sub_no", "sub"))).alias("_subs"), F.sum("n").alias("n_blocks"))
    width = F.when(F.size("_subs") <= fan_in, fan_in).otherwise(fan_in - 1)
    firsts = F.reverse(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.size("_subs").cast("long") - 1, width.cast("long"))))
    own = lambda part: F.array_join(F.transform(F.slice("_subs", (part * width + 1).cast("int"), width), lambda x: x["sub"]), "")
    master = F.aggregate(firsts, F.lit(""), lambda after, part: F.sha1(F.unhex(F.rpad(F.concat(own(part), after), 8192, "0"))))
    return upper.select(*keys, master.alias("master"), "n_blocks")


def chain_digest(texts: Column, order: Column) -> Column:
    """Aggregate: from the last text to the first, each digest taken over the text and the digest of its successor."""
    parts = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), texts.alias("t")))), lambda x: x["t"]))
    return F.aggregate(parts, F.lit(""), lambda after, t: F.sha1(F.concat(t, after).cast("binary")))


def rechunk(df: DataFrame, by: list[str], order: str, payload: str, size: int, number: str = "chunk_no", block: str = "block") -> DataFrame:
    """Payloads of each group joined in order and cut anew into blocks of size: a running offset says which blocks each
    payload reaches into, and a block is put together from its own few pieces, so no stream is gathered in a row. Null and
    empty payloads add nothing; order must tell a group's rows apart."""
    n = F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")
    placed = df.select(*by, F.col(order).alias("_order"), F.col(payload).alias("_payload"), n.alias("_n"))
    placed = placed.withColumn("_at", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_order").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).where("_n > 0")
    first, last = quotient(F.col("_at"), size), quotient(F.col("_at") + F.col("_n") - 1, size)
    each = placed.withColumn(number, F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col(number) * size - F.col("_at"), F.lit(0).cast("long"))
    hi = F.least((F.col(number) + 1) * size - F.col("_at"), F.col("_n"))
    piece = F.substring(F.col("_payload"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("_order", F.hex(piece).alias("x"))))
    return each.groupBy(*by, number).agg(F.unhex(F.array_join(F.transform(pieces, lambda p: p["x"]), "")).alias(block))
