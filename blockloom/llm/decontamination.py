"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may differ from a passage by k = m // 20 edits. Cut into k + 1 pieces, at least
one piece is in the passage unchanged, so only windows around an exact hit of a piece are verified, with Myers'
bit-parallel distance (the passage may begin and end anywhere in the window). Nothing is missed and nothing is taken on
trust.

The corpus is read once, however large the benchmark is: every position's rolling hash of as many characters as pieces
begin with (LENGTHS) is looked up in a Bloom filter of the pieces' hashes, of fixed size at most, which is all
that is broadcast. Documents with a hit are written down with their hits; these meet the pieces in a join on the hash, and
each document then meets its items in a stream, one item at a time.

Normalised means lower case with every run of other characters than letters and digits as one space. Items of fewer
than 20 characters have no edits to spend and match as whole words only. Items that are null or hold no letter or digit match
nothing; so do null and empty texts. Equal texts and equal items give equal rows, each; ids may be null or repeat. Empty
tables give an empty result. Other columns pass through the filter as they are."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import Scratch, partitions, table
from blockloom.llm.near_dedup import mix
from blockloom.llm.suffix_dedup import BASE, INVERSE, powers

EDITS = 20
#: A piece is looked up by its first so many characters: the most that it has of these, or all it has of fewer.
LENGTHS = (16, 10)
#: Bits of the bitmap for each piece, and in all at least and at most (powers of two); where in a hash its places are.
SPREAD, FEWEST, MOST, SHIFTS = 128, 1 << 22, 1 << 27, (0, 20, 37)
#: Characters of documents hashed at once.
CHUNK = 1 << 20
U = np.uint64
_other = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return _other.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of pattern to any part of text and where that part ends, if it is at most `most`."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top, get = (1 << m) - 1, 1 << (m - 1), masks.get
    up, down, score, best = full, 0, m, (most + 1, 0)
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        rise, fall = down | (full & ~(d | up)), up & d
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1, fall << 1
        up, down = (fall | (full & ~(x | rise))) & full, rise & x
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def pattern_of(text: str | None) -> tuple[str, int]:
    """What an item is looked for as, and the edits it may have; short ones with the spaces around them."""
    t = normalise(text or "")
    return (t, len(t) // EDITS) if len(t) >= EDITS else (f" {t} " if t else "", 0)


def pieces(pattern: str, edits: int) -> list[tuple[int, int]]:
    """(offset, size) of a pattern's pieces, one more than its edits."""
    cuts = [len(pattern) * p // (edits + 1) for p in range(edits + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def looked_up(size: int) -> int:
    return next((n for n in LENGTHS if n <= size), size)


def hashes(text: str, n: int) -> np.ndarray:
    """Hash of the n characters at each position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + U(1)
    if len(codes) < n:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(INVERSE, len(codes) - n + 1) + U(n))


def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, gram, length, at, size) for each piece of each item."""
    for batch in batches:
        out = []
        for item, pattern, edits in zip(*(batch.column(c).to_pylist() for c in ("item", "pattern", "edits"))):
            for at, size in pieces(pattern, edits):
                n = looked_up(size)
                out.append((item, int(hashes(pattern[at : at + n], n).view(np.int64)[0]), n, at, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["item", "gram", "length", "at", "size"])


def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = [pattern_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([p for p, _ in wanted], pa.string()), pa.array([k for _, k in wanted], pa.int32())], ["item_id", "pattern", "edits"])


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the grams: at most MOST bits come to the driver, in pieces of 4 KB."""
    places = F.array(*[F.shiftrightunsigned("gram", k).bitwiseAND(F.lit(bits - 1).cast("long")) + 1 for k in SHIFTS])
    low = F.col("low")
    rows = grams.select(F.explode(places).alias("low")).groupBy(F.bitmap_bucket_number(low).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits")).collect()
    out = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def find_hits(sent, lengths: list[int]):
    """Documents that hold a gram: row by row with the normalised text, spaces around it, and where which grams are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packer = sent.value, zstandard.ZstdCompressor(level=1)
        mask, longest = U(len(bits) * 8 - 1), max(lengths)

        def hits(text: str, begins: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
            found = [], []
            for lo in range(0, len(text), CHUNK):
                part = text[lo : lo + CHUNK + longest - 1]
                for n in lengths:
                    h = hashes(part, n)[: min(CHUNK, len(text) - lo)]
                    at = np.arange(len(h))
                    for k in SHIFTS:
                        low = h[at] >> U(k) & mask if k else h & mask
                        at = at[(bits[low >> U(3)] >> (low & U(7)).astype(np.uint8) & 1).astype(bool)]
                    found[0].append(at + lo)
                    found[1].append(h[at].view(np.int64))
            at, grams = np.concatenate(found[0]), np.concatenate(found[1])
            order = np.argsort(at, kind="stable")
            at, grams = at[order], grams[order]
            of = np.searchsorted(begins, at, side="right") - 1
            cuts = np.flatnonzero(np.diff(of, prepend=-1, append=len(begins)))
            for own in (slice(a, b) for a, b in zip(cuts, cuts[1:])):
                i = int(of[own.start])
                yield i, (at[own] - begins[i]).tolist(), grams[own].tolist()

        for batch in batches:
            texts = [f" {normalise(t)} " for t in batch.column("text").to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi]) + 1
                    hi += 1
                group = texts[lo:hi]
                begins = np.cumsum([0] + [len(t) + 1 for t in group[:-1]])  # a NUL between texts is in no piece
                held = list(hits("\0".join(group), begins))
                if held:
                    rows = [lo + i for i, _, _ in held]
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(pa.array(rows)) for c in ("doc_id", "same")], pa.array([packer.compress(texts[i].encode("utf-8", "surrogatepass")) for i in rows], pa.binary()),
                         pa.array([x[1] for x in held], pa.list_(pa.int32())), pa.array([x[2] for x in held], pa.list_(pa.int64()))], ["doc_id", "same", "packed", "places", "grams"])
                lo = hi

    return run


def verified(text: str, pattern: str, edits: int, hits: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """Distance and end (in the text) of the pattern, from (place, offset, size) of hits of its pieces."""
    windows: list[list[int]] = []
    for place, at, size in sorted(hits):
        if text[place : place + size] != pattern[at : at + size]:
            continue  # the hash of its beginning alone is the same
        lo = place - at - edits
        hi = lo + len(pattern) + 2 * edits
        if windows and lo <= windows[-1][1]:  # overlapping windows are read once
            windows[-1][1] = max(windows[-1][1], hi)
        else:
            windows.append([lo, hi])
    if not windows:
        return None
    if (at := text.find(pattern)) >= 0:
        return 0, at + len(pattern)
    found = [(hit[0], max(lo, 1) + hit[1]) for lo, hi in windows if (hit := myers(pattern, text[max(lo, 1) : min(hi, len(text) - 1)], edits))]
    return min(found, default=None)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's text, then its items, in this order: (doc_id, same, item_id, distance, end). One text is kept at a time."""
    unpack, row, text, doc, same = zstandard.ZstdDecompressor(), None, "", None, 0
    names = ["row", "doc_id", "same", "packed", "item_id", "pattern", "edits", "hits"]
    for batch in batches:
        out = []
        for r, d, h, packed, item, pattern, edits, hits in zip(*(batch.column(c) for c in names)):
            if packed.is_valid:
                row, doc, same, text = r.as_py(), d.as_py(), h.as_py(), unpack.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
            elif r.as_py() == row and (found := verified(text, p := pattern.as_py(), edits.as_py(), [(x["place"], x["at"], x["size"]) for x in hits.as_py()])):
                out.append((doc, same, item.as_py(), found[0], found[1] - (2 if p[0] == " " else 1)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "same", "item_id", "distance", "end"])


FOUND = "doc_id long, same long, item_id long, distance int, end int"


def same_text(doc_id: str, text: str) -> Column:
    """Tells rows that share an id apart, and those whose id is null."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(text))


def found_items(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """find_items with `same`, as a written table."""
    spark = docs.sparkSession
    scratch, n_parts = Scratch(spark, "items"), partitions(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(prepared, "item_id long, pattern string, edits int")
    items = scratch.write(items.where("pattern <> ''").withColumn("item", F.monotonically_increasing_id()), "items")
    cut = scratch.write(items.select("item", "pattern", "edits").mapInArrow(cut_items, "item long, gram long, length int, at int, size int"), "pieces")
    lengths = sorted(r["length"] for r in cut.select("length").distinct().collect())  # LENGTHS and fewer characters: 16 at most
    if not lengths:
        return spark.createDataFrame([], FOUND)
    bits = FEWEST
    while bits < min(MOST, SPREAD * cut.count()):
        bits *= 2
    sent = spark.sparkContext.broadcast(bitmap(cut, bits))
    rows = docs.where(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), same_text(doc_id, text).alias("same"), F.col(text).alias("text"))
    held = rows.mapInArrow(find_hits(sent, lengths), "doc_id long, same long, packed binary, places array<int>, grams array<long>")
    held = scratch.write(held.withColumn("row", F.monotonically_increasing_id()), "held")
    hits = held.select("row", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("row", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
    pairs = hits.join(cut.select("gram", "item", "at", "size"), "gram").groupBy("row", "item").agg(F.collect_list(F.struct("place", "at", "size")).alias("hits"))
    texts = held.select("row", "doc_id", "same", "packed", *[F.lit(None).cast(t).alias(n) for n, t in (("item_id", "long"), ("pattern", "string"), ("edits", "int"), ("hits", "array<struct<place:int,at:int,size:int>>"))])
    asked = pairs.join(items, "item").select("row", *[F.lit(None).cast(t).alias(n) for n, t in (("doc_id", "long"), ("same", "long"), ("packed", "binary"))], "item_id", "pattern", "edits", "hits")
    both = texts.unionByName(asked).repartition(n_parts, "row").sortWithinPartitions("row", F.col("packed").isNull())
    return scratch.write(both.mapInArrow(verify, FOUND), "found")


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end): a row for each item in each document's text, end being in the normalised text."""
    return found_items(docs, benchmark, doc_id, text, item_id, item_text).drop("same")


def without_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs whose text holds no item."""
    found = found_items(docs, benchmark, doc_id, text, item_id, item_text).select(F.col("doc_id").alias("of"), "same").distinct()
    held = Scratch(docs.sparkSession, "held").write(found, "held").alias("held")
    own = docs.alias("docs")
    here = lambda c: F.col(f"docs.`{c}`")
    same = F.xxhash64(here(doc_id).isNull(), here(text)) == F.col("held.same")
    return own.join(held, here(doc_id).cast("long").eqNullSafe(F.col("held.of")) & same, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
