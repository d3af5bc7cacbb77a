"""Removal of repeated substrings by a distributed merge sort of suffixes that knows common prefixes.

Equal texts of SPAN bytes or more lose all their bytes and take part as one numbered text from then on; ids play no part
until the results are joined with the rows by the text's digest.

Every string of SPAN bytes holds at least one anchor: a position whose K-byte gram has the least hash of a window of
grams that fits the span. Equal strings have equal anchors, so a string that occurs twice has an anchor whose gram
occurs twice, and only suffixes at such anchors are sorted. Each task sorts its anchors' suffixes (SPAN bytes to the
right, then SPAN to the left, backwards), and sends them front-coded: the length of the prefix shared with the one
before, and the rest. A receiving task merges the runs with a loser tree that keeps each candidate's common prefix with
the last output; two candidates are compared only beyond a prefix known to be equal. All suffixes of one gram meet in
one task, those that are the same within a run as one row.

Two anchors whose suffixes share R bytes to the right and L to the left cover L + R bytes of each text; where that is SPAN
or more, all of these are removed. For each suffix the largest such R comes from its neighbours in sorted order, the
largest such L from the same suffixes sorted by their left side; a suffix whose neighbours leave room for a farther and
longer match is compared with all of its gram, so the result is exact.

A gram of more than CROWD anchors doesn't go to one task: the spans of SPAN bytes around its anchors are counted by their
128-bit hash instead, in an aggregate that combines before the shuffle, and those that occur twice are removed. That is
exact too, since an equal span has the same anchor. Keys that hold more than a SHARE-th of all rows, so at most SHARE of
them, are broadcast in joins and the rest is shuffled.

Texts are UTF-8 bytes; a null text is empty. Matches never cross documents. Texts shorter than SPAN lose nothing. Rows
that repeat a text remove each other's bytes, whatever their ids; ids may be null or repeat, and rows of one id with
different texts each get their own result. An empty table gives an empty result. Only doc_id and text are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import Scratch, frequent, partitions, recurring, table
from blockloom.llm.near_dedup import mix

SPAN, K, PIECE, RUN, NEAR, CROWD = 200, 32, 1 << 20, 60_000, 12, 20_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
OTHER = 0xD6E8FEB86659FD93
OTHER_INVERSE = pow(OTHER, -1, 1 << 64)
BYTES = np.random.default_rng(31).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.ones(max(n, 1 << 16), dtype=np.uint64)
        out[1:] = base
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def slide(x: np.ndarray, w: int, f, pad: int) -> np.ndarray:
    """f.accumulate's extreme over each window of w values."""
    full = np.full(-(-len(x) // w) * w, U(pad), dtype=np.uint64)
    full[: len(x)] = x
    grid = full.reshape(-1, w)
    ahead, back = f.accumulate(grid, axis=1).ravel(), f.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of a text's anchors."""
    at, grams = [], []
    w = SPAN - K + 1
    for lo in range(0, max(1, len(data) - SPAN + 1), PIECE - SPAN + 1):  # each span lies whole in some piece
        d = data[lo : lo + PIECE]
        if len(d) < SPAN:
            break
        sums = np.zeros(len(d) + 1, dtype=np.uint64)
        np.cumsum(BYTES[d] * powers(BASE, len(d)), out=sums[1:])
        g = mix((sums[K:] - sums[:-K]) * powers(INVERSE, len(d) - K + 1))
        least = slide(g, w, np.minimum, (1 << 64) - 1)
        edge = np.zeros(w - 1, dtype=np.uint64)
        chosen = np.flatnonzero(slide(np.concatenate((edge, least, edge)), w, np.maximum, 0) == g)
        at.append(chosen + lo)
        grams.append(g[chosen])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, grams = np.concatenate(at), np.concatenate(grams)
    at, first = np.unique(at, return_index=True)
    return at, grams[first]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their digest and as compressed bytes, so that joins move less."""
    c = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()), pa.array([c.compress(t) for t in texts], pa.binary())], ["digest", "packed"])


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    d = zstandard.ZstdDecompressor()
    return (d.decompress(x.as_py()) for x in batch.column("packed"))


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            found = [anchors(np.frombuffer(t, dtype=np.uint8)) for t in unpacked(part)]
            rows = np.repeat(part.column("row").to_numpy(), [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate([x[0] for x in found]).astype(np.int32)), pa.array(np.concatenate([x[1] for x in found]).view(np.int64))], ["row", "pos", "gram"])


def spans_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start and 128-bit hash of every span of SPAN bytes that holds one of the anchors given."""
    for batch in batches:
        for row, text, at in zip(batch.column("row"), unpacked(batch), batch.column("at")):
            places = at.values.to_numpy()
            starts = np.unique((places[:, None] - np.arange(SPAN - K + 1)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(text) - SPAN)]
            data, hashes = np.frombuffer(text, dtype=np.uint8), []
            for base, inverse in ((BASE, INVERSE), (OTHER, OTHER_INVERSE)):
                sums = np.zeros(len(data) + 1, dtype=np.uint64)
                np.cumsum(BYTES[data] * powers(base, len(data)), out=sums[1:])
                hashes.append(mix((sums[starts + SPAN] - sums[starts]) * powers(inverse, len(data))[starts]))
            for lo in range(0, len(starts), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts[part]), row.as_py(), np.int64)), pa.array(starts[part].astype(np.int32)), *[pa.array(h[part].view(np.int64)) for h in hashes]], ["row", "start", "h1", "h2"])


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    if a == b:
        return len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


RUNS = "part int, run long, seq int, lcp int, tail binary, rows array<long>, places array<int>"


def sorted_runs(parts: int):
    """Front-coded runs, sorted within each receiving part."""

    def emit(run: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort()
        columns: list[list] = [[] for _ in range(7)]
        last, seq = (None, b""), 0
        for part, key, doc, pos in rows:
            if (part, key) == last:
                columns[5][-1].append(doc)
                columns[6][-1].append(pos)
                continue
            lcp = shared(last[1], key) if last[0] == part else 0
            for c, v in zip(columns, (part, run, seq, lcp, key[lcp:], [doc], [pos])):
                c.append(v)
            last, seq = (part, key), seq + 1
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for lo in range(0, len(columns[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 10_000], k) for c, k in zip(columns, kinds)], ["part", "run", "seq", "lcp", "tail", "rows", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = TaskContext.get().partitionId() << 24, []
        for batch in batches:
            for doc, text, at in zip(batch.column("row"), unpacked(batch), batch.column("at")):
                doc, places = doc.as_py(), at.values.to_numpy()
                padded = b"\xff" * SPAN + text + b"\xff" * SPAN  # 255 is no byte of UTF-8
                back = padded[::-1]
                for p in places.tolist():
                    key = padded[p + SPAN : p + 2 * SPAN] + back[len(back) - p - SPAN : len(back) - p]
                    rows.append((hash_part(key, parts), key, doc, p))
                if len(rows) >= RUN:
                    yield from emit(number, rows)
                    number, rows = number + 1, []
        yield from emit(number, rows)

    return run


def hash_part(key: bytes, parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(key[:K], digest_size=4).digest(), "big") % parts


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, string, rest)."""

    def __init__(self, runs: list[list[tuple]]):
        self.n = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = [iter(r) for r in runs] + [iter(())] * (self.n - len(runs))
        self.h, self.s, self.item = [0] * self.n, [b""] * self.n, [None] * self.n
        for i in range(self.n):
            self.pull(i)
        self.loser = [0] * self.n
        self.winner = self.build(1)

    def pull(self, i: int) -> None:
        x = self.item[i] = next(self.runs[i], None)
        if x is None:
            self.h[i] = -1  # loses to every string
        else:
            self.h[i], self.s[i] = x[0], x[1]

    def beats(self, a: int, b: int) -> bool:
        """a comes first. Prefixes are relative to the last output: the longer one comes first; if they are equal the
        strings are compared beyond them, and the later one's prefix becomes what it shares with the earlier."""
        h = self.h
        if h[a] != h[b]:
            return h[a] > h[b]
        if h[a] < 0:
            return a < b
        x, y, k = self.s[a], self.s[b], h[a]
        x, y = x[k:], y[k:]
        first = x <= y
        h[b if first else a] = k + shared(x, y)
        return first

    def build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self.build(2 * node), self.build(2 * node + 1)
        if self.beats(a, b):
            self.loser[node] = b
            return a
        self.loser[node] = a
        return b

    def __iter__(self) -> Iterator[tuple]:
        while self.item[self.winner] is not None:
            w = self.winner
            yield self.h[w], self.item[w]
            self.pull(w)
            node = (w + self.n) >> 1
            while node:
                if self.beats(o := self.loser[node], w):
                    self.loser[node], w = w, o
                node >>= 1
            self.winner = w


def best_pairs(keys: list[bytes], lcps: list[int], right: list[int], left: list[int], span: int) -> tuple[list[int], list[int]]:
    """For the sorted suffixes of one gram: the largest R and L (0 if none) among pairs that cover span bytes."""
    n = len(keys)
    best_r, best_l = [0] * n, [0] * n

    def walk(order: list[int], near: list[int], first: bool) -> tuple[list[int], list[int]]:
        """near[k]: bytes shared by order[k] and order[k - 1] on the side sorted by. Gives each suffix's largest share
        with any other, and the share beyond which it has seen all."""
        most, unseen = [0] * n, [0] * n
        for step in (1, -1):
            for k in range(n):
                i, reach, seen = order[k], 1 << 30, 0
                j = k - step
                while 0 <= j < n:
                    reach = min(reach, near[max(j, j + step)])
                    o = order[j]
                    a = min(reach, right[i], right[o]) if first else min(reach, left[i], left[o])
                    if not seen:
                        most[i] = max(most[i], min(reach, (right if first else left)[i]))
                    if reach <= (best_r if first else best_l)[i] or (best_r if first else best_l)[i] == (right if first else left)[i] or not reach:
                        break
                    if seen == NEAR:
                        unseen[i] = max(unseen[i], reach)
                        break
                    seen += 1
                    b = min(shared(keys[i][SPAN:], keys[o][SPAN:]), left[i], left[o]) if first else min(shared(keys[i][:SPAN], keys[o][:SPAN]), right[i], right[o])
                    if a + b >= span:
                        r, x = (a, b) if first else (b, a)
                        for q in (i, o):
                            best_r[q], best_l[q] = max(best_r[q], r), max(best_l[q], x)
                    j -= step
        return most, unseen

    if n > 1:
        any_r, open_r = walk(list(range(n)), [min(x, SPAN) for x in lcps], True)
        order = sorted(range(n), key=lambda i: keys[i][SPAN:])
        near = [0] + [shared(keys[i][SPAN:], keys[j][SPAN:]) for i, j in zip(order, order[1:])]
        any_l, open_l = walk(order, near, False)
        rest = [i for i in range(n) if (open_r[i] > best_r[i] and open_r[i] + any_l[i] >= span) or (open_l[i] > best_l[i] and open_l[i] + any_r[i] >= span)]
        if rest:
            grid = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(n, 2 * SPAN)
            ends = (np.array(right), np.array(left))
            for i in rest:
                other = grid != grid[i]
                r, x = (np.where(side.any(axis=1), side.argmax(axis=1), SPAN) for side in (other[:, :SPAN], other[:, SPAN:]))
                r, x = np.minimum(np.minimum(r, ends[0]), right[i]), np.minimum(np.minimum(x, ends[1]), left[i])
                fits = r + x >= span
                fits[i] = False
                if fits.any():
                    best_r[i], best_l[i] = max(best_r[i], int(r[fits].max())), max(best_l[i], int(x[fits].max()))
    return best_r, best_l


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, run and place -> (row, start, end): what repeats around each anchor."""
    part, runs, last_run, key = None, [], None, b""
    docs_out: list[int] = []
    starts: list[int] = []
    ends: list[int] = []

    def settle(block: list[tuple], lcps: list[int]) -> None:
        keys = [x[1] for x in block]
        if len(block) == 1 and len(block[0][2]) == 1:
            return
        right = [SPAN - k[:SPAN].count(b"\xff") for k in keys]
        left = [SPAN - k[SPAN:].count(b"\xff") for k in keys]
        best_r, best_l = best_pairs(keys, lcps, right, left, SPAN)
        for i, x in enumerate(block):
            r, b = best_r[i], best_l[i]
            if len(x[2]) > 1 and right[i] + left[i] >= SPAN:
                r, b = right[i], left[i]
            if r + b >= SPAN or r and b:
                for doc, pos in zip(x[2], x[3]):
                    docs_out.append(doc)
                    starts.append(pos - b)
                    ends.append(pos + r)

    def finish() -> None:
        block: list[tuple] = []
        lcps: list[int] = []
        for h, x in LoserTree(runs):
            if h < K and block:
                settle(block, lcps)
                block, lcps = [], []
            block.append(x)
            lcps.append(h)
        if block:
            settle(block, lcps)

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(docs_out, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["row", "start", "end"])
        for x in (docs_out, starts, ends):
            x.clear()
        return batch

    for batch in batches:
        for p, r, lcp, tail, docs, places in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "lcp", "tail", "rows", "places"))):
            if p != part:
                if runs:
                    finish()
                    yield out()
                part, runs, last_run = p, [], None
            if r != last_run:
                runs.append([])
                last_run, key = r, b""
            key = key[:lcp] + tail
            runs[-1].append((lcp, key, docs, places))
    if runs:
        finish()
    yield out()


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for digest, text, starts, ends in zip(batch.column("digest"), unpacked(batch), batch.column("starts"), batch.column("ends")):
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            lows, highs = starts.values.to_numpy(), ends.values.to_numpy()
            order = np.argsort(lows, kind="stable")
            lows, highs = lows[order], np.maximum.accumulate(highs[order])
            first = np.flatnonzero(np.concatenate(([True], lows[1:] > highs[:-1])))
            for lo, hi in zip(lows[first].tolist(), highs[np.append(first[1:], len(lows)) - 1].tolist()):
                kept.update(text[at:lo])
                removed, n, at = removed + hi - lo, n + 1, hi
            kept.update(text[at:])
            out.append((digest.as_py(), removed, n, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["digest", "removed", "spans", "kept"])


def unique_texts(scratch: Scratch, docs: DataFrame, text: str) -> DataFrame:
    """(row, digest, copies, packed): each text of SPAN bytes or more once, numbered."""
    long_ = docs.where(F.octet_length(text) >= SPAN).select(F.col(text).cast("binary").alias("text")).mapInArrow(pack, "digest binary, packed binary")
    one = long_.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed"))
    return scratch.write(one.withColumn("row", F.monotonically_increasing_id()), "texts")


def repeated_spans(scratch: Scratch, texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(row, start, end): byte ranges of texts to remove; ranges of one text may overlap."""
    spark = texts.sparkSession
    parts = 4 * partitions(spark)
    found = scratch.write(texts.select("row", "packed").mapInArrow(find_anchors, "row long, pos int, gram long"), "anchors")
    at = scratch.write(recurring(scratch, found, ["gram"]).select("row", "pos", (F.col("n") > crowd).alias("crowded")), "at")
    scratch.drop(found)
    gathered = lambda x: texts.select("row", "packed").join(x.groupBy("row").agg(F.collect_list("pos").alias("at")), "row").select("row", "packed", "at")
    runs = gathered(at.where("NOT crowded")).mapInArrow(sorted_runs(parts), RUNS)
    spans = scratch.write(runs.repartition(partitions(spark), "part").sortWithinPartitions("part", "run", "seq").mapInArrow(merge, "row long, start int, end int"), "spans")
    if at.where("crowded").limit(1).count():
        around = scratch.write(gathered(at.where("crowded")).mapInArrow(spans_around, "row long, start int, h1 long, h2 long"), "around")
        more = scratch.write(recurring(scratch, around, ["h1", "h2"]).select("row", "start", (F.col("start") + SPAN).alias("end")), "spans")
        scratch.drop(around)
        spans = spans.unionByName(more)
    scratch.drop(at)
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    scratch = Scratch(docs.sparkSession, "suffix")
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("sha"))
    own = scratch.write(own.withColumn("digest", F.unhex(F.substring("sha", 1, 32))), "own")
    texts = unique_texts(scratch, docs, text)
    spans = repeated_spans(scratch, texts, crowd).groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    part = texts.where("copies = 1").select("row", "digest", "packed").join(spans, "row").select("digest", "packed", "starts", "ends").mapInArrow(cut, "digest binary, removed long, spans long, kept string")
    copied = texts.where("copies > 1").select("digest", "copies")
    hot = frequent(copied.withColumnRenamed("copies", "n"), own.count()).select("digest")
    whole = lambda x: x.select("digest", F.lit(None).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept"))
    rest = own.join(F.broadcast(hot), "digest", "left_anti").join(part.unionByName(whole(copied)), "digest", "left")
    out = rest.select("doc_id", "n_bytes", F.when(F.col("spans").isNull(), 0).otherwise(F.coalesce("removed", "n_bytes")).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
    common = own.join(F.broadcast(whole(hot)), "digest")
    return out.unionByName(common.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("kept").alias("kept_sha256")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
