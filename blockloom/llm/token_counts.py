"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes are its initial symbols, kept in a doubly linked list. A heap gives the adjacent pair of lowest
merge rank, leftmost first; each merge takes one symbol away and pushes the two pairs it makes. The count is the
initial symbols minus the merges: no identifier is looked up or emitted. A pre-token of n bytes costs O(n log n),
so a text without a space is no special case.

Null and empty texts have 0 tokens. Repeated rows and ties get equal counts. Other columns are passed through."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import table

#: Distinct pre-tokens that a worker remembers, and their characters at most; beyond it the memory is emptied, which changes no count.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
LIMIT = 1024


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeCounter(dict):
    """text of a pre-token -> number of its tokens, reckoned on first sight."""

    def __init__(self, spec: bytes):
        super().__init__()
        t = json.loads(spec)
        pre, added = t.get("pre_tokenizer") or {}, t.get("added_tokens") or []
        if t["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or t.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser or prefix space is supported")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens that strip, need whole words or are normalised aren't supported")
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in added)) if added else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        symbols: dict[str, int] = byte_symbols()
        number = lambda s: symbols.setdefault(s, len(symbols))
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(t["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(number(left) << 32 | number(right), r)
            self.made.append(number(left + right))

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode())
        if len(word) <= REMEMBERED_LENGTH:
            self[word] = n
        return n

    def count(self, data: bytes) -> int:
        rank, made, symbols, n = self.rank.get, self.made, list(data), len(data)
        heap = [(r, i) for i, (a, b) in enumerate(zip(data, data[1:])) if (r := rank(a << 32 | b)) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            r, i = heappop(heap)
            a = symbols[i]
            if a < 0 or (j := after[i]) >= n or rank(a << 32 | symbols[j]) != r:
                continue  # one of the pair has been merged meanwhile
            symbols[i], symbols[j] = (s := made[r]), -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (x := rank(s << 32 | symbols[k])) is not None:
                    heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank(symbols[h] << 32 | s)) is not None:
                heappush(heap, (x, h))
        return left

    def tokens(self, text: str) -> int:
        n = 0
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
            n += len(pieces) - 1  # each special string is one token
            for piece in pieces:
                n += sum(map(self.__getitem__, self.split(piece)))
        else:
            n = sum(map(self.__getitem__, self.split(text)))
        if len(self) > REMEMBERED:
            self.clear()
        return n


def token_count(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Tokens of text under the vocabulary file at path (read by the driver, of fixed size), as a long."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = MergeCounter(spec.value)
        for texts in batches:
            yield pd.Series([counter.tokens(x) if x else 0 for x in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_count(spark, F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
