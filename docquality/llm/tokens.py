"""Encoding with a public byte-level BPE vocabulary, and the exact length histogram (operator 5).

A byte-level BPE never merges across the boundary before a space that follows text, so a text is split at its spaces
and the ids of each chunk are remembered. The memory is bounded; texts with runs of white space, where the boundary
does not hold, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, holds_memory, remembers, ship, slices, texts_of

VOCABULARY = "byte_bpe_50k.json"
#: Chunks remembered by one Python worker, some 150 bytes each.
REMEMBERED = 400_000
_RUN = re.compile(r"  |\s \s")


@functools.cache
def _letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a vocabulary file of the `tokenizers` library. added: whether the strings of its added tokens are read as
    those tokens, as the library does unless encode_special_tokens is set; else they are plain text."""

    def __init__(self, path: str, added: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = _letters(), {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.added = {k: np.array([i], dtype="<u4").tobytes() for k, i in special.items()} if added else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("docquality", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self.bpe.encode_ordinary

        class Memory(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                out = self[chunk] = np.array(encode(chunk), dtype="<u4").tobytes()
                return out

        self.memory = Memory()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.cut is None or not any(x in text for x in self.added):
            return self.plain(text)
        return b"".join(self.added[x] if x in self.added else self.plain(x) for x in self.cut.split(text))

    def plain(self, text: str) -> bytes:
        if _RUN.search(text):
            return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        look = self.memory.__getitem__
        return (look(first) if first else b"") + b"".join(map(look, map(" ".__add__, rest)))

    def length(self, text: str) -> int:
        return len(self.ids(text)) >> 2


def encoder(path: str, added: bool = False) -> Encoder:
    """One for each Python worker."""
    holds_memory("tokens")
    return _encoder(path, added)


@functools.cache
def _encoder(path: str, added: bool) -> Encoder:
    return Encoder(path, added)


remembers("tokens", _encoder.cache_clear)


def default_vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length. A null or empty text has length 0.

    Each task counts its own rows before the shuffle, so what is shuffled follows the distinct lengths.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths: Counter[int] = Counter()
        length = encoder(path, added=True).length
        for b in slices(batches):
            lengths.update(map(length, texts_of(b, "text")))
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(lengths), pa.int64()), "n_docs": pa.array(list(lengths.values()), pa.int64())})

    counts = docs.select(docs[text_col].alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_table(histogram: DataFrame, block: int = 64) -> DataFrame:
    """For every occurring length, taken as a context limit: documents and tokens at, up to and beyond it, the tokens
    left after truncation to it, and the share of documents that fit (their quantile).

    Suffix sums run within blocks of lengths, in parallel, over a running sum of block totals; the latter has one row
    for each `block` lengths up to the longest document.
    """
    h = histogram.withColumns({"block": F.floor(F.col("n_tokens") / block), "tokens": F.col("n_tokens") * F.col("n_docs")})
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    up = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("block", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("t0"), F.sum("d").over(W.partitionBy()).alias("all_docs"), F.sum("t").over(W.partitionBy()).alias("all_tokens"))
    to = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    x = h.join(before, "block").withColumns({"docs_within": F.col("d0") + F.sum("n_docs").over(to), "tokens_within": F.col("t0") + F.sum("tokens").over(to)})
    over = F.col("all_docs") - F.col("docs_within")
    return x.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "docs_within", over.alias("docs_over"), "tokens_within",
        (F.col("tokens_within") + over * F.col("n_tokens")).alias("tokens_truncated"), F.col("all_tokens").alias("tokens_total"),
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """The truncated totals for any limits, occurring as lengths or not; no row for an empty histogram."""
    at = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    fits = F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)
    cut = F.least("n_tokens", "context_limit") * F.col("n_docs")
    return histogram.select(at, "n_tokens", "n_docs").groupBy("context_limit").agg(F.sum(fits).alias("docs_within"), F.sum(cut).alias("tokens_truncated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_table(Scratch(spark, "lengths").keep(length_histogram(documents(spark, sf_dir, "text"))))
