"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over some words: the words at its open positions are hashed, the others are ignored. Hashes of
benchmark items are joined with those of every window of every document, for several masks, so that every overlap that
the rule allows meets its item under one of them: no choice of replaced words is missed. Each hit names a diagonal (place in the document minus
place in the item). Along it the words are compared, and the longest stretch with enough equal words is taken; it
counts if it is long enough (or as long as a short item). Replaced words may be at any place of it.

Words are runs of a-z, 0-9 and characters beyond ASCII, with A-Z in lower case, so punctuation and case do not matter.
Items shorter than `least` words are looked for whole, by masks of their own, with the same share of words replaced;
items of fewer than `least_item` words, null and empty ones never match.

The hashes of the items go into a filter of a bounded size, which every task gets. Documents of which some hash passes
it are kept with their words; their hashes are joined with those of the items, whatever their number, and each diagonal
found is verified on the slices of words that meet there. Most documents leave no row, so little is shuffled.

Null and empty documents match nothing. Documents are judged each by itself, so repeated rows, and rows that share a
doc_id or have none, get their own results. Equal overlaps of a document and an item: the first diagonal counts. An
empty table on either side gives no overlaps. Other columns are not looked at; drop_contaminated() passes them through.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, documents, fresh, holds_memory, remembers, ship, slices, table, texts_of
from .licenses import words_of

# Spaced seeds with 7 open positions each. One of them has a hit in every overlap of 13 words or more of
# which 80 % are equal, wherever the replaced words are; found by search and held to that by a test.
SEEDS = ("101110111", "11100101011", "1111010000011", "110101111", "1001000101111", "1111001011")
SEEDS_LEAST, SEEDS_IDENTITY = 13, "0.8"
#: Pairs of equal windows that are unfolded at once.
HITS_AT_ONCE = 1_000_000
#: Bits that the filter has for each hash, but 2 ** MOST_BITS in all; and bits that a hash sets.
BITS_EACH, MOST_BITS, PROBES = 32, 27, 6
REMEMBERED = 300_000
BLOOM_BITS = 22
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()
remembers("decontam", _hashes.clear)


def word_hashes(text: str) -> np.ndarray:
    w = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, w), _U, len(w))


def open_positions(seed: str) -> list[int]:
    return [i for i, c in enumerate(seed) if c == "1"]


def windows(h: np.ndarray, at: list[int], span: int) -> np.ndarray:
    """One hash for each window of span words, of the words at the open positions."""
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.full(n, _U(span * 1000 + len(at)))
    for i in at:
        out = out * _U(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> _U(32)
    return out * _U(0xD6E8FEB86659FD93)


def replaced(n: int, identity: float) -> int:
    """How many of n words may be replaced."""
    return n - math.ceil(Fraction(str(identity)) * n)


def long_seeds(least: int, identity: float) -> tuple[str, ...]:
    """Masks of which one has a hit in every allowed overlap of `least` words or more.

    An overlap of twice `least` words or more holds a shorter allowed one (one of its halves), so those below that
    count. SEEDS do for their values and for stricter ones; else it is the longest run of equal words that all have.
    """
    if least >= SEEDS_LEAST and Fraction(str(identity)) >= Fraction(SEEDS_IDENTITY):
        return SEEDS
    runs = [-(-(n - replaced(n, identity)) // (replaced(n, identity) + 1)) for n in range(least, 2 * least)]
    return ("1" * max(1, min(runs)),)


def whole_seeds(n: int, identity: float) -> tuple[str, ...]:
    """Masks over n words of which one has a hit if no more words are replaced than allowed: the words are dealt into
    groups, two more than may be replaced, and each mask leaves out as many groups as may be replaced."""
    r = min(replaced(n, identity), n - 1)
    groups = min(r + 2, n) if r else 1
    return tuple("".join("0" if i * groups // n in out else "1" for i in range(n)) for out in itertools.combinations(range(groups), r))


class Masks:
    """The masks for items of these lengths, and the hashes of items and texts under them."""

    def __init__(self, lengths: set[int], least: int, identity: float, least_item: int):
        self.least, self.identity, self.least_item = least, identity, least_item
        # items of which equally many words may be replaced share the masks of the shortest length, at their start
        self.start = {r: n for n in range(least - 1, max(least_item, 1) - 1, -1) for r in [replaced(n, identity)]}
        self.shapes = sorted({x for n in lengths for x in self.of(n)})

    def of(self, n: int) -> list[tuple[str, bool]]:
        """(mask, whether at the start only) for an item of n words."""
        if n >= self.least:
            return [(seed, False) for seed in long_seeds(self.least, self.identity)]
        return [(seed, True) for seed in whole_seeds(self.start[replaced(n, self.identity)], self.identity)] if n >= max(self.least_item, 1) else []

    def hashes(self, h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number of the shape, its span, hash of each window) of a text."""
        for k, (seed, _) in enumerate(self.shapes):
            yield k, len(seed), windows(h, open_positions(seed), len(seed)) ^ _U((k + 1) * 0x9FB21C651E98DF25 % 2**64)

    def item(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of an item, and the place of each."""
        own = set(self.of(len(h)))
        found = [w[: 1 if self.shapes[k][1] else None] for k, _, w in self.hashes(h) if self.shapes[k] in own]
        return np.concatenate([np.empty(0, _U), *found]), np.concatenate([np.empty(0, np.int64), *map(np.arange, map(len, found))])


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES places in a filter of 2 ** bits for each hash."""
    x, step = hashes, (hashes >> _U(17)) | _U(1)
    for _ in range(PROBES):
        yield (x * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)
        x = x + step


def passing(hashes: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    """The places of hashes that the filter may hold."""
    at = None
    for p in probes(hashes, bits):
        p = p if at is None else p[at]
        hit = (held[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1
        at = np.flatnonzero(hit) if at is None else at[hit.astype(bool)]
        if not len(at):
            break
    return at


class Index:
    """The search without Spark, for few items: for each mask, sorted hashes with their item and place."""

    def __init__(self, items: list[np.ndarray], least: int, identity: float, least_item: int):
        self.items, self.least, self.identity = items, least, identity
        masks, by_shape = Masks({len(h) for h in items}, least, identity, least_item), defaultdict(list)
        for k, h in enumerate(items):
            for shape in masks.of(len(h)):
                by_shape[shape].append(k)
        self.shapes = []
        for seed, whole in masks.shapes:
            at, numbers = open_positions(seed), by_shape[seed, whole]
            hashes = [windows(items[k], at, len(seed))[: 1 if whole else None] for k in numbers]
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            bloom = np.zeros(1 << BLOOM_BITS, bool)
            bloom[flat >> _U(64 - BLOOM_BITS)] = True
            self.shapes.append((len(seed), at, flat[order], np.repeat(numbers, [len(x) for x in hashes])[order], np.concatenate([np.arange(len(x)) for x in hashes])[order], bloom))

    def diagonals(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(text, item, place in the text minus place in the item) of all hits, in order. All texts are read at once."""
        ends = np.cumsum([len(h) for h in texts])
        flat, reach = np.concatenate([np.empty(0, _U), *texts]), int(max(map(len, self.items), default=0))
        width = int(ends[-1] if len(ends) else 0) + reach + 1
        found = [np.empty(0, np.int64)]
        for span, at, hashes, owner, place, bloom in self.shapes:
            w = windows(flat, at, span)
            where = np.flatnonzero(bloom[w >> _U(64 - BLOOM_BITS)])
            lo, hi = (np.searchsorted(hashes, w[where], side=s) for s in ("left", "right"))
            inside = (hi > lo) & (where + span <= ends[np.searchsorted(ends, where, side="right")])
            where, lo, n = where[inside], lo[inside], (hi - lo)[inside]
            total = np.cumsum(n)
            a = 0
            while a < len(n):
                done = total[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(total, done + HITS_AT_ONCE, side="right")))
                k = np.arange(total[b - 1] - done) + np.repeat(lo[a:b] - (total[a:b] - n[a:b] - done), n[a:b])
                text = np.repeat(np.searchsorted(ends, where[a:b], side="right"), n[a:b])
                found.append(np.unique((text * len(self.items) + owner[k]) * (2 * width) + np.repeat(where[a:b], n[a:b]) - place[k] + reach))
                a = b
        begins = ends - [len(h) for h in texts]
        for x in np.unique(np.concatenate(found)).tolist():
            pair, d = divmod(x, 2 * width)
            text, item = divmod(pair, len(self.items))
            yield text, item, d - reach - int(begins[text])

    def overlaps(self, texts: list[np.ndarray]) -> list[dict[int, tuple[int, int, int, int]]]:
        """For each text: item → (equal words, words, first word in the text, first word in the item) of its best overlap."""
        out: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        for t, k, d in self.diagonals(texts):
            h, item, best_of = texts[t], self.items[k], out[t]
            a, b = max(0, -d), min(len(item), len(h) - d)
            equal = item[a:b] == h[a + d : b + d]
            if (best := stretch(equal, self.identity, min(self.least, len(item)))) is None:
                continue
            s, e = best
            n, same = e - s, int(equal[s:e].sum())
            if k not in best_of or same > best_of[k][0]:
                best_of[k] = (same, n, a + s + d, a + s)
        return out


def stretch(equal: np.ndarray, identity: float, least: int) -> tuple[int, int] | None:
    """The longest stretch of `least` words or more that has the wanted share of equal ones, the first of that length.

    A stretch has the share if its sum is not negative, when a replaced word costs what the equal ones of that share
    gain; sums are of whole numbers. For each end the furthest start is the first with a sum that is not above the
    end's. Replaced words at the ends are left out as far as `least` words remain.
    """
    share = Fraction(str(identity))
    if len(equal) < least or int(equal.sum()) < share * least:
        return None
    total = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator))])
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    length = np.arange(len(total)) - start
    end = int(length.argmax())
    first = int(start[end])
    if end - first < least:
        return None
    while end - first > least and not equal[end - 1]:
        end -= 1
    while end - first > least and not equal[first]:
        first += 1
    return first, end


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of benchmark (item_id, text): hashes of the words of each different item."""
    arrow = arrow_schema(benchmark.sparkSession, "item_id long, words array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [word_hashes(x).view(np.int64) for x in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, arrow.field(1).type)], schema=arrow)

    src = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    return src.mapInArrow(run, "item_id long, words array<long>").withColumn("item", F.monotonically_increasing_id())


def hashed_items(items: DataFrame, masks: Masks) -> DataFrame:
    """(hash, item, place, shape is in the hash) of items."""
    arrow = arrow_schema(items.sparkSession, "hash long, item long, place long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for item, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h, place = masks.item(words.values.to_numpy().view(_U))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)), pa.array(place)], schema=arrow)

    return items.select("item", "words").mapInArrow(run, "hash long, item long, place long")


def filter_of(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """Bytes and size (as a power of two) of a filter that holds all hashes: 2 ** MOST_BITS bits at most, whatever their
    number; a filter that is too full lets more documents pass, which the join then leaves out."""
    n = hashed.count()
    bits = min(MOST_BITS, max(10, (BITS_EACH * max(1, n) - 1).bit_length()))
    arrow = arrow_schema(hashed.sparkSession, "at long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in probes(b.column(0).to_numpy(zero_copy_only=False).view(_U), bits):
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64))], schema=arrow)

    places = hashed.select("hash").mapInArrow(run, "at long")
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    held = np.zeros(1 << (bits - 6), np.int64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return held.view(np.uint8), bits


def passed(docs: DataFrame, masks: Masks, held: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, th, words, hits) of docs (doc_id, th, text) of which some hash may be an item's; hits (hash, at)."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, words array<long>, hits array<struct<hash:bigint,at:bigint>>"
    arrow, sent = arrow_schema(spark, schema), spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_memory("decontam")
        for b in slices(batches):
            texts = [word_hashes(x) for x in texts_of(b, "text")]
            ends = np.cumsum([len(h) for h in texts])
            flat = np.concatenate(texts)
            hashes, at = [np.empty(0, _U)], [np.empty(0, np.int64)]
            for _, span, w in masks.hashes(flat):  # all texts at once
                p = passing(w, sent.value, bits)
                p = p[p + span <= ends[np.searchsorted(ends, p, side="right")]]
                hashes.append(w[p])
                at.append(p)
            hashes, at = np.concatenate(hashes), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            hashes, at = hashes[order], at[order]
            owner = np.searchsorted(ends, at, side="right")
            some, first = np.unique(owner, return_index=True)
            if len(some):
                begin = ends - [len(h) for h in texts]
                hits = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(at - begin[owner])], names=["hash", "at"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), hits)
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([texts[i].view(np.int64) for i in some], pa.list_(pa.int64())), lists.cast(arrow.field(3).type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def overlaps_of(docs: DataFrame, benchmark: DataFrame, least: int, identity: float, least_item: int, scratch: Scratch) -> DataFrame:
    """(row, doc_id, th, item_id, n_equal, n_words, doc_word, item_word) of docs (doc_id, th, text): the best overlap of
    each document and item."""
    ship(docs.sparkSession)
    kind = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, item_id long, n_equal long, n_words long, doc_word long, item_word long"
    items = scratch.keep(items_of(benchmark))
    lengths = {r["n"] for r in items.select(F.least(F.size("words"), F.lit(least)).alias("n")).distinct().collect()}  # `least` + 1 rows at most
    masks = Masks(lengths, least, identity, least_item)
    if not masks.shapes:
        return docs.sparkSession.createDataFrame([], kind)
    hashed = scratch.keep(hashed_items(items, masks))
    found = scratch.keep(passed(docs, masks, *filter_of(hashed)).withColumn("row", F.monotonically_increasing_id()))
    hits = found.select("row", F.explode("hits").alias("h")).select("row", "h.hash", "h.at")
    lines = scratch.keep(hits.join(hashed, "hash").select("row", "item", (F.col("at") - F.col("place")).alias("d")).distinct())

    n, m, d = F.size("words"), F.size("item_words"), F.col("d")
    start = F.greatest(F.lit(0), -d)  # in the item
    size = F.least(m.cast("long"), n - d) - start
    part = lambda words, at: F.slice(words, (at + 1).cast("int"), size.cast("int"))
    met = lines.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").join(found.select("row", "doc_id", "th", "words"), "row")
    met = met.select("row", "doc_id", "th", "item", "item_id", "d", start.alias("start"), m.alias("m"), part("words", start + d).alias("x"), part("item_words", start).alias("y"))
    columns = met.drop("m", "x", "y")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema) + ", n_equal long, n_words long, first long"
    arrow = arrow_schema(docs.sparkSession, schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, rows = [], []
            for i, (m, x, y) in enumerate(zip(*(b.column(b.schema.get_field_index(c)) for c in ("m", "x", "y")), strict=True)):
                equal = x.values.to_numpy() == y.values.to_numpy()
                if (best := stretch(equal, identity, min(least, m.as_py()))) is not None:
                    at.append(i)
                    rows.append((int(equal[best[0] : best[1]].sum()), best[1] - best[0], best[0]))
            if at:
                got = [b.column(b.schema.get_field_index(f.name)).take(pa.array(at)) for f in list(arrow)[:-3]]
                yield pa.RecordBatch.from_arrays([*got, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], schema=arrow)

    good = met.mapInArrow(verify, schema)
    best = good.groupBy("row", "item").agg(F.min(F.struct((-F.col("n_equal")).alias("by"), "d", "doc_id", "th", "item_id", "n_equal", "n_words", (F.col("start") + F.col("first")).alias("at"))).alias("b"))
    return best.select("row", "b.doc_id", "b.th", "b.item_id", "b.n_equal", "b.n_words", (F.col("b.at") + F.col("b.d")).alias("doc_word"), F.col("b.at").alias("item_word"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13, identity: float = 0.8, least_item: int = 6) -> DataFrame:
    """One row for each document and item that overlap: the best overlap's words and places (counted in words).

    least: the fewest words of an overlap; a shorter item must be there from its first word to
    its last. identity: the share of equal words, of shorter items too.
    """
    scratch = Scratch(docs.sparkSession, "overlaps")
    found = overlaps_of(_hashed(docs, id_col, text_col), benchmark, least, identity, least_item, scratch)
    return found.select("doc_id", "item_id", "n_equal", "n_words", "doc_word", "item_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13, identity: float = 0.8, least_item: int = 6) -> DataFrame:
    """docs without those that overlap a benchmark item."""
    scratch = Scratch(docs.sparkSession, "overlaps")
    found = overlaps_of(_hashed(docs, id_col, text_col), benchmark, least, identity, least_item, scratch)
    i, t = fresh(docs, "__id", "__th")
    gone = scratch.keep(found.select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct())
    scratch.drop_all_but(gone)
    return docs.join(gone, docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(t)), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
