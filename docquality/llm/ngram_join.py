"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, hashed to 64 bits. A sketch of it has k blocks of 64 bits: each
shingle belongs to one block and is XORed into it. A shingle that only one of two sets has changes one block at most,
so the number of blocks in which two sketches differ is a lower bound of the symmetric difference. Sets of a size band
that are similar enough have a symmetric difference of at most d; with k > d blocks k - d at least are equal (pigeonhole). Blocks
are the join keys. A set enters its own band and each band in which a larger partner may be.

An empty block says nothing, so it is no key. A set with k - d empty blocks or more also enters the next arrangement,
with other blocks, and after the last one all its shingles are keys. So no pair is lost to empty blocks.

Sets that are equal form one class from the start and enter once. Each class is compared with the class that is the least
under most of its keys; where that joins all classes of a key into one component (as with copies of a page, however many)
nothing is left to do. Otherwise pairs of different components are compared, for keys of few classes. Those of a key of many are compared
with another one of them. What is left is alike, but not similar enough; classes that such keys connect are a cluster,
and are compared in blocks, by longer sketches, without a row for each pair. Those of a very large cluster enter another
arrangement first, where sets that merely share a passage hardly meet again. So no group is expanded into all of its pairs, and no link is lost.

Pairs are first held against 512-bit parity sketches (one bit for each shingle; their Hamming distance is a lower bound
of the symmetric difference, too), then against longer ones, which tell long texts apart; for what is left the shingle
sets are made from the texts again and intersected exactly. Sets take more room than the texts they are made of, so they
are neither written nor moved; texts and sketches are moved in parts, of which one is on disk at a time.

Keys are made in PARTS by their hash, each a column of its own: one part is read and shuffled at a time. Keys that very
many classes share are known from a sample beforehand; they are combined before the shuffle, and joins are between
written tables, so that Spark can split a crowded key among tasks.

Defined results: null or empty texts, and texts without words, have no shingles and no links; texts with fewer words
than a shingle are one shingle; rows of equal text always link; a null doc_id takes the id of its component, if there
is one. Rows that share a doc_id are linked each by its own text, and one of them is enough to carry the id. An empty
table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, documents, fresh, holds_memory, map_batches, remembers, ship, slices, texts_of
from .components import components

BITS, LONG_BITS = 512, 4096
#: Sets that are compared with each other, or with as many others, at a time.
BLOCK = 512
ARRANGEMENTS = 5
#: Classes under one key of which all pairs between components are compared at once; beyond, the key is arranged anew.
FEW = 24
#: Classes of a cluster that is compared in blocks at once.
CLUSTER = 16_384
#: Parts in which keys, and texts, are shuffled, one after the other.
PARTS = 4
#: Pairs, or sketches, that are moved at a time; or as many as there are sets to compare, if they are more.
MOVED = 200_000
#: Of every SAMPLED-th class the keys are counted; a key that SEEN of them have is crowded.
SAMPLED, SEEN = 32, 16
REMEMBERED = 300_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()
remembers("ngram", _words.clear)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z in lower case, words between ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, _U)
    h = np.fromiter(map(_words.__getitem__, w), _U, len(w))
    n = min(words, len(w))
    s = np.full(len(w) - n + 1, _U(n))
    for i in range(n):
        s = s * _U(0x9E3779B97F4A7C15) + h[i : len(w) - n + 1 + i]
    return np.unique(mix(s))


class Bands:
    """Size bands for Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [1]

    def difference(self, total: int) -> int:
        """The largest symmetric difference of similar sets with so many elements in all."""
        return (self.den - self.num) * total // (self.den + self.num)

    def blocks(self, band: int, d: int) -> int:
        """More than d: with one and a half times the empty blocks that the smallest sets of the band should have."""
        smallest = self.tops[band - 1] * self.num / self.den
        return d + 1 + (1 + int(1.5 * d * math.exp(-smallest / d)) if d >= 8 else 0)

    def entries(self, n: int) -> list[tuple[int, int]]:
        """(band, d, blocks) for a set of n: its own band to that of its largest partner, but those of equal sets only."""
        largest = n * self.den // self.num
        while self.tops[-1] < largest:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 13 // 10))
        first, last = (int(np.searchsorted(self.tops, x)) for x in (n, largest))
        return [(j, d, self.blocks(j, d)) for j in range(first, last + 1) if (d := self.difference(2 * self.tops[j]))]


def block_keys(shingles: np.ndarray, bands: Bands, first_arrangement: int = 0) -> np.ndarray:
    """The join keys of a set."""
    out = []
    for band, d, k in bands.entries(len(shingles)):
        for a in range(first_arrangement, first_arrangement + ARRANGEMENTS):
            # blocks are ranges of the (rearranged) hashes, so sorting them puts each block together
            s = shingles if a == 0 else np.sort(mix(shingles + _U(a * 0x632BE59BD9B4E019 % 2**64)))
            edges = np.searchsorted(s, (np.arange(k, dtype=np.float64) * (2.0**64 / k)).astype(_U))
            sizes = np.diff(np.append(edges, len(s)))
            full = sizes > 0
            xor = np.bitwise_xor.reduceat(mix(s ^ _U(0x5851F42D4C957F2D)), edges[full])
            salt = mix(np.array([(band * 31 + a) % 2**64], _U)) + np.flatnonzero(full).astype(_U)
            out.append(mix(xor ^ mix(salt)))
            if k - full.sum() < k - d:
                break
        else:
            out.append(mix(shingles ^ _U((band + 1) * 0x2545F4914F6CDD1D % 2**64)))
    return np.concatenate(out) if out else np.empty(0, _U)


def parity(shingles: np.ndarray, size: int = BITS) -> bytes:
    bits = np.bincount((mix(shingles + _U(7)) % _U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketches(docs: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(doc_id, th, n, set_id, parity, k0, k1, ...) of docs (doc_id, th, text), written. set_id stands for the set: equal
    sets have equal ones, 0 is the empty set. k0 and on have the keys, in PARTS.

    Of equal sets that one task meets, the first has the parity and the keys, so copies are reduced before the shuffle.
    """
    ship(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, set_id long, parity binary" + "".join(f", k{p} array<long>" for p in range(PARTS))
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_memory("ngram")
        bands, seen = Bands(num, den), set()
        for b in slices(batches):
            rows = []
            for text in texts_of(b, "text"):
                s = shingle_set(text, words)
                c = set_id(s)
                if c in seen or not len(s):
                    rows.append((len(s), c, *[None] * (1 + PARTS)))
                    continue
                seen.add(c)
                keys = block_keys(s, bands)
                part = keys % _U(PARTS)
                rows.append((len(s), c, parity(s), *[keys[part == p].view(np.int64) for p in range(PARTS)]))
            columns = [pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), list(arrow)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], schema=arrow)

    return scratch.keep(docs.select("doc_id", "th", "text").mapInArrow(run, schema))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else 0


def crowded_keys(sketched: DataFrame, parts: int) -> DataFrame:
    """(key) of keys that very many classes share, by those of every SAMPLED-th class: a few keys, since each has some
    SAMPLED * SEEN rows at least. It need not be exact: either way of grouping gives the same rows."""
    some = sketched.filter(F.pmod(F.xxhash64("set_id"), F.lit(SAMPLED)) == 0)
    keys = some.select("set_id", F.explode(F.flatten(F.array_compact(F.array(*[f"k{p}" for p in range(parts)])))).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN).select("key")


def groups_under_keys(keyed: DataFrame, scratch: Scratch, crowded: DataFrame | None = None) -> DataFrame:
    """keyed (key, set_id) → (key, set_id, least) of the keys with two classes or more; least: the least class there.

    The classes of crowded keys are aggregated, so that they are combined before the shuffle, and joined with their
    least one, which Spark can split. All other rows are moved once and grouped as they come.
    """
    if crowded is None:
        return scratch.keep(sorted_groups(keyed))
    some = scratch.keep(keyed.join(crowded, "key").distinct())
    least = scratch.keep(some.groupBy("key").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).filter("least < most").select("key", "least"))
    rest = sorted_groups(keyed.join(crowded, "key", "left_anti"))
    return scratch.keep(rest.union(some.join(least, "key").select("key", "set_id", "least")))


def sorted_groups(keyed: DataFrame) -> DataFrame:
    """groups_under_keys() by a sorted pass, which sees one key after the other and holds one row of it; equal rows are
    passed over."""
    arrow = arrow_schema(keyed.sparkSession, "key long, set_id long, least long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # the last key, its least class, whether that has been given out; and its last class
        for b in batches:
            key, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            if last is not None:
                key, c = np.concatenate([[last[0]], key]), np.concatenate([[last[2]], c])
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            least = c[starts].copy()
            if last is not None:
                least[0] = last[1]
            each = np.repeat(least, np.diff(np.append(starts, len(key))))
            new = np.append(True, (key[1:] != key[:-1]) | (c[1:] != c[:-1]))
            if last is not None:
                new[0] = False
            follow = new & (c != each)  # classes beyond the least
            # the least class itself is given once, with the first that follows it
            where = np.flatnonzero(follow)
            opened = {last[0]} if last is not None and last[3] else set()
            first_of = where[np.append(True, key[where][1:] != key[where][:-1])] if len(where) else where
            lead = np.array([i for i in first_of if key[i] not in opened], dtype=np.int64)
            k, s, m = np.concatenate([key[where], key[lead]]), np.concatenate([c[where], each[lead]]), np.concatenate([each[where], each[lead]])
            given = bool(len(where)) and key[where[-1]] == key[-1] or last is not None and key[-1] == last[0] and last[3]
            last = (key[-1], each[-1], c[-1], given)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s), pa.array(m)], schema=arrow)

    dealt = keyed.repartition("key").sortWithinPartitions("key", "set_id")
    return dealt.mapInArrow(run, "key long, set_id long, least long")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def apart_at_most(batch: pa.RecordBatch, x: str, y: str, size: int, num: int, den: int) -> pa.Array:
    """Whether the parity sketches x and y of sets of na and nb shingles leave it open that they are similar."""
    c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    bits = [np.frombuffer(b"".join(c[n].to_pylist()), np.uint64).reshape(-1, size // 64) for n in (x, y)]
    apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
    return pa.array(apart * (den + num) <= (den - num) * (c["na"].to_numpy() + c["nb"].to_numpy()))


def verified(pairs: DataFrame, bodies: DataFrame, slim: DataFrame, words: int, num: int, den: int, scratch: Scratch, most: int) -> DataFrame:
    """The pairs (a, b) that link, by their parity sketches, the short ones first, and then by their sets. `most` pairs, or
    some more, are held against the long sketches and the texts at a time; of these only what is in a pair is moved."""
    s = slim.select("set_id", "n", "parity")
    p = pairs.join(s.toDF("a", "na", "pa"), "a").join(s.toDF("b", "nb", "pb"), "b")
    least, greatest = F.least("na", "nb"), F.greatest("na", "nb")
    p = p.filter(den * least >= num * greatest)
    sized = "a long, b long, na long, nb long"

    def near(x: str, y: str, size: int):
        def f(batch: pa.RecordBatch) -> dict:
            keep = apart_at_most(batch, x, y, size, num, den)
            return {n: batch.column(batch.schema.get_field_index(n)).filter(keep) for n in ("a", "b", "na", "nb")}

        return f

    def exact(batch: pa.RecordBatch) -> dict:
        c, sets = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}, {}

        def of(i: int, text: pa.StringScalar) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(text.as_py(), words)
            return sets[i]

        a, b = c["a"].to_pylist(), c["b"].to_pylist()
        keep = pa.array([similar(of(i, x), of(j, y), num, den) for i, j, x, y in zip(a, b, c["x"], c["y"], strict=True)], pa.bool_())
        return {n: c[n].filter(keep) for n in ("a", "b")}

    def joined(close: DataFrame, column: str, x: str, y: str) -> DataFrame:
        ids = scratch.keep(close.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), (close,))
        some = bodies.select("set_id", column).join(scratch.small(ids), "set_id", "left_semi")
        return close.join(some.toDF("a", x).hint("merge"), "a").join(some.toDF("b", y).hint("merge"), "b")

    close = scratch.keep(map_batches(p.select("a", "b", "na", "nb", "pa", "pb"), near("pa", "pb", BITS), sized), (pairs, slim))
    parts, out = 1 + close.count() // most, None
    for i in range(parts):
        part = close if parts == 1 else scratch.keep(close.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i), (close,))
        long = joined(part, "sketch", "sa", "sb").select("a", "b", "na", "nb", "sa", "sb")
        closer = scratch.keep(map_batches(long, near("sa", "sb", LONG_BITS), sized))
        full = joined(closer, "text", "x", "y").select("a", "b", "x", "y")
        good = scratch.keep(map_batches(full, exact, "a long, b long"))
        out = good if out is None else out.union(good)
    return out


def links(sketched: DataFrame, found: DataFrame, docs: DataFrame, scratch: Scratch, words: int, num: int, den: int) -> DataFrame:
    """(node, root) of the set classes that link, from sketches()."""
    spark = docs.sparkSession
    crowded = scratch.keep(crowded_keys(sketched, PARTS))
    under, under_tables = None, []
    for p in range(PARTS):
        part = groups_under_keys(sketched.select(F.explode(f"k{p}").alias("key"), "set_id"), scratch, crowded)
        under_tables.append(part)
        under = part if under is None else under.union(part)
    scratch.drop(sketched)
    classes = found.filter("n > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.any_value("n").alias("n"), F.max("parity").alias("parity"))
    slim = scratch.keep(under.select("set_id").distinct().join(classes, "set_id"))
    body = "set_id long, n long, sketch binary, text string"
    kind = arrow_schema(spark, body)

    def to_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_memory("ngram")
        seen = set()
        for b in slices(batches):
            rows = []
            for x in texts_of(b, "text"):
                s = shingle_set(x, words)
                c = set_id(s)
                if c not in seen:  # rows that repeat id and text; if they are dealt to several tasks, each has them once
                    seen.add(c)
                    rows.append((c, len(s), parity(s, LONG_BITS), x))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    # texts and classes are always brought together by a shuffle, so that the plan is the same at every size; a part at a time
    wanted = scratch.keep(slim.select(F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("t")))
    bodies = None
    for p in range(PARTS):
        texts = docs.filter(F.pmod(F.xxhash64("doc_id", "th"), F.lit(PARTS)) == p).hint("merge")
        here = wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(PARTS)) == p)
        texts = texts.join(here, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_semi").select("text")
        part = scratch.keep(texts.mapInArrow(to_bodies, body))
        bodies = part if bodies is None else bodies.union(part)
    most = max(MOVED, bodies.count())

    edges = None
    tried = None
    roots = None

    def settle(pairs: DataFrame) -> None:
        """Compare pairs, and find the components anew."""
        nonlocal edges, tried, roots
        pairs = scratch.keep(pairs.distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti"), (slim,))
        tried = pairs if tried is None else tried.union(pairs)
        good = verified(pairs, bodies, slim, words, num, den, scratch, most)
        # with the old roots in place of the old links the graph stays small
        edges = good if roots is None else good.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = scratch.keep(components(edges, scratch), (slim,))

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots.toDF("set_id", "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))

    def unsettled(rows: DataFrame) -> DataFrame:
        """(key, set_id, root, many): rows of the keys whose classes are in more than one component."""
        rows = scratch.keep(rooted(rows.select("key", "set_id")), tuple(under_tables))
        open_keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
        open_keys = scratch.keep(open_keys.select("key", (F.col("size") > FEW).alias("many")), (rows,))
        return scratch.keep(rows.join(open_keys, "key"), (rows,))

    def across(rows: DataFrame) -> DataFrame:
        x, y = rows.select("key", F.col("set_id").alias("a"), F.col("root").alias("ra")), rows.select("key", F.col("set_id").alias("b"), F.col("root").alias("rb"))
        return x.join(y, "key").filter("a < b and ra <> rb").select("a", "b")

    def to_another(rows: DataFrame) -> DataFrame:
        """Each class with one class of its key that stands for it by chance, if they are in different components."""
        chosen = scratch.keep(rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "set_id").alias("by"), "set_id", "root")).alias("c")), (slim,))
        x = rows.join(chosen, "key").filter(F.col("root") != F.col("c.root"))
        return x.select(F.least("set_id", "c.set_id").alias("a"), F.greatest("set_id", "c.set_id").alias("b"))

    def mostly(rows: DataFrame) -> DataFrame:
        """Each class with the least class that it shares most keys with: one pair for each."""
        n = rows.filter("set_id <> least").groupBy("least", "set_id").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("set_id").agg(F.max(F.struct("n", F.col("least").alias("l"))).alias("m")).select(F.col("m.l").alias("a"), F.col("set_id").alias("b"))

    def first_rounds() -> DataFrame:
        """Compare what keys tell to be likely; the rows of keys of many classes that are in several components still."""
        settle(mostly(under))
        rest = unsettled(under)
        settle(across(rest.filter("not many")).union(to_another(rest.filter("many"))))
        return unsettled(rest.filter("many"))

    def clusters_of(rest: DataFrame) -> DataFrame:
        """(set_id, cluster) of classes that keys connect."""
        ends = rest.groupBy("key").agg(F.min("set_id").alias("a")).join(rest.select("key", F.col("set_id").alias("b")), "key").select("a", "b")
        return scratch.keep(components(ends, scratch).toDF("set_id", "cluster"), (rest,))

    def in_blocks(clusters: DataFrame) -> None:
        """Compare all that is in different components of a cluster, by long parity sketches, in blocks."""
        where = scratch.keep(rooted(clusters), (clusters,))
        settle(close_pairs(bodies.select("set_id", "n", "sketch"), where, num, den, scratch, most))

    rest = first_rounds()
    if rest.isEmpty():
        return roots
    clusters = clusters_of(rest)
    sizes = scratch.keep(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), (clusters,))
    in_blocks(scratch.keep(clusters.join(sizes.filter(F.col("n") <= CLUSTER).select("cluster"), "cluster", "left_semi").select("set_id", "cluster"), (clusters,)))
    large = scratch.keep(clusters.join(sizes.filter(F.col("n") > CLUSTER).select("cluster"), "cluster", "left_semi").select("set_id"), (clusters,))
    if not large.isEmpty():  # similar sets share a key in any arrangement: the classes of large clusters enter another one
        under = groups_under_keys(scratch.keep(anew(large, bodies, words, num, den)), scratch)
        under_tables = [under]
        rest = first_rounds()
        if not rest.isEmpty():
            in_blocks(clusters_of(rest))
    return roots


def anew(rows: DataFrame, bodies: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(key, set_id) of sets in another arrangement."""
    arrow = arrow_schema(rows.sparkSession, "key long, set_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_memory("ngram")
        bands = Bands(num, den)
        for b in slices(batches):
            for c, text in zip(b.column(0), texts_of(b, "text"), strict=True):
                k = block_keys(shingle_set(text, words), bands, ARRANGEMENTS)
                yield pa.RecordBatch.from_arrays([_signed(k), pa.array(np.full(len(k), c.as_py()))], schema=arrow)

    return bodies.select("set_id", "text").join(rows, "set_id", "left_semi").mapInArrow(run, "key long, set_id long")


def close_pairs(sketched: DataFrame, where: DataFrame, num: int, den: int, scratch: Scratch, most: int) -> DataFrame:
    """(a, b) of the sets (set_id, n, sketch) that where, a kept table (cluster, set_id, root), has in one cluster and under
    different roots, and whose long parity sketches do not rule out that they are similar. A cluster is dealt in blocks,
    and a pair of blocks is held at a time. A sketch goes to as many units as its cluster has blocks, so units are dealt
    in parts of about `most` sketches, and only one part is on disk."""
    pair = arrow_schema(where.sparkSession, "a long, b long")
    blocks = scratch.keep(where.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), (where,))
    dealt = where.join(blocks.select("cluster", "blocks"), "cluster").withColumn("mine", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    x = sketched.join(scratch.small(scratch.keep(dealt, (where,))), "set_id")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    unit = F.transform(each, lambda p: F.struct(F.xxhash64("cluster", p["i"], p["j"]).alias("unit"), (p["i"] == p["j"]).alias("same")))
    parts = 1 + (blocks.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0) // most

    def part(i: int) -> DataFrame:
        units = F.filter(unit, lambda u: F.pmod(u["unit"], F.lit(parts)) == i)
        return x.withColumn("u", F.explode(units)).select("u.unit", "u.same", "mine", "set_id", "root", "n", "sketch")

    def compare(rows: list[dict]) -> pa.RecordBatch:
        of = {k: np.array([r[k] for r in rows]) for k in ("set_id", "root", "n", "mine")}
        bits = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint64).reshape(len(rows), -1)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(rows) - 1):
            j = slice(i + 1, None)
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = (apart * (den + num) <= (den - num) * (of["n"][j] + of["n"][i])) & (of["root"][j] != of["root"][i])
            if not rows[0]["same"]:
                near &= of["mine"][j] != of["mine"][i]
            other = of["set_id"][j][near]
            a.append(np.minimum(other, of["set_id"][i]))
            b.append(np.maximum(other, of["set_id"][i]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["unit"] != r["unit"]:
                    yield compare(held)
                    held = []
                held.append(r)
        if held:
            yield compare(held)

    out = None
    for i in range(parts):
        found = part(i).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")
        found = found if parts == 1 else scratch.keep(found)
        out = found if out is None else out.union(found)
    return out


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.xxhash64(docs[text_col]), F.lit(0)).alias("th"), docs[text_col].alias("text"))


def grouped(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, th, n, set_id, root) of docs (doc_id, th, text); root stands for the component, null without shingles."""
    scratch = Scratch(docs.sparkSession, "ngram")
    sketched = sketches(docs, words, num, den, scratch)
    found = scratch.keep(sketched.select("doc_id", "th", "n", "set_id", "parity"))
    roots = links(sketched, found, docs, scratch, words, num, den)
    rooted = found.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(roots.toDF("set_id", "root"), "set_id", "left")
    out = scratch.keep(rooted.select("doc_id", "th", "n", "set_id", F.coalesce("root", "set_id").alias("root")))
    scratch.drop_all_but(out)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document. Documents link at a Jaccard similarity of num / den of
    their sets of `words`-word shingles; component_id is the least doc_id that links reach."""
    part = grouped(_hashed(docs, id_col, text_col), words, num, den)
    scratch = Scratch(docs.sparkSession, "ngram")
    least = scratch.keep(part.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = part.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one row of each component: the least by doc_id (null last) and hash of the text; of rows that repeat
    both, any one. Rows without shingles stay, as they are alike to nothing."""
    part = grouped(_hashed(docs, id_col, text_col), words, num, den)
    scratch = Scratch(docs.sparkSession, "keep")
    i, t, copies = fresh(docs, "__id", "__th", "__copies")
    own = part.filter("root is not null").groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "n")).alias("r"))
    first = first.select(F.col("r.doc_id").alias(i), F.col("r.th").alias(t), F.col("r.n").alias(copies))
    empty = part.filter("root is null").select(F.col("doc_id").alias(i), F.col("th").alias(t), F.lit(1).cast("long").alias(copies)).distinct()
    stay = scratch.keep(first.union(empty))
    th = F.coalesce(F.xxhash64(docs[text_col]), F.lit(0))
    kept = docs.hint("merge").join(stay, docs[id_col].eqNullSafe(F.col(i)) & (th == F.col(t)))
    once = kept.filter(F.col(copies) == 1).select(docs.columns)
    return once.union(kept.filter(F.col(copies) > 1).select(docs.columns).dropDuplicates([id_col, text_col]))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"), words=4, num=85, den=100)


ORACLE_SQL = """
with words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
    from words
), shingles as (
    select doc_id, len(s) as n, unnest(s) as x from sets
), pairs as (
    select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), steps as (
    select a, b from pairs union all select b, a from pairs
), reach as (
    with recursive r(doc_id, other) as (
        select doc_id, doc_id from documents union select r.doc_id, s.b from r join steps s on s.a = r.other
    ) select doc_id, min(other) as component_id from r group by doc_id
)
select doc_id, len(s)::bigint as n_shingles, component_id from sets join reach using (doc_id)
"""
