"""Bulk-synchronous best-fit packing of documents into sequences of a fixed number of tokens.

Documents that are too long are cut. Pieces are then taken by classes: those of which one fits in a sequence, two, three
and so on, and at last all smaller ones. A class is matched with the gaps that there are, in sweeps:

* pieces and gaps are range-sorted together by size, the largest first, a gap before pieces of its size;
* along that order every piece wants the smallest gap before it, its successor. Where several want the same one, ranks
  decide, as with brackets: a gap opens a level, and the first piece after it that meets this level closes it. Levels
  come from counts by task and size, so all tasks find them at once, and equal levels are brought together;
* gaps shrink by the piece they got, and the sweep is repeated with the pieces left until no gap holds any. The smallest
  pieces are swept several for a gap: it stands in line once for each that it holds, smaller by the largest each time.

Pieces left of a class open new sequences, by rank, as many in each as the class says. The result is close to serial
best fit from the largest piece to the smallest (`best_fit`), with some ten sweeps rather than a step for each piece.

A sweep moves a size and two numbers for each gap and piece that are left, texts and ids stay where they are. Its only
table that all tasks get has a row for each size and task. Every sweep is written to shared storage before the next.

Defined results: a null text is empty, one end token. Rows are packed each by itself, so repeated rows and those that
share a doc_id or have none are documents of their own. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, documents, ship, slices, texts_of
from .tokens import default_vocabulary, encoder

#: Rows that one task sorts; more are range-sorted by many.
ALONE = 200_000
#: Classes of pieces that are taken by themselves: up to so many pieces of the class fit in a sequence.
CLASSES = 6


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a first one with what is left over."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces_of(docs: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str, end_id: int, with_ids: bool) -> DataFrame:
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    arrow, end = arrow_schema(docs.sparkSession, schema), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary, added=True).ids
        for b in slices(batches):
            at, rows = [], []
            for i, text in enumerate(texts_of(b, "text")):
                ids = ids_of(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + n)]
                    at.append(i)
                    rows.append((k, start, n, zlib.crc32(part), *([part] * with_ids)))
            if rows:
                cols = [b.column(0).take(pa.array(at)), *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return src.mapInArrow(run, schema)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Serial best fit, to hold the sweeps against: runs (length, first rank, pieces, first sequence, offset), of which
    piece r goes to sequence first + r.

    counts: how many pieces there are of each length. Sequences are numbered from 0, without gaps.
    """
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # by size: (first sequence, sequences)
    sizes: list[int] = []
    out, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            first, n = gaps[gap].popleft()
            if not gaps[gap]:
                sizes.pop(at)
            take = min(n, left)
            out.append((length, rank, take, first, size - gap))
            if n > take:
                if not gaps[gap]:
                    bisect.insort(sizes, gap)
                gaps[gap].appendleft((first + take, n - take))
            add(gap - length, first, take)
            rank, left = rank + take, left - take
        each = size // length
        for new, fill in ((left // each, each), (int(left % each > 0), left % each)):
            if new:
                for k in range(fill):
                    out.append((length, rank, new, opened, k * length))
                    rank += new
                add(size - fill * length, opened, new)
                opened += new
    return out


def range_sorted(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """n rows in this order over all tasks. at: part * 2**33 + place in the part; parts are in order."""
    dealt = rows.coalesce(1) if n <= ALONE else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def part_of(at: str) -> Column:
    return F.shiftright(at, 33)


def sweep(pieces: DataFrame, gaps: DataFrame, n: int, size: int, scratch: Scratch, largest: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of pieces (id, value) and gaps (id, value): placed (id, sequence, offset), the pieces left and the gaps left.

    n: how many of both there are. largest: the size of the largest piece, if a gap may get several pieces; else it gets
    one.
    """
    g = F.col("value")
    if largest is None:
        places = gaps.select(F.lit(0).alias("kind"), "id", F.lit(0).alias("slot"), g.alias("gap"), g.alias("value"))
    else:
        slot = F.explode(F.sequence(F.lit(0), F.greatest(F.floor(g / largest).cast("int") - 1, F.lit(0)))).alias("slot")
        places = gaps.select("id", g.alias("gap"), slot).select(F.lit(0).alias("kind"), "id", "slot", "gap", (F.col("gap") - F.col("slot") * largest).alias("value"))
    rows = places.union(pieces.select(F.lit(1).alias("kind"), "id", F.lit(0).alias("slot"), F.lit(0).cast("long").alias("gap"), "value"))
    rows = scratch.keep(range_sorted(rows, n if largest is None else n * size // largest, F.desc("value"), F.asc("kind"), F.asc("id"), F.asc("slot")))
    # a row for each size, kind and part: few, whatever the number of pieces
    runs = rows.groupBy(part_of("at").alias("part"), "value", "kind").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    up = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    before = F.coalesce(F.sum(up).over(W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("part").alias("p"), F.col("value").alias("v"), F.col("kind").alias("k"), "lo", before.alias("before"))
    x = rows.join(F.broadcast(runs), (part_of("at") == F.col("p")) & (F.col("value") == F.col("v")) & (F.col("kind") == F.col("k")))
    own = F.col("at") - F.col("lo")
    x = x.select("kind", "id", "slot", "gap", "value", "at", (F.col("before") + F.when(F.col("kind") == 0, own + 1).otherwise(-own)).alias("level"))
    along = W.partitionBy("level").orderBy("at")  # of each size two runs at most
    me = F.struct("kind", "id", "slot", "gap", "value")
    x = x.select("kind", "id", "gap", "value", F.when(F.col("kind") == 0, F.lead(me).over(along)).otherwise(F.lag(me).over(along)).alias("o"))
    met = F.when(F.col("o.kind") != F.col("kind"), F.col("o"))
    x = scratch.keep(x.select("kind", "id", "gap", "value", met.alias("met")), (rows,))
    scratch.drop(rows)
    left = x.filter("kind = 1 and met is null").select("id", "value")
    found = x.filter("kind = 1 and met is not null").select("id", "value", "met.*").toDF("id", "value", "k", "sequence", "slot", "gap", "v").drop("k", "v")
    if largest is None:
        placed = found.select("id", "sequence", (size - F.col("gap")).alias("offset"))
        return placed, left, x.filter("kind = 0").select("id", (F.col("value") - F.coalesce(F.col("met.value"), F.lit(0))).alias("value"))
    in_gap = W.partitionBy("sequence").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)  # the pieces of one sequence
    placed = found.select("id", "sequence", (size - F.col("gap") + F.coalesce(F.sum("value").over(in_gap), F.lit(0))).alias("offset"))
    used = found.groupBy("sequence").agg(F.sum("value").alias("used"))
    rest = gaps.join(used, F.col("id") == F.col("sequence"), "left").select("id", (F.col("value") - F.coalesce("used", F.lit(0))).alias("value"))
    return scratch.keep(placed, (x,)), left, scratch.keep(rest, (x,))


def opened(pieces: DataFrame, n: int, each: int, most: int | None, scratch: Scratch) -> DataFrame:
    """(id, value, sequence, offset, filled) of pieces (id, value) that open sequences, `each` in one, the largest first.
    Beyond `most` pieces sequence is null."""
    rows = scratch.keep(range_sorted(pieces.select("id", "value"), n, F.desc("value"), F.asc("id")))
    parts = rows.groupBy(part_of("at").alias("p")).agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = rows.join(F.broadcast(parts.select("p", "lo", before.alias("before"))), part_of("at") == F.col("p"))
    x = x.select("id", "value", (F.col("before") + F.col("at") - F.col("lo")).alias("rank"))
    x = x.withColumn("group", F.floor(F.col("rank") / each))
    whole = W.partitionBy("group")  # of `each` rows at most
    along = whole.orderBy("rank")
    opens = F.lit(True) if most is None else F.col("rank") < most
    out = scratch.keep(x.select(
        "id", "value", F.when(opens, F.first("id").over(along)).alias("sequence"),
        F.coalesce(F.sum("value").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("value").over(whole).alias("filled"),
    ), (rows,))
    scratch.drop(rows)
    return out


def matched(pieces: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(id, sequence, offset) of pieces (id, value). A sequence is known by the id of the piece that opened it."""
    least = pieces.agg(F.min("value")).first()[0]
    placed: list[DataFrame] = []
    gaps = None

    def add_gaps(more: DataFrame) -> None:
        """Gaps (id, value) that some piece fits in."""
        nonlocal gaps
        more = more.filter(F.col("value") >= least)
        gaps = more if gaps is None else gaps.union(more)

    for j in range(1, CLASSES + 2):
        last = j > CLASSES
        left = pieces.filter((F.col("value") <= size // j) & (F.lit(True) if last else F.col("value") > size // (j + 1)))
        while True:
            seen = left.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("all"), F.count(F.lit(1)).alias("n")).first()
            if seen["least"] is None:
                break
            widest, n_gaps = gaps.agg(F.max("value"), F.count(F.lit(1))).first() if gaps is not None else (None, 0)
            if widest is not None and widest >= seen["least"]:
                got, left, more = sweep(left, gaps, seen["n"] + n_gaps, size, scratch, seen["most"] if last else None)
                placed.append(got)
                gaps = None
                add_gaps(more)
            elif j == 1:
                placed.append(left.select("id", F.col("id").alias("sequence"), F.lit(0).cast("long").alias("offset")))
                add_gaps(left.select("id", (size - F.col("value")).alias("value")))
                break
            else:
                each = size // seen["most"] if last else j
                x = opened(left, seen["n"], each, -(-seen["all"] // size) * each if last else None, scratch)
                new = x.filter("sequence is not null")
                placed.append(new.select("id", "sequence", "offset"))
                add_gaps(new.filter("id = sequence").select("id", (size - F.col("filled")).alias("value")))
                left = x.filter("sequence is null").select("id", "value")
    out = placed[0]
    for x in placed[1:]:
        out = out.union(x)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, vocabulary: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(pieces_of(docs, id_col, text_col, size, vocabulary or default_vocabulary(), end_id, with_ids).withColumn("id", F.monotonically_increasing_id()))
    slim = scratch.keep(pieces.select("id", F.col("length").alias("value")))
    if slim.isEmpty():
        return pieces.drop("id").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    placed = scratch.keep(matched(slim, size, scratch).withColumnRenamed("sequence", "sequence_id"))
    scratch.drop_all_but(pieces, placed)
    return pieces.join(placed, "id").drop("id")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences, from pack(..., with_ids=True): their little-endian ids and their documents in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # a sequence holds `size` pieces at most
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"))
