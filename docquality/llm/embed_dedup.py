"""Embedding near-dedup by cross-polytope hashing.

Vectors are normalised, given random signs and turned by fast Hadamard transforms (three times); the nearest signed
axis of the result is one hash, and a table's key joins several. A vector is stored under its own key and also looks
under the keys in which one hash takes its second choice (multiprobe). How many hashes and tables are used follows
from the number of vectors, the similarity and the chance of a miss that is allowed, which is measured on random pairs
at exactly the threshold. Candidate pairs are verified by their cosine in double precision.

Equal vectors of a label form one class from the start. Classes within half the angle of the threshold of the first one
under their key form a ball: all of it links, by the triangle inequality, without a comparison. Candidates are pairs of
balls. Two balls link as a whole, or not at all, where the angle between their centres and their radii say so; else
their members are compared, in blocks, of which only counts and one link between the balls are kept. So copies, and near
copies within half the angle, are not expanded into their pairs, and every link counts. A group that is wider falls into
many balls, of which each pair that shares a key is a row until it is judged.

A key with very many balls is dealt out in blocks, and each pair of blocks is a task's work; no key is held by one task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
rows without a label or an id; vectors of different lengths never link (each length is a plan of its own). Vectors of
any size are scaled first. Repeated rows of one id count as one vector; an id with different vectors has the links of
all. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, ship, table
from .components import components

#: Classes of a key that one block holds, about.
BLOCK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep their norm."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Polytopes:
    """tables x hashes random rotations of vectors of one length, the same on every machine."""

    def __init__(self, dim: int, hashes: int, tables: int, seed: int = 11):
        self.dim, self.hashes, self.tables = dim, hashes, tables
        self.width = max(2, 1 << (dim - 1).bit_length())
        rng = np.random.default_rng([seed, dim, hashes])
        self.signs = rng.choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def choices(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """First and second axis (signed, as a number) of each row for each hash of table t."""
        wide = np.zeros((len(x), self.width))
        wide[:, : self.dim] = x
        out = []
        for signs in self.signs[t]:
            y = wide
            for s in signs:
                y = hadamard(y * s)
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.abs(np.take_along_axis(y, two, 1))
            two = np.where((size[:, :1] >= size[:, 1:]), two, two[:, ::-1])
            out.append(2 * two + (np.take_along_axis(y, two, 1) < 0))
        out = np.stack(out, 1)
        return out[:, :, 0], out[:, :, 1]

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        """(rows, 1 + hashes): a row's own key in table t, then the keys it also looks under."""
        first, second = self.choices(x, t)
        base = 2 * self.width
        place = np.array([base**i for i in range(self.hashes)], dtype=np.int64)
        own = first @ place
        return np.concatenate([own[:, None], own[:, None] + (second - first) * place], 1)


def hits(dim: int, hashes: int, cosine: float, pairs: int = 4000) -> float:
    """The share of tables that bring a random pair at this cosine together."""
    if dim == 1:
        return 1.0  # vectors of one component are equal or opposite in direction
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    tables = Polytopes(dim, hashes, 4, seed=3)
    found = 0
    for t in range(4):
        a, b = tables.keys(x, t), tables.keys(y, t)
        found += ((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)).sum()
    return max(found / (4 * pairs), 1e-3)


def plan(dim: int, vectors: int, cosine: float, miss: float) -> tuple[int, int]:
    """(hashes, tables): keys enough that a key of unrelated vectors stays small, and tables enough for the miss."""
    width = max(2, 1 << (dim - 1).bit_length())
    hashes = min(max(1, math.ceil(math.log(max(2, vectors)) / math.log(2 * width))), int(62 / math.log2(2 * width)))
    p = hits(dim, hashes, cosine)
    return hashes, max(2, math.ceil(math.log(miss) / math.log(1 - min(p, 0.999))))


def usable(vector: str, *others: str):
    """Whether a row can link at all."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    for c in others:
        ok = ok & F.col(c).isNotNull()
    return F.coalesce(ok, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(classes: DataFrame, dim: int, hashes: int, tables: int) -> DataFrame:
    """(label, t, key, rep, own) of classes (rep, label, v)."""
    kind = classes.schema["label"].dataType.simpleString()
    schema = f"label {kind}, t int, key long, rep long, own boolean"
    arrow = arrow_schema(classes.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lsh = Polytopes(dim, hashes, tables)
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(_matrix(b.column(2), dim))
            n, k = len(x), 1 + hashes
            for t in range(tables):
                at = pa.array(np.repeat(np.arange(n), k))
                own = pa.array(np.tile(np.arange(k) == 0, n))
                yield pa.RecordBatch.from_arrays([b.column(1).take(at), pa.array(np.full(n * k, t, np.int32)), pa.array(lsh.keys(x, t).ravel()), b.column(0).take(at), own], schema=arrow)

    return classes.select("rep", "label", "v").mapInArrow(run, schema)


#: Angles are held against bounds with so much to spare; what is closer to a bound is compared by cosines.
SPARE = 1e-6


def angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((unit(x) * unit(y)).sum(1), -1, 1))


def balls_of(classes: DataFrame, dim: int, hashes: int, cosine: float) -> DataFrame:
    """(rep, ball, off) of classes (rep, label, v): the class at the centre of the ball, and the angle to it."""
    first = keyed(classes, dim, hashes, 1).filter("own").select("label", "key", "rep")
    centre = first.groupBy("label", "key").agg(F.min("rep").alias("centre"))
    v = classes.select("rep", "v")
    x = first.join(centre, ["label", "key"]).select("rep", "centre").join(v, "rep").join(v.toDF("centre", "c"), "centre").select("rep", "centre", "v", "c")
    arrow, most = arrow_schema(classes.sparkSession, "rep long, ball long, off double"), math.acos(cosine) / 2 - SPARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rep, centre = (b.column(i).to_numpy() for i in (0, 1))
                off = np.where(rep == centre, 0.0, angle(_matrix(b.column(2), dim), _matrix(b.column(3), dim)))
                inside = off <= most
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.where(inside, centre, rep)), pa.array(np.where(inside, off, 0.0))], schema=arrow)

    return x.mapInArrow(run, "rep long, ball long, off double")


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, that share a key which at least one of them owns."""
    key = ["label", "t", "key"]
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * BLOCK).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    dealt = dealt.withColumn("mine", mine).withColumn("pair", F.explode(each)).select(F.xxhash64(*key, "pair.i", "pair.j").alias("bucket"), (F.col("pair.i") == F.col("pair.j")).alias("same"), "mine", "rep", "own")
    arrow = arrow_schema(rows.sparkSession, "a long, b long")

    def within(part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rep, own, mine = part["rep"], part["own"], part["mine"]
        i, j = np.triu_indices(len(rep), 1)
        ok = (own[i] | own[j]) & (rep[i] != rep[j]) & (part["same"][0] | (mine[i] != mine[j]))
        i, j = rep[i[ok]], rep[j[ok]]
        return np.minimum(i, j), np.maximum(i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in _with_end(batches):
            if b is not None and not b.num_rows:
                continue
            now = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)} if b is not None else {}
            both = {n: np.concatenate([held[n], now[n]]) if held and now else (now or held)[n] for n in now or held}
            if not both:
                continue
            starts = np.flatnonzero(np.append(True, both["bucket"][1:] != both["bucket"][:-1]))
            ends = np.append(starts[1:], len(both["bucket"]))
            if b is not None:  # the last bucket may go on
                held = {n: v[starts[-1] :] for n, v in both.items()}
                starts, ends = starts[:-1], ends[:-1]
            many = ends - starts > 1
            found = [within({n: v[s:e] for n, v in both.items()}) for s, e in zip(starts[many], ends[many], strict=True)]
            if found:
                a, c = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(a):
                    pairs = np.unique(np.stack([a, c], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def judged(pairs: DataFrame, balls: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(a, b, whole) of pairs of balls (ball, radius, v) that may link: whole if all of one links with all of the other."""
    c = balls.select("ball", "radius", "v")
    x = pairs.join(c.toDF("a", "ra", "x"), "a").join(c.toDF("b", "rb", "y"), "b").select("a", "b", "ra", "rb", "x", "y")
    arrow, most = arrow_schema(pairs.sparkSession, "a long, b long, whole boolean"), math.acos(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart, reach = angle(_matrix(b.column(4), dim), _matrix(b.column(5), dim)), b.column(2).to_numpy() + b.column(3).to_numpy()
                may = pa.array(apart - reach <= most + SPARE)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(may), b.column(1).filter(may), pa.array(apart + reach <= most - SPARE).filter(may)], schema=arrow)

    return x.mapInArrow(run, "a long, b long, whole boolean")


def compared(pairs: DataFrame, members: DataFrame, dim: int, cosine: float) -> DataFrame:
    """Of pairs of balls (a, b) and members (ball, rep, size, v): rows (x, null, more) of a class and how many vectors of the
    other ball it links with, and (a, b, null) of balls of which some members link."""
    blocks = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    p = pairs.join(blocks.toDF("a", "na"), "a").join(blocks.toDF("b", "nb"), "b")

    def side(own: str, mine: str, others: str, number: int) -> DataFrame:
        x = p.join(members.withColumnRenamed("ball", own), own).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col(mine)).cast("int"))
        x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        i, j = ("mine", "other") if number == 0 else ("other", "mine")
        return x.select(F.xxhash64("a", "b", i, j).alias("unit"), "a", "b", F.lit(number).alias("side"), "rep", "size", "v")

    arrow = arrow_schema(pairs.sparkSession, "x long, y long, more long")

    def count(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        one = t.column("side").to_numpy() == 0
        rep, size, v = t.column("rep").to_numpy(), t.column("size").to_numpy(), unit(_matrix(t.column("v").combine_chunks(), dim))
        # row by row as in a plain sum of products, so that a pair at the threshold is judged alike everywhere
        near = np.stack([(v[~one] * u).sum(1) >= cosine for u in v[one]]) if one.any() and (~one).any() else np.zeros((0, 0), bool)
        if not near.any():
            return pa.RecordBatch.from_pydict({f.name: pa.array([], f.type) for f in arrow}, schema=arrow)
        more = np.concatenate([near @ size[~one], near.T @ size[one]])
        x, some = np.concatenate([rep[one], rep[~one]]), more > 0
        n = int(some.sum())
        edge = [t.column(c)[0].as_py() for c in ("a", "b")]
        return pa.RecordBatch.from_arrays([pa.array([*x[some].tolist(), edge[0]], pa.int64()), pa.array([None] * n + [edge[1]], pa.int64()), pa.array([*more[some].tolist(), None], pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            unit_of = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(unit_of[1:] != unit_of[:-1]) + 1).tolist(), len(unit_of)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                if held and unit_of[s] != now:
                    yield count(held)
                    held = []
                now = unit_of[s]
                held.append(b.slice(s, e - s))
        if held:
            yield count(held)

    both = side("a", "na", "nb", 0).union(side("b", "nb", "na", 1))
    return both.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "x long, y long, more long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, miss: float = 1e-5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. Vectors of one label link at this cosine or more.

    miss: the chance, for a pair at exactly the threshold, that no table brings it together.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    good = rows.filter(usable("v", "vec_id", "label")).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v"), "dim": F.size("v")})
    members = scratch.keep(good.select("vec_id", "label", "h", "g").distinct())
    sizes = members.groupBy("label", "h", "g").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"))
    vector = good.groupBy("label", "h", "g").agg(F.any_value("v").alias("v"), F.any_value("dim").alias("dim"))
    classes = scratch.keep(sizes.join(vector, ["label", "h", "g"]).withColumn("rep", F.monotonically_increasing_id()))
    links, counts, in_balls = [], [], []
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        own = classes.filter(F.col("dim") == dim)
        hashes, tables = plan(dim, n, cosine, miss)
        placed = scratch.keep(balls_of(own, dim, hashes, cosine))
        in_ball = scratch.keep(placed.join(own.select("rep", "label", "size", "first", "v"), "rep"))
        in_balls.append(in_ball.select("rep", "ball", "size", "first"))
        balls = in_ball.groupBy("ball").agg(F.max("off").alias("radius"), F.sum("size").alias("n"))
        balls = scratch.keep(balls.join(in_ball.select(F.col("rep").alias("ball"), "v"), "ball"))
        keys = keyed(in_ball.select(F.col("ball").alias("rep"), "label", "v"), dim, hashes, tables)  # a member's keys are its ball's
        keys = scratch.keep(keys.groupBy("label", "t", "key", "rep").agg(F.max("own").alias("own")))
        found = scratch.keep(judged(candidate_pairs(keys), balls, dim, cosine))
        scratch.drop(keys)
        whole = found.filter("whole").select("a", "b")
        some = scratch.keep(compared(found.filter("not whole").select("a", "b"), in_ball.select("ball", "rep", "size", "v"), dim, cosine))
        links += [whole, some.filter("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()]
        n_of = balls.select("ball", "n")
        each = whole.join(n_of.toDF("b", "n"), "b").select(F.col("a").alias("ball"), "n").union(whole.join(n_of.toDF("a", "n"), "a").select(F.col("b").alias("ball"), "n"))
        by_ball = each.groupBy("ball").agg(F.sum("n").alias("by_ball"))
        by_class = some.filter("y is null").groupBy(F.col("x").alias("rep")).agg(F.sum("more").alias("by_class"))
        own_n = in_ball.select("rep", "ball").join(n_of, "ball").join(by_ball, "ball", "left").join(by_class, "rep", "left")
        counts.append(own_n.select("rep", (F.col("n") - 1 + F.coalesce("by_ball", F.lit(0)) + F.coalesce("by_class", F.lit(0))).alias("n_links")))
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    union = lambda frames: functools.reduce(DataFrame.union, frames)
    roots = components(scratch.keep(union(links)), scratch)
    rooted = scratch.keep(union(in_balls).join(roots.toDF("ball", "root"), "ball", "left").select("rep", F.coalesce("root", "ball").alias("root"), "first"))
    least = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    known = rooted.join(least, "root").join(scratch.keep(union(counts)), "rep").join(classes.select("rep", "label", "h", "g"), "rep")
    known = scratch.keep(known.select("label", "h", "g", "n_links", "component_id"))
    out = members.join(known, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    one = scratch.keep(out.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    scratch.drop_all_but(one)
    full = rows.select("vec_id").join(one, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), good as (
    select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
    where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), pairs as (
    select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach as (
    with recursive r(vec_id, other) as (
        select vec_id, vec_id from embeddings union select r.vec_id, p.b from r join pairs p on p.a = r.other
    ) select vec_id, min(other) as component_id from r group by vec_id
), counted as (
    select a as vec_id, count(*) as n_links from pairs group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from reach left join counted using (vec_id)
"""
