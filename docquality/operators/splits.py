"""Training, validation and test sets that keep the images of one original together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rank_within


def can_stratify(counts: list[int], share: float) -> bool:
    """Whether each class can be on both sides."""
    n = sum(counts)
    test = round(n * share)
    return bool(counts) and min(counts) >= 2 and test >= len(counts) and n - test >= len(counts)


def draw(group: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")))


def split_groups(samples: DataFrame, group: str, label: str, seed: int = 42, shares: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """(group, label, split) of every distinct group: by label in a seeded order, held-out sides rounded up.

    The order is that of a hash, so a group's place does not depend on how rows are dealt to machines.
    """
    return split_rows(samples.groupBy(group).agg(F.min(label).alias(label)), group, label, seed, shares)


def split_rows(rows: DataFrame, group: str, label: str, seed: int = 42, shares: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """(group, label, split) of every row, each dealt as a group of its own; those without a name come last."""
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("shares must sum to 1")
    groups = rows.select(group, label)
    counts = {r[label]: r["n"] for r in groups.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each class
    held, test_share = shares[1] + shares[2], shares[2] / (shares[1] + shares[2])
    drawn = groups.withColumn("draw", F.coalesce(draw(group, seed), F.lit("~")))  # "~" is behind all hashes
    by_label = can_stratify(list(counts.values()), held)
    first = _side(drawn, label, counts if by_label else None, sum(counts.values()), held, group)
    # the held-out side is judged on its own, and dealt again in the same order
    rest = first.filter("chosen").drop("chosen")
    in_rest = {k: math.ceil(n * held) for k, n in counts.items()} if by_label else {r[label]: r["n"] for r in rest.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    again = can_stratify(list(in_rest.values()), test_share)
    second = _side(rest, label, in_rest if again else None, sum(in_rest.values()), test_share, group)
    train = first.filter(~F.col("chosen")).select(group, label, F.lit("train").alias("split"))
    return train.union(second.select(group, label, F.when(F.col("chosen"), "test").otherwise("val").alias("split")))


def _side(drawn: DataFrame, label: str, counts: dict | None, total: int, share: float, group: str) -> DataFrame:
    """Adds chosen: the first by draw, their number rounded up, of each class (counts) or of all (no counts)."""
    if counts is None:
        ranked = rank_within(drawn, [], "draw", group, prefix=3, name="r")
        return ranked.withColumn("chosen", F.col("r") < math.ceil(total * share)).drop("r")
    kind = drawn.schema[label].dataType.simpleString()
    plan = F.broadcast(drawn.sparkSession.createDataFrame([(k, math.ceil(n * share)) for k, n in counts.items()], f"{label} {kind}, side long"))  # one row for each class
    ranked = rank_within(drawn.join(plan, label), [label], "draw", group, prefix=3, name="r")
    return ranked.withColumn("chosen", F.col("r") < F.col("side")).drop("r", "side")


def split_samples(samples: DataFrame, group: str, label: str, **options) -> DataFrame:
    """samples with their group's split."""
    return samples.join(split_groups(samples, group, label, **options).select(group, "split"), group)


def leakage(split: DataFrame, group: str) -> DataFrame:
    """(groups, leaking): groups in all, and those in more than one split."""
    each = split.groupBy(group).agg(F.count_distinct("split").alias("n"))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("leaking"))


def shuffled(samples: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded order that is the same on every run."""
    return samples.orderBy(draw(key, seed), key)
