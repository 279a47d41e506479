"""Ranks within large groups, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_within(df: DataFrame, by: list[str], key: str, *ties: str, prefix: int = 4, name: str = "rank") -> DataFrame:
    """Adds the place of each row, from 0, among those with equal `by`, in the order of the text column key, then ties.

    Rows are ranked among those whose key goes on alike for `prefix` characters after what all keys of the group begin
    with, and moved up by how many keys go on with something less; the counts of these heads are what a whole group
    sends to one task. Rows with a null in `by` or key are left out.
    """
    own_by = by or ["__all"]
    x = df.filter(F.col(key).isNotNull())
    if not by:
        x = x.withColumn("__all", F.lit(1))
    ends = x.groupBy(*own_by).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    common = F.length(F.regexp_extract(F.concat("__lo", F.lit("\0"), "__hi"), r"(?s)^(.*).*\x00\1", 1))
    x = x.join(ends.select(*own_by, common.alias("__common")), own_by).withColumn("__head", F.substring(key, F.col("__common") + 1, F.lit(prefix))).drop("__common")
    up = W.partitionBy(*own_by).orderBy("__head").rowsBetween(W.unboundedPreceding, -1)
    before = x.groupBy(*own_by, "__head").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(up), F.lit(0))).drop("__n")
    own = W.partitionBy(*own_by, "__head").orderBy(key, *ties)
    out = x.withColumn("__own", F.row_number().over(own)).join(before, [*own_by, "__head"]).withColumn(name, F.col("__own") - 1 + F.col("__before"))
    return out.drop("__head", "__own", "__before", "__all")
