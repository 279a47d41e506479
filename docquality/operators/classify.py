"""Scores of a classifier: probabilities, rejection, confusion, reports and thresholds."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.rules import OTHER, OTHER_NAMES


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def predict(scores: DataFrame, classes: list, logits: str = "logits") -> DataFrame:
    """Adds probabilities, predicted (the first of the most probable classes) and max_probability."""
    names = F.array(*map(F.lit, classes))
    x = scores.withColumn("probabilities", softmax(F.col(logits)))
    x = x.withColumn("max_probability", F.array_max("probabilities"))
    return x.withColumn("predicted", F.get(names, (F.array_position("probabilities", F.col("max_probability")) - 1).cast("int")))


def reject(predictions: DataFrame, threshold: Column | float) -> DataFrame:
    """Adds rejected and final: the predicted class, or `outros` where the probability is below the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return predictions.withColumn("rejected", F.col("max_probability") < t).withColumn("final", F.when(F.col("rejected"), OTHER).otherwise(F.col("predicted").cast("string")))


def probability_columns(predictions: DataFrame, classes: list, places: int | None = None) -> DataFrame:
    """One column prob_<class> for each class instead of the array."""
    p = lambda i: F.get("probabilities", F.lit(i)) if places is None else F.bround(F.get("probabilities", F.lit(i)), places)
    return predictions.select(*[c for c in predictions.columns if c != "probabilities"], *[p(i).alias(f"prob_{c}") for i, c in enumerate(classes)])


def rejection_threshold(validation: DataFrame, percentile: float = 5.0) -> DataFrame:
    """(threshold): the exact percentile, between neighbours linear, of the highest probabilities; null without any.

    Equal values are counted first. Values are dealt into buckets at approximate quantiles; only the totals of buckets
    meet in one task, and ranks are counted within a bucket.
    """
    share = min(max(percentile, 0.0), 100.0) / 100
    v = validation.filter(F.col("max_probability").isNotNull()).groupBy(F.col("max_probability").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cuts = v.agg(F.percentile_approx("v", [i / 200 for i in range(1, 200)], 2000).alias("cuts"))  # one row
    x = v.crossJoin(F.broadcast(cuts)).select("v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"))
    up = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = x.groupBy("bucket").agg(F.sum("n").alias("t"))  # 200 rows
    totals = totals.select("bucket", F.coalesce(F.sum("t").over(up), F.lit(0)).alias("before"), F.sum("t").over(W.partitionBy()).alias("all"))
    to = W.partitionBy("bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    x = x.join(F.broadcast(totals), "bucket").withColumn("end", F.col("before") + F.sum("n").over(to))
    place = F.lit(share) * (F.col("all") - 1)
    at = lambda k: F.max(F.when((F.col("end") > k) & (F.col("end") - F.col("n") <= k), F.col("v")))
    low, high = F.floor(place), F.least(F.floor(place) + 1, F.col("all") - 1)
    return x.agg(at(low).alias("lo"), at(high).alias("hi"), F.max(place - low).alias("part")).select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("threshold"))


def confidence_analysis(predictions: DataFrame, threshold: DataFrame, true: str = "true_label") -> DataFrame:
    """Accepted and rejected counts, the rejection rate, and the accuracy of what is accepted (0 if nothing is)."""
    x = predictions.crossJoin(F.broadcast(threshold))  # one row
    ok = F.col("max_probability") >= F.col("threshold")
    n = F.count(F.lit(1))
    return x.groupBy("threshold").agg(
        F.count_if(ok).cast("double").alias("accepted_count"), F.count_if(~ok).cast("double").alias("rejected_count"), (F.count_if(~ok) / n).alias("rejection_rate"),
        F.coalesce(F.avg(F.when(ok, (F.col(true) == F.col("predicted")).cast("int"))), F.lit(0.0)).alias("accepted_accuracy"),
    )


def confusion(predictions: DataFrame, labels: list[str], true: str = "true_label", predicted: str = "predicted") -> DataFrame:
    """(true_label, predicted_label, n) for every pair of labels; rows with others do not count."""
    spark = predictions.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "true_label string, predicted_label string")
    found = predictions.groupBy(F.col(true).cast("string").alias("true_label"), F.col(predicted).cast("string").alias("predicted_label")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(found, ["true_label", "predicted_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_wide(predictions: DataFrame, labels: list[str], true: str = "true_label", predicted: str = "predicted") -> DataFrame:
    return confusion(predictions, labels, true, predicted).groupBy("true_label").pivot("predicted_label", labels).agg(F.sum("n"))


def report(predictions: DataFrame, labels: list[str], true: str = "true_label", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) of each label, then accuracy, `macro avg` and `weighted avg`.

    Undefined rates are 0. All of it comes from one count of pairs.
    """
    pairs = predictions.groupBy(F.col(true).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.broadcast(predictions.sparkSession.createDataFrame([(x,) for x in labels], "label string"))
    each = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("t") == F.col("p")).alias("hit"))
    s = each.groupBy("x.label").agg(F.sum(F.when((F.col("x.side") == "t") & F.col("hit"), F.col("n"))).alias("tp"), F.sum(F.when(F.col("x.side") == "t", F.col("n"))).alias("support"), F.sum(F.when(F.col("x.side") == "p", F.col("n"))).alias("named"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    r = wanted.join(s, "label", "left").select("label", *[zero(F.col(c)).alias(c) for c in ("tp", "support", "named")])
    rate = lambda a, b: zero(F.try_divide(a, b)).cast("double")
    r = r.withColumns({"precision": rate(F.col("tp"), F.col("named")), "recall": rate(F.col("tp"), F.col("support"))})
    r = r.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = r.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in scores], total.alias("support"))
    weighted = r.agg(F.lit("weighted avg").alias("label"), *[rate(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in scores], total.alias("support"))
    hit = predictions.agg(F.lit("accuracy").alias("label"), F.avg((F.col(true).cast("string") == F.col(predicted).cast("string")).cast("double")).alias("a"), F.count(true).alias("support"))
    accuracy = hit.select("label", *[F.col("a").alias(c) for c in scores], "support")
    return functools.reduce(DataFrame.union, [r.select("label", *scores, "support"), accuracy, macro, weighted])


def scores(predictions: DataFrame, true: str = "true_label", predicted: str = "predicted") -> DataFrame:
    """(accuracy, macro_f1, n) of rows with a label; the mean of F1 is over the labels that occur, true or predicted."""
    t, p = F.col(true).cast("string"), F.col(predicted).cast("string")
    pairs = predictions.filter(F.col(true).isNotNull()).groupBy(t.alias("t"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("t") == F.col("p")
    sides = F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("true"), F.lit(0).alias("named")), F.struct(F.col("p").alias("label"), F.lit(0).alias("true"), F.lit(1).alias("named")))
    each = pairs.select("n", hit.alias("hit"), F.explode(sides).alias("s")).filter(F.col("s.label").isNotNull()).groupBy("s.label").agg(
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.true")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("s.true")).alias("support"), F.sum(F.col("n") * F.col("s.named")).alias("named"),
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("named")), F.lit(0.0))
    return each.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.coalesce(F.sum("support"), F.lit(0)).alias("n"))


def batch_means(batches: DataFrame, *metrics: str, size: str = "n") -> DataFrame:
    """One row: each metric of batches as a mean over their items; null without any."""
    return batches.agg(*[F.try_divide(F.sum(F.col(m) * F.col(size)), F.sum(size)).alias(m) for m in metrics])


def parameter_counts(layers: DataFrame) -> DataFrame:
    """(total, trainable, frozen) of layers (name, parameters, trainable)."""
    n = F.col("parameters")
    each = {"total": F.sum(n), "trainable": F.sum(F.when(F.col("trainable"), n)), "frozen": F.sum(F.when(~F.col("trainable"), n))}
    return layers.agg(*[F.coalesce(x, F.lit(0)).alias(k) for k, x in each.items()])


def external_metrics(predictions: DataFrame, labels: list[str], true: str = "true_label") -> DataFrame:
    """(metric, value) of scoring where only some rows have a label; metrics of empty subsets are left out."""
    t, final, known = F.col(true), F.col("final"), F.col(true).isNotNull()
    hit = lambda where: F.avg(F.when(where, (t == final).cast("double")))
    one = predictions.agg(
        F.count(F.lit(1)).cast("double").alias("external_total_images"), F.count_if("rejected").cast("double").alias("external_rejected_count"), F.coalesce(F.avg(F.col("rejected").cast("double")), F.lit(0.0)).alias("external_rejection_rate"),
        F.nullif(F.count_if(known), F.lit(0)).cast("double").alias("external_labeled_images"), hit(known).alias("external_accuracy_final"), hit(t == OTHER).alias("external_outros_recall"), hit(t != OTHER).alias("external_known_accuracy_final"),
    )
    f1 = report(predictions.filter(known), labels, true, "final").filter("label = 'macro avg'").select(F.when(F.col("support") > 0, F.col("f1")).alias("external_macro_f1_final"))
    wide = one.crossJoin(f1)  # of single rows
    return wide.unpivot([], wide.columns, "metric", "value").filter(F.col("value").isNotNull())


def true_label(folder: Column, classes: list[str]) -> Column:
    """A folder's class: a known one, `outros` for its other names, else null."""
    return F.when(folder.isin(*classes), folder).when(F.lower(folder).isin(*OTHER_NAMES), OTHER)


def best_epoch(history: DataFrame, patience: int = 4) -> DataFrame:
    """(best_epoch, best_loss, last_epoch): the lowest loss before training stops for want of a better one.

    history (epoch, loss) has one row for each epoch of one run, so few that one task orders them.
    """
    up = W.orderBy("epoch")
    x = history.withColumn("least", F.min("loss").over(up))
    x = x.withColumn("since", F.col("epoch") - F.max(F.when(F.col("loss") == F.col("least"), F.col("epoch"))).over(up))
    x = x.withColumn("stop", F.min(F.when(F.col("since") >= patience, F.col("epoch"))).over(W.partitionBy()))
    x = x.filter(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop")))
    return x.agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min("loss").alias("best_loss"), F.max("epoch").alias("last_epoch"))
