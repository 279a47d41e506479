"""Extracted fields against ground truth: comparisons, and metrics of fields, documents, types and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import rules as R

SIGNALS = ("regex_full_match", "format_valid", "cpf_has_11_digits", "cpf_check_digits_valid", "date_plausible", "minimum_expected_field_found", "conflict_with_other_candidates", "distance_to_label")


def _match(found: Column, truth: Column, available: Column, accept: float) -> dict[str, Column]:
    s = X.similarity(found, truth)
    return {
        "exact_match": (truth != "") & (found == truth),
        "accepted_match": available & (truth != "") & (s >= accept),
        "similarity": X.half_even(s, 4),
        "levenshtein_distance": F.when(found == truth, 0).otherwise(F.levenshtein(found, truth)),
    }


def compare_fields(documents: DataFrame, signals: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document and field that is expected, found or in the ground truth.

    documents (key, document_type); signals from with_signals(); truth (key, field_name, value, value_list).
    """
    # fields are paired within the row of their document: what is found, true and expected meets once, by the key
    text = X.value_text(F.col("value"), F.col("value_list"))
    p = signals.groupBy(key).agg(F.collect_list(F.struct("field_name", text.alias("predicted_value"), "ocr_confidence", "parsing_confidence", *SIGNALS)).alias("found"))
    g = truth.groupBy(key).agg(F.collect_list(F.struct("field_name", text.alias("ground_truth_value"))).alias("true"))
    expected = F.lit(None).cast("array<string>")
    for t, fields in R.MINIMUM.items():
        expected = F.when(F.col("document_type") == t, F.array(*map(F.lit, fields))).otherwise(expected)
    none = F.array().cast("array<string>")
    names = [F.coalesce(expected, none), *[F.coalesce(F.transform(c, lambda v: v["field_name"]), none) for c in ("found", "true")]]
    x = documents.select(key, "document_type").join(p, key, "left").join(g, key, "left")
    x = x.withColumn("field_name", F.explode(F.array_distinct(F.concat(*names))))
    one = lambda c: F.get(F.filter(c, lambda v: v["field_name"] == F.col("field_name")), F.lit(0))
    x = x.select(key, "document_type", "field_name", one("found").alias("f"), one("true")["ground_truth_value"].alias("ground_truth_value"))
    x = x.select(key, "document_type", "field_name", "ground_truth_value", *[F.col("f")[c].alias(c) for c in ("predicted_value", "ocr_confidence", "parsing_confidence", *SIGNALS)])
    x = x.withColumns({c: F.coalesce(c, F.lit("")) for c in ("predicted_value", "ground_truth_value")})
    name = F.col("field_name")
    x = x.withColumns({"p": X.comparable(name, F.col("predicted_value")), "t": X.comparable(name, F.col("ground_truth_value")), "field_found": F.col("predicted_value") != "", "ground_truth_available": F.col("ground_truth_value") != ""})
    return x.withColumns(_match(F.col("p"), F.col("t"), F.lit(True), R.ACCEPT_FIELD)).select(*columns(key))


def columns(key: str) -> list[str]:
    return [key, "document_type", "field_name", "predicted_value", "ground_truth_value", "field_found", "ground_truth_available", "exact_match", "accepted_match", "similarity", "levenshtein_distance", "ocr_confidence", "parsing_confidence", *SIGNALS]


def compare_texts(found: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """The whole recognised text of each document against that of the ground truth, as rows like those of fields.

    found (key, document_type, full_text, mean_confidence); truth (key, full_text).
    """
    x = found.join(truth.select(key, F.col("full_text").alias("ground_truth_value")), key, "left")
    x = x.withColumns({"predicted_value": F.coalesce("full_text", F.lit("")), "ground_truth_value": F.coalesce("ground_truth_value", F.lit(""))})
    x = x.withColumns({"field_name": F.lit(R.WHOLE_TEXT), "p": X.compact(F.col("predicted_value")), "t": X.compact(F.col("ground_truth_value")), "field_found": F.col("predicted_value") != "", "ground_truth_available": F.col("ground_truth_value") != "", "ocr_confidence": F.col("mean_confidence"), "parsing_confidence": F.lit(None).cast("double")})
    x = x.withColumns(_match(F.col("p"), F.col("t"), F.col("ground_truth_available"), R.GOOD_TEXT)).withColumn("exact_match", F.col("ground_truth_available") & (F.col("p") == F.col("t")))
    nulls = {s: F.lit(None).cast("int" if s == "distance_to_label" else "boolean") for s in SIGNALS}
    return x.withColumns(nulls).select(*columns(key))


def _field() -> Column:
    """Rows that count for fields: with ground truth, and not the whole text."""
    return F.col("ground_truth_available") & (F.col("field_name") != R.WHOLE_TEXT)


def metrics_by_field(comparisons: DataFrame) -> DataFrame:
    """Rates and means for each field, and for all fields (field_name null), in one pass."""
    rate = lambda c: X.share_known(F.col(c))
    mean = lambda c: X.mean4(F.col(c))
    return comparisons.filter(_field()).rollup("field_name").agg(
        F.count(F.lit(1)).alias("total"), rate("field_found").alias("found_rate"), rate("exact_match").alias("exact_accuracy"), rate("accepted_match").alias("accepted_accuracy"),
        mean("similarity").alias("mean_similarity"), mean("levenshtein_distance").alias("mean_distance"), rate("regex_full_match").alias("regex_rate"), rate("format_valid").alias("format_rate"),
        rate("cpf_has_11_digits").alias("cpf_11_digits_rate"), rate("cpf_check_digits_valid").alias("cpf_valid_rate"), rate("date_plausible").alias("date_plausible_rate"),
        mean("ocr_confidence").alias("mean_ocr_confidence"), mean("parsing_confidence").alias("mean_parsing_confidence"),
    )


def batch_metrics(signals: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """One row for a run: parsing quality over all extracted fields, and recognition over all documents.

    found (mean_confidence, n_lines, n_words); texts from compare_texts().
    """
    parsing = signals.agg(X.mean4(F.col("parsing_confidence")).alias("mean_parsing_confidence"), X.share_known(F.col("conflict_with_other_candidates")).alias("conflict_rate"), X.share_known(F.col("minimum_expected_field_found")).alias("minimum_field_rate"), X.mean4(F.abs("distance_to_label")).alias("mean_label_distance"))
    ocr = found.agg(F.count(F.lit(1)).alias("documents"), X.mean4(F.col("mean_confidence")).alias("mean_ocr_confidence"), X.mean4(F.col("n_lines")).alias("mean_lines"), X.mean4(F.col("n_words")).alias("mean_words"))
    whole = texts.agg(X.mean4(F.when(F.col("ground_truth_available"), F.col("similarity"))).alias("mean_text_similarity"))
    return parsing.crossJoin(ocr).crossJoin(whole)  # of single rows


def document_metrics(comparisons: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, rates and verdicts for each document."""
    f, whole = _field(), F.col("field_name") == R.WHOLE_TEXT
    x = comparisons.groupBy(key, "document_type").agg(
        F.count_if(f).alias("total_fields"), F.count_if(f & F.col("exact_match")).alias("fields_exact"), F.count_if(f & F.col("accepted_match")).alias("fields_accepted"), F.count_if(f & F.col("field_found")).alias("fields_found"),
        X.mean4(F.when(f, F.col("similarity"))).alias("mean_similarity"), X.mean4(F.when(f, F.col("levenshtein_distance"))).alias("mean_distance"),
        F.max(F.when(whole, F.col("similarity"))).alias("ocr_text_similarity"), F.coalesce(F.max(F.when(whole, F.col("accepted_match"))), F.lit(False)).alias("ocr_is_good"),
    )
    n, some = F.col("total_fields"), F.col("total_fields") > 0
    share = lambda c: F.when(some, F.col(c) / n).otherwise(0.0)
    x = x.withColumns({"strict": share("fields_exact"), "relaxed": share("fields_accepted")})
    x = x.withColumns({"document_accuracy_strict": some & (F.col("fields_exact") == n), "document_accuracy_relaxed": some & (F.col("relaxed") >= R.ACCEPT_DOCUMENT)})
    x = x.withColumns({
        "field_accuracy_strict": X.half_even(F.col("strict"), 4),
        "field_accuracy_relaxed": X.half_even(F.col("relaxed"), 4),
        "field_found_rate": F.when(some, X.half_even(F.col("fields_found") / n, 4)),
        "parsing_error_given_good_ocr": F.col("ocr_is_good") & ~F.col("document_accuracy_relaxed"),
        "end_to_end_error": ~F.col("document_accuracy_relaxed"),
        "severe_failure": ~some | (F.col("relaxed") < 0.5) | (F.col("fields_found") == 0),
    })
    return x.drop("strict", "relaxed")


def _group() -> list[Column]:
    flag = lambda c: X.share_all(F.col(c))
    good = F.when(F.col("ocr_is_good"), F.coalesce("parsing_error_given_good_ocr", F.lit(False)))
    return [
        flag("document_accuracy_strict").alias("document_accuracy_strict"), flag("document_accuracy_relaxed").alias("document_accuracy_relaxed"),
        X.mean4(F.col("field_accuracy_relaxed")).alias("average_document_field_accuracy"), X.mean4(F.col("mean_similarity")).alias("mean_similarity"), X.mean4(F.col("mean_distance")).alias("mean_distance"),
        flag("document_accuracy_strict").alias("perfect_document_rate"), flag("document_accuracy_relaxed").alias("acceptable_document_rate"), flag("severe_failure").alias("severe_failure_rate"),
        X.mean4(F.col("field_found_rate")).alias("field_found_rate"), X.half_even(1 - flag("ocr_is_good"), 4).alias("ocr_error_rate"),
        X.share_known(good).alias("parsing_error_rate_given_good_ocr"), flag("end_to_end_error").alias("end_to_end_error_rate"),
    ]


def group_summary(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), *_group())


def executive_by_type(metrics: DataFrame) -> DataFrame:
    """A row for every known type, with documents or without, and one for all (document_type `all`)."""
    both = metrics.rollup("document_type").agg(F.count(F.lit(1)).alias("documents"), *_group()).withColumn("document_type", F.coalesce("document_type", F.lit("all")))
    wanted = R.document_types(metrics.sparkSession).union(metrics.sparkSession.createDataFrame([("all",)], "document_type string"))
    return F.broadcast(wanted).join(both, "document_type", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def predominant_error(rectification: Column, ocr: Column, parsing: Column) -> Column:
    return (
        F.when(rectification & ocr, "retificacao_imagem").when(ocr, "ocr").when(parsing, "parsing").when(rectification, "retificacao_sem_impacto_final_claro").otherwise("sem_erro_relevante")
    )


def error_report(comparisons: DataFrame, metrics: DataFrame, rectification: DataFrame, key: str = "doc_id", failures: DataFrame | None = None) -> DataFrame:
    """Each document's errors, the fields that were not accepted, and the predominant error.

    rectification (key, contour_found, fallback); failures (key, document_type, error) of documents that had no result.
    """
    fields = comparisons.filter(_field() & ~F.col("accepted_match")).groupBy(key).agg(F.sort_array(F.collect_list("field_name")).alias("problem_fields"))
    x = metrics.select(key, "document_type", (~F.col("ocr_is_good")).alias("ocr_error"), F.col("parsing_error_given_good_ocr").alias("parsing_error"))
    x = x.join(rectification, key, "left").join(fields, key, "left")
    x = x.withColumn("rectification_error", ~F.coalesce("contour_found", F.lit(True)) | F.coalesce("fallback", F.lit(False)))
    x = x.select(key, "document_type", "rectification_error", "ocr_error", "parsing_error", F.coalesce("problem_fields", F.array().cast("array<string>")).alias("problem_fields"), predominant_error(F.col("rectification_error"), F.col("ocr_error"), F.col("parsing_error")).alias("predominant_error"))
    if failures is None:
        return x
    failed = failures.select(key, "document_type", F.lit(True).alias("ocr_error"), F.array().cast("array<string>").alias("problem_fields"), F.lit("falha_execucao").alias("predominant_error"), "error")
    return x.unionByName(failed, allowMissingColumns=True)


def timing_stats(timings: DataFrame, key: str = "key", seconds: str = "seconds") -> DataFrame:
    """Mean, spread, extremes and number of the seconds of each key."""
    r = lambda c: X.half_even(c, 6)
    s = F.col(seconds)
    return timings.groupBy(key).agg(r(F.avg(s)).alias("mean"), r(F.stddev_pop(s)).alias("std"), r(F.min(s)).alias("min"), r(F.max(s)).alias("max"), F.count(s).alias("count"))


def unpivot_timings(results: DataFrame, id_col: str, *keys: str) -> DataFrame:
    return results.unpivot(id_col, list(keys), "key", "seconds")
