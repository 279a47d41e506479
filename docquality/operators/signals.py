"""How far an extracted field can be trusted: signals, their weighted score, and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import rules as R
from .extract import label_candidates, label_index, line_confidence, line_index


def field_pattern(name: Column, use) -> Column:
    """use(pattern) for the pattern of a field; null for fields without one."""
    return (
        F.when(X.is_cpf_field(name), use(X.CPF)).when(X.is_date_field(name), use(X.DATE)).when(name == "registro_geral", use(X.RG)).when(name == "numero_registro", use(X.LONG_DIGITS)).when(name == "site", use(X.SITE))
    )


def whole(pattern: str) -> str:
    return "^(?:" + pattern.replace("(?U)", "(?U:") + "))$" if pattern.startswith("(?U)") else f"^(?:{pattern})$"


def has_pattern(name: Column) -> Column:
    return X.is_cpf_field(name) | X.is_date_field(name) | name.isin("registro_geral", "numero_registro", "site")


def full_match(name: Column, value: Column) -> Column:
    """Whether the value as a whole has the field's pattern; null for fields without one."""
    noise = F.trim(X.numeric_noise(value))
    noise = F.when(X.is_cpf_field(name), X.format_cpf(noise)).otherwise(noise)
    return X.let(noise, lambda n: field_pattern(name, lambda p: n.rlike(whole(p))))


def format_valid(name: Column, value: Column, as_of: Column) -> Column:
    v = F.trim(value)
    small = F.length(X.compact(v))
    ok = (
        F.when(X.is_cpf_field(name), F.length(X.only_digits(v)) == 11)
        .when(X.is_date_field(name), X.plausible_date(v, name, as_of))
        .when(name == "registro_geral", small.between(5, 14))
        .when(name == "numero_registro", F.length(X.only_digits(v)).between(8, 12))
        .when(name == "site", X.normalize_text(v).rlike(whole(X.SITE)))
        .otherwise(small >= 2)
    )
    return F.when(v == "", False).otherwise(ok)


def components() -> Column:
    """(name, weight, value) of the signals that apply."""
    one = lambda yes, applies=None: F.when(yes, 1.0) if applies is None else F.when(yes, 1.0).when(applies, 0.0)
    c = F.col
    values = {
        "field_extracted": F.lit(1.0),
        "came_after_expected_label": one(c("came_after_expected_label"), c("expected_label_found")),
        "distance_to_label": X.distance_score(c("distance_to_label")),
        "regex_full_match": one(c("regex_full_match"), c("regex_full_match").isNotNull()),
        "format_valid": one(c("format_valid"), F.lit(True)),
        "no_candidate_conflict": one(~c("conflict_with_other_candidates"), F.lit(True)),
        "minimum_expected_field_found": one(c("minimum_expected_field_found"), c("minimum_expected_field")),
        "cpf_has_11_digits": one(c("cpf_has_11_digits"), c("cpf_has_11_digits").isNotNull()),
        "cpf_check_digits_valid": one(c("cpf_check_digits_valid"), c("cpf_check_digits_valid").isNotNull()),
        "date_plausible": one(c("date_plausible"), c("date_plausible").isNotNull()),
    }
    rows = [F.struct(F.lit(k).alias("name"), F.lit(R.WEIGHTS[k]).alias("weight"), v.alias("value")) for k, v in values.items()]
    return F.filter(F.array(*rows), lambda x: x["value"].isNotNull())


def with_signals(fields: DataFrame, as_of: str) -> DataFrame:
    """Adds to extract_fields(): the confidence of recognition, every signal, score components, and parsing_confidence.

    as_of: the day, as yyyy-mm-dd, against which dates are judged.
    """
    spark, name, lines, day = fields.sparkSession, F.col("field_name"), F.col("lines"), F.lit(as_of).cast("date")
    labels = F.broadcast(R.audit_labels(spark))  # one row for each type and field
    minimum = F.broadcast(R.expected_fields(spark).select("document_type", "field_name", F.lit(True).alias("minimum_expected_field")))
    x = fields.join(labels, ["document_type", "field_name"], "left").join(minimum, ["document_type", "field_name"], "left")
    x = x.withColumns({"lookup": F.coalesce(F.array_join("value_list", " "), "value"), "expected_labels": F.coalesce("labels", F.array().cast("array<string>")), "minimum_expected_field": F.coalesce("minimum_expected_field", F.lit(False))}).drop("labels")
    x = x.withColumn("items", F.coalesce("value_list", F.array("value")))
    x = x.withColumns({"label_idx": label_index(lines, F.col("expected_labels")), "value_idx": line_index(F.col("lookup"), lines)})
    known = F.filter(F.transform("items", lambda v: line_confidence(v, lines)), lambda v: v.isNotNull())
    mean = X.let(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, v: a + v) / F.size(k)))
    look = F.col("lookup")
    pattern_count = field_pattern(name, lambda p: X.count_matches(F.col("noise_text"), p))
    x = x.withColumns({
        "ocr_confidence": mean,
        "field_extracted": F.lit(True),
        "expected_label_found": F.col("label_idx").isNotNull(),
        "distance_to_label": F.col("value_idx") - F.col("label_idx"),
        "regex_full_match": F.when(has_pattern(name), F.forall("items", lambda v: F.coalesce(full_match(name, v), F.lit(False)))),
        "format_valid": (F.size("items") > 0) & F.forall("items", lambda v: format_valid(name, v, day)),
        "candidate_count": F.coalesce(pattern_count, label_candidates(lines, F.col("label_idx"))),
        "minimum_expected_field_found": F.col("minimum_expected_field"),
        "cpf_has_11_digits": F.when(X.is_cpf_field(name), F.length(X.only_digits(look)) == 11),
        "cpf_check_digits_valid": F.when(X.is_cpf_field(name), X.cpf_checksum_valid(look)),
        "date_plausible": F.when(X.is_date_field(name), X.plausible_date(look, name, day)),
    })
    x = x.withColumns({"came_after_expected_label": F.coalesce(F.col("distance_to_label") >= 0, F.lit(False)), "conflict_with_other_candidates": F.col("candidate_count") > 1})
    x = x.withColumn("applicable", components())
    total = F.aggregate("applicable", F.lit(0.0), lambda a, v: a + v["weight"])
    x = x.withColumn("total_weight", total)
    x = x.withColumn("score_components", F.transform("applicable", lambda v: F.struct(v["name"].alias("name"), X.half_even(v["weight"] * v["value"] / F.col("total_weight") * 100, 2).alias("score"))))
    score = X.half_even(F.aggregate("score_components", F.lit(0.0), lambda a, v: a + v["score"]), 2)
    return x.withColumn("parsing_confidence", score).drop("applicable", "total_weight", "lookup", "items")


def quality_warnings(signals: DataFrame, documents: DataFrame, key: str, least: float) -> DataFrame:
    """(key, ordinal, kind, field_name, confidence): missing fields, then fields recognised or parsed with low confidence."""
    wanted = documents.select(key, "document_type").join(F.broadcast(R.expected_fields(documents.sparkSession)), "document_type")
    missing = wanted.join(signals.select(key, "field_name"), [key, "field_name"], "left_anti").select(key, F.lit(0).alias("ordinal"), F.lit("missing_field").alias("kind"), "field_name", F.lit(None).cast("double").alias("confidence"))
    low = F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("low_ocr_confidence").alias("kind"), F.col("ocr_confidence").alias("confidence")), F.struct(F.lit(2).alias("ordinal"), F.lit("low_parsing_confidence").alias("kind"), F.col("parsing_confidence").alias("confidence")))
    below = signals.select(key, "field_name", F.explode(low).alias("w")).filter(F.col("w.confidence") < least)
    return missing.unionByName(below.select(key, "w.ordinal", "w.kind", "field_name", "w.confidence"))
