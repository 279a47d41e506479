"""Fields of identity documents from their recognised lines.

A document is one row with its lines as an array, so that the search around labels, which is bounded by the lines of
one document, needs no shuffle beyond the one that brings the lines together.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import rules as R

AHEAD = 4


def line_documents(lines: DataFrame, *keys: str) -> DataFrame:
    """lines (keys, document_type, line_idx, text, confidence) → one row per document.

    Blank lines go, and the others are numbered anew. Each line has its normalised text and its value (null for label
    lines and lines without one); raw has the lines as they were.
    """
    kept = lines.filter(X.not_blank(F.col("text"))).select(*keys, "document_type", F.struct("line_idx", "text", F.col("confidence").cast("double").alias("confidence")).alias("l"))
    # by the keys alone, so that all that is done by document later finds its rows in place
    docs = kept.groupBy(*keys).agg(F.min("document_type").alias("document_type"), F.sort_array(F.collect_list("l")).alias("raw"))

    def line(x: Column, i: Column) -> Column:
        norm = X.normalize_text(x["text"])
        return F.struct(i.cast("int").alias("idx"), x["text"].alias("text"), x["confidence"].alias("confidence"), norm.alias("norm"), X.only_digits(x["text"]).alias("digits"))

    def with_value(x: Column) -> Column:
        value = F.nullif(X.clean_value(x["text"]), F.lit(""))
        return x.withField("value", F.when(~X.is_label_line(x["norm"]), value)).withField("compact", F.regexp_replace(x["norm"], "[^A-Z0-9]", ""))

    docs = docs.select(*keys, "document_type", "raw", F.transform("raw", line).alias("lines"), F.array_join(F.transform("raw", lambda x: x["text"]), "\n").alias("full_text"))
    return docs.withColumn("lines", F.transform("lines", with_value)).withColumn("noise_text", X.numeric_noise(F.col("full_text")))


def has_label(norm: Column, labels: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [norm.contains(x) for x in labels])


def inline_value(line: Column, labels: tuple[str, ...]) -> Column:
    """What is left of a label line without the labels, each of which acts as an expression, in turn."""
    left = line["norm"]
    for label in labels:
        left = F.trim(X.squeeze(F.regexp_replace(left, f"(?iu){label}", "")))
    return X.let(F.nullif(X.clean_value(left), F.lit("")), lambda v: F.when(~X.is_label_line(X.normalize_text(v)), v))


def value_near_label(lines: Column, labels: tuple[str, ...]) -> Column:
    """For each label line in turn: its own rest, the values of the lines after it, then of those before; the first."""

    def around(at: Column) -> Column:
        i = at["idx"]
        ahead = F.slice(lines, i + 2, F.lit(AHEAD))
        behind = F.reverse(F.slice(lines, F.greatest(F.lit(1), i + 1 - AHEAD), F.least(F.lit(AHEAD), i)))
        return F.concat(F.array(inline_value(at, labels)), F.transform(F.concat(ahead, behind), lambda x: x["value"]))

    found = F.flatten(F.transform(F.filter(lines, lambda x: has_label(x["norm"], labels)), around))
    return F.get(F.array_compact(found), 0)


def date_near_label(lines: Column, labels: tuple[str, ...]) -> Column:
    """The date in the value near the label; only where there is no value at all, the first in a window of lines."""
    value = value_near_label(lines, labels)

    def window(at: Column) -> Column:
        i = at["idx"]
        start = F.greatest(F.lit(0), i - 3)
        return X.first_date(F.array_join(F.transform(F.slice(lines, start + 1, i + 5 - start), lambda x: x["text"]), " "))

    windows = F.transform(F.filter(lines, lambda x: has_label(x["norm"], labels)), window)
    return F.when(value.isNotNull(), X.first_date(value)).otherwise(F.get(F.array_compact(windows), 0))


def parent_names(lines: Column) -> Column:
    """Up to two names in the five lines after each label of parents, up to a line that begins something else."""
    stop = "|".join(R.STOP_MARKERS)

    def after(at: Column) -> Column:
        following = F.slice(lines, at["idx"] + 2, F.lit(5))
        stops = F.filter(F.transform(following, lambda x, i: F.when(x["norm"].rlike(stop), i)), lambda i: i.isNotNull())
        upto = F.slice(following, F.lit(1), F.coalesce(F.get(stops, 0), F.size(following)).cast("int"))
        return F.transform(F.filter(upto, lambda x: x["value"].isNotNull() & ~x["value"].rlike(X.DATE)), lambda x: x["value"])

    return F.slice(F.flatten(F.transform(F.filter(lines, lambda x: x["norm"].contains("FILIACAO")), after)), 1, 2)


def fields_of(rules: tuple[R.Rule, ...]) -> Column:
    """The fields of a document by these rules: name, value, values (a list for parents), in order."""
    lines, noise = F.col("lines"), F.col("noise_text")
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    out = []
    for r in rules:
        value, values = none, no_list
        if r.method == "value":
            value = value_near_label(lines, r.labels)
            if r.pattern:
                value = F.coalesce(value, X.first_match(X.numeric_noise(noise), getattr(X, r.pattern)))
        elif r.method == "date":
            value = date_near_label(lines, r.labels)
        elif r.method == "cpf":
            value = X.first_cpf(noise)
        elif r.method == "names":
            values = parent_names(lines)
        else:
            value = X.first_match(noise, getattr(X, r.pattern))
        out.append(F.struct(F.lit(r.field).alias("field_name"), value.alias("value"), values.alias("value_list")))
    return F.array(*out)


def extract_fields(docs: DataFrame) -> DataFrame:
    """One row per document and field found, with the document's columns. Empty lists of names stay, other empties go."""
    kind = F.col("document_type")
    prefixed = {"CPF": "CPF_Verso", "CNH": "CNH_Verso", "RG": "RG_Verso"}
    fields = F.when(F.lit(False), fields_of(R.RULES["CPF_Verso"]))
    for t in ("CPF_Frente", "CNH_Frente", "RG_Frente"):
        fields = fields.when(kind == t, fields_of(R.RULES[t]))
    for prefix, t in prefixed.items():
        fields = fields.when(kind.startswith(prefix), fields_of(R.RULES[t]))
    rows = docs.withColumn("f", F.explode(fields)).select("*", "f.*").drop("f")
    return rows.filter(F.col("value_list").isNotNull() | (F.trim("value") != ""))


def line_index(value: Column, lines: Column) -> Column:
    """The first line that holds the value: as normalised text, in compact form, or by its digits."""


    def first(v: Column) -> Column:
        norm, small, digits = v["norm"], v["small"], v["digits"]
        hit = lambda x: ((norm != "") & x["norm"].contains(norm)) | ((small != "") & x["compact"].contains(small)) | ((digits != "") & x["digits"].contains(digits))
        return F.get(F.filter(lines, hit), 0)["idx"]

    return F.when(value != "", X.let(F.struct(X.normalize_text(value).alias("norm"), X.compact(value).alias("small"), X.only_digits(value).alias("digits")), first))


def line_confidence(value: Column, lines: Column) -> Column:
    """The confidence of the first line that holds the value as normalised text or by its digits."""


    def first(v: Column) -> Column:
        norm, digits = v["norm"], v["digits"]
        hit = lambda x: ((norm != "") & x["norm"].contains(norm)) | ((digits != "") & x["digits"].contains(digits))
        return F.get(F.filter(lines, hit), 0)["confidence"]

    return F.when(value != "", X.let(F.struct(X.normalize_text(value).alias("norm"), X.only_digits(value).alias("digits")), first))


def label_index(lines: Column, labels: Column) -> Column:
    return F.get(F.filter(lines, lambda x: F.exists(labels, lambda k: x["norm"].contains(k))), 0)["idx"]


def label_candidates(lines: Column, at: Column, window: int = AHEAD) -> Column:
    """How many lines around a label line have a value."""
    near = F.filter(lines, lambda x: x["idx"].between(at - window, at + window) & (x["idx"] != at) & x["value"].isNotNull())
    return F.when(at.isNull(), 0).otherwise(F.size(near))
