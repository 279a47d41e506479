"""Annotation files: boxes with their transcriptions.

A line is a row of cells (x, y, width, height, text, where the text may hold commas and a cell may be quoted), or a
polygon (two bracketed lists of numbers, two numbers, text). Headers and blank lines hold no annotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as X

# Fixed value: the cells that a header begins with.
HEADER = ("x", "y", "width", "height")
#: One cell behind its comma: a quoted part with doubled quotes inside, and whatever follows up to the next comma.
CELL = r',((?:"[^"]*+(?:""[^"]*+)*+"?)?[^,]*+)'
QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'


def is_header(line: Column) -> Column:
    return F.startswith(F.lower(F.replace(line, F.lit(" "), F.lit(""))), F.lit(",".join(HEADER)))


def annotation_lines(texts: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """(key, pos, line) of lines that hold an annotation."""
    clean = F.ltrim(F.col(text), F.lit("﻿"))
    x = texts.select(key, F.posexplode(F.split(clean, "\r\n|\r|\n")).alias("pos", "line"))
    return x.filter(X.not_blank(F.col("line")) & ~is_header(F.col("line")))


def cells(line: Column) -> Column:
    """The cells of a row, without their quotes; empty ones stay."""
    bare = lambda c: F.when(c.startswith('"'), F.concat(F.replace(F.regexp_extract(c, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, QUOTED, 2))).otherwise(c)
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), 1), bare)


def polygon(line: Column, use) -> Column:
    """use(xs, ys, text) of a polygon, or null: its two lists, then two numbers, then the rest as text."""

    def numbers(part: Column) -> Column:
        return F.filter(F.transform(F.split(part, "[^0-9.+-]+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull())

    def parts(p: Column) -> Column:
        def tail(t: Column) -> Column:
            ok = (F.size(p) == 3) & p[0].rlike(r"^\s*\[") & p[1].rlike(r"^\s*,\s*\[") & (F.size(t) == 4) & (F.trim(t[0]) == "") & t[1].try_cast("double").isNotNull() & t[2].try_cast("double").isNotNull()
            lists = F.struct(numbers(p[0]).alias("xs"), numbers(p[1]).alias("ys"))
            return F.when(ok, X.let(lists, lambda n: F.when((F.size(n["xs"]) > 0) & (F.size(n["ys"]) > 0), use(n["xs"], n["ys"], X.strip(t[3])))))

        return X.let(F.split(F.element_at(p, -1), ",", 4), tail)

    return F.when(F.ltrim(line, F.lit(" \t")).startswith("["), X.let(F.split(line, r"\]", 3), parts))


def parse_boxes(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, width, height, transcription, valid) of annotation lines. Quotes of rows are honoured, and commas in
    their text; polygons give the box around them. Rows that are neither have valid false and null numbers."""
    box = lambda x, y, w, h, t: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), t.alias("transcription"), F.lit(True).alias("shaped"))
    span = lambda a: F.array_max(a) - F.array_min(a)
    around = polygon(F.col("line"), lambda xs, ys, t: box(F.array_min(xs), F.array_min(ys), span(xs), span(ys), t))

    def row(c: Column) -> Column:
        n = [F.get(c, F.lit(i)).try_cast("double") for i in range(4)]
        return box(*n, X.strip(F.array_join(F.slice(c, 5, F.greatest(F.size(c), F.lit(1))), ","))).withField("shaped", F.size(c) >= 5)

    found = F.coalesce(around, X.let(cells(F.col("line")), row))
    # a generator, which filters on the cells are not pushed through: they would parse the line again for each use
    x = lines.select(*keys, F.inline(F.array(found)))
    known = F.col("shaped")
    for c in HEADER:
        known = known & F.col(c).isNotNull()
    return x.withColumn("valid", known).drop("shaped")


def transcription(line: Column) -> Column:
    """The text of a row as evaluation takes it: what follows the fourth comma, quotes and all, or a polygon's text.

    Evaluation knows polygons of which the two numbers are whole and the text is not empty; other lines are rows.
    """
    text = polygon(line, lambda xs, ys, t: t)
    whole = F.split(F.regexp_replace(line, r"^.*\]", ""), ",", 4)
    signed = lambda i: F.get(whole, F.lit(i)).try_cast("long").isNotNull()
    return F.when((text != "") & signed(1) & signed(2), text).otherwise(X.strip(F.get(F.split(line, ",", 5), 4)))


def transcriptions(texts: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """(key, line_idx, text) of non-empty transcriptions, in their order."""
    x = annotation_lines(texts, key, text).select(key, "pos", transcription(F.col("line")).alias("text")).filter(F.col("text") != "")
    return x.withColumn("line_idx", F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1).drop("pos")


@udtf(returnType="pos int, line string")
class ParseAnnotations:
    """parse_annotations(text) for SQL: the lines of one file that hold an annotation, for parse_boxes()."""

    def eval(self, text: str):
        first = ",".join(HEADER)
        lines = (text or "").removeprefix("﻿").splitlines()
        yield from enumerate(x for x in lines if x.strip() and not x.replace(" ", "").lower().startswith(first))
