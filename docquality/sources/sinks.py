"""Results as files: JSON, CSV, text, reports, and the artefacts of single documents."""

from __future__ import annotations

import html
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.classify import confusion, external_metrics, report

MODES = ("errorifexists", "overwrite")


def check_output(path: str, protected: tuple[str, ...] = ()) -> None:
    """Refuse to overwrite a root, or a folder that holds (or is) a protected one."""
    p = PurePosixPath(path.split("://")[-1])
    if len(p.parts) < 3:
        raise ValueError(f"refusing to clean {path}")
    for other in protected:
        o = PurePosixPath(other.split("://")[-1])
        if p == o or p in o.parents:
            raise ValueError(f"refusing to clean {path}: it holds {other}")


def flat(df: DataFrame) -> DataFrame:
    """Columns by name, those of structs, arrays and maps as JSON text."""
    complex_ = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, complex_) else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)])


def ready(path: str, mode: str, protected: tuple[str, ...] = ()) -> str:
    """The mode, if it may be used on this path: overwriting is refused where it would clean what is protected."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "overwrite":
        check_output(path, protected)
    return mode


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", protected: tuple[str, ...] = ()) -> None:
    df.write.mode(ready(path, mode, protected)).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", protected: tuple[str, ...] = ()) -> None:
    """One JSON object a line."""
    df.write.mode(ready(path, mode, protected)).option("ignoreNullFields", False).json(path)


def write_text(df: DataFrame, path: str, column: str = "text", mode: str = "errorifexists", protected: tuple[str, ...] = ()) -> None:
    df.select(column).write.mode(ready(path, mode, protected)).text(path)


def write_file(spark: SparkSession, path: str, data: bytes | str) -> None:
    """A small file from the driver, to any file system that Spark knows."""
    raw = data.encode() if isinstance(data, str) else data
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def markdown(title: str, df: DataFrame) -> str:
    """A report table of a frame with few rows, such as a row for each field or type."""
    rows = df.collect()
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def annotation_rows(boxes: DataFrame) -> DataFrame:
    """Boxes as rows x,y,width,height,transcription in whole numbers, halves to the even one."""
    whole = [F.bround(c, 0).cast("long").alias(c) for c in ("x", "y", "width", "height")]
    return boxes.select(*[c for c in boxes.columns if c not in ("x", "y", "width", "height", "transcription")], *whole, "transcription")


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """A manifest with its class as label too, and transforms as JSON text."""
    out = manifest.withColumn("label", F.col("class_name"))
    nested = "transforms" in out.columns and not isinstance(out.schema["transforms"].dataType, T.StringType)
    return out.withColumn("transforms", F.to_json("transforms")) if nested else out


def output_paths(image: Column, document_type: Column, root: str) -> Column:
    """The folder <stem>_<type> of an image's artefacts, and their names."""
    stem = F.regexp_replace(F.element_at(F.split(image, "/"), -1), r"(?<=.)\.[^.]+$", "")
    base = F.concat(F.lit(root.rstrip("/") + "/"), stem, F.lit("_"), F.lower(document_type))
    names = {"rectified": "rectified.jpg", "pre_ocr": "pre_ocr.jpg", "text": "ocr.txt", "ocr": "ocr.json", "result": "result.json"}
    return F.struct(base.alias("folder"), *[F.concat(base, F.lit(f"/{n}")).alias(k) for k, n in names.items()])


def result_payload(document: DataFrame) -> DataFrame:
    """Documents as JSON text, confidences with 2 and seconds with 6 places."""
    rounded = {f.name: F.bround(f.name, 6 if f.name.endswith("seconds") else 2) for f in document.schema if isinstance(f.dataType, T.DoubleType)}
    x = document.withColumns(rounded) if rounded else document
    return x.select(F.to_json(F.struct(*x.columns), {"ignoreNullFields": "false"}).alias("payload"))


def write_artefacts(rows: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """Write each row's content to its path, which must be on a file system that all machines mount, and return
    (path, bytes). A file appears under its name when it is whole, so a task that runs again does no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = []
            for path, content in zip(b[path_col], b[content_col], strict=True):
                raw = content.encode() if isinstance(content, str) else bytes(content)
                local = path.removeprefix("file://")
                os.makedirs(os.path.dirname(local), exist_ok=True)
                part = f"{local}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(raw)
                os.replace(part, local)
                sizes.append(len(raw))
            yield pd.DataFrame({"path": b[path_col].astype(object), "bytes": sizes})

    return rows.select(path_col, content_col).mapInPandas(run, "path string, bytes long")


def metrics_rows(spark: SparkSession, run_id: str, values: dict[str, float], step: int = 0) -> DataFrame:
    """(run_id, step, key, value): a run's metrics as a table that any tracker can be fed from."""
    return spark.createDataFrame([(run_id, step, k, float(v)) for k, v in values.items()], "run_id string, step int, key string, value double")


def save_batch(folder: str, results: DataFrame, comparisons: DataFrame, by_field: DataFrame, executive: DataFrame, errors: DataFrame, mode: str = "errorifexists", protected: tuple[str, ...] = ()) -> None:
    """The outputs of a batch: results, comparisons (JSON and CSV), metrics and executive summary (JSON and Markdown),
    and detailed errors. Comparisons are kept while they are written, so that they are computed once. protected: folders
    that must not be cleaned."""
    spark = results.sparkSession
    ready(folder, mode, protected)
    kept = comparisons.persist()
    try:
        write_json(results, f"{folder}/results", mode, protected)
        write_json(kept, f"{folder}/comparisons", mode, protected)
        write_csv(flat(kept), f"{folder}/comparisons_csv", mode, protected)
        write_json(by_field, f"{folder}/metrics", mode, protected)
        write_file(spark, f"{folder}/metrics.md", markdown("Metrics by field", by_field))
        write_json(executive, f"{folder}/executive", mode, protected)
        write_file(spark, f"{folder}/executive.md", markdown("Executive summary", executive))
        write_json(errors, f"{folder}/errors", mode, protected)
    finally:
        kept.unpersist()


def csv_text(columns: list[str], rows: list) -> str:
    """A small table as CSV."""
    cell = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\r\n') else str(v)
    return "\n".join(",".join(map(cell, r)) for r in [columns, *rows]) + "\n"


def matrix_picture(title: str, labels: list[str], counts: list[list[int]], side: int = 56) -> str:
    """A table of counts as a picture (SVG), darker where there are more."""
    most, left = max([1, *(n for r in counts for n in r)]), 140
    text = lambda x, y, s, anchor="middle", color="#222": f'<text x="{x}" y="{y}" text-anchor="{anchor}" fill="{color}">{html.escape(str(s))}</text>'
    out = [text(left + side * len(labels) / 2, 24, title)]
    for i, name in enumerate(labels):
        out += [text(left - 8, 84 + side * i + side / 2, name, "end"), text(left + side * i + side / 2, 70, name[:9])]
        for j, n in enumerate(counts[i]):
            shade = round(255 - 200 * n / most)
            out += [f'<rect x="{left + side * j}" y="{80 + side * i}" width="{side}" height="{side}" fill="rgb({shade},{shade},255)"/>', text(left + side * j + side / 2, 84 + side * i + side / 2, n, color="#fff" if n > 0.6 * most else "#222")]
    width, height = left + side * len(labels) + 20, 100 + side * len(labels)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">{"".join(out)}</svg>\n'


def save_confusion(folder: str, name: str, predictions: DataFrame, labels: list[str], true: str = "true_label", predicted: str = "predicted", title: str = "Confusion matrix") -> None:
    """A confusion matrix as CSV (a row for each true label) and as a picture."""
    spark = predictions.sparkSession
    n = {(r["true_label"], r["predicted_label"]): r["n"] for r in confusion(predictions, labels, true, predicted).collect()}  # a row for each pair of labels
    counts = [[n[a, b] for b in labels] for a in labels]
    write_file(spark, f"{folder}/{name}.csv", csv_text(["", *labels], [[a, *r] for a, r in zip(labels, counts, strict=True)]))
    write_file(spark, f"{folder}/{name}.svg", matrix_picture(title, labels, counts))


def save_external_reports(folder: str, predictions: DataFrame, labels: list[str], mode: str = "errorifexists", protected: tuple[str, ...] = ()) -> dict[str, float]:
    """Reports of predictions (true_label, final, rejected, ...) on images of which some have a label: predictions as
    CSV, metrics as JSON, and for labelled rows a report (CSV and text) and a confusion matrix. Returns the metrics."""
    spark = predictions.sparkSession
    kept = predictions.persist()
    try:
        write_csv(flat(kept), f"{folder}/real_inference_predictions", mode, protected)
        metrics = {r["metric"]: r["value"] for r in external_metrics(kept, labels).collect()}
        write_file(spark, f"{folder}/real_inference_metrics.json", pretty(metrics))
        known = kept.filter("true_label is not null")
        if metrics.get("external_labeled_images"):
            r = report(known, labels, "true_label", "final")
            rows = [list(x) for x in r.collect()]  # a row for each label, and three
            write_file(spark, f"{folder}/real_inference_classification_report.csv", csv_text(r.columns, rows))
            shown = [[x if isinstance(x, str) else f"{x:.4f}" if isinstance(x, float) else str(x) for x in row] for row in [r.columns, *rows]]
            wide = [max(map(len, c)) for c in zip(*shown, strict=True)]
            write_file(spark, f"{folder}/real_inference_classification_report.txt", "\n".join("  ".join(x.rjust(w) for x, w in zip(row, wide, strict=True)) for row in shown) + "\n")
            save_confusion(folder, "real_inference_confusion_matrix", known, labels, "true_label", "final")
        return metrics
    finally:
        kept.unpersist()


def split_rows(samples: DataFrame) -> DataFrame:
    """Samples with their split in the columns and the order of a split table."""
    return samples.select("split", "image_path", "label", "label_index", "origin_id", "group_id").orderBy("split", "label", "image_path")


def copy_files(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Copy the file of each row's src to its dst (on a file system that all machines mount): (path, bytes)."""
    folders = [r["folder"] for r in pairs.select(F.regexp_replace("src", "/[^/]*$", "").alias("folder")).distinct().collect()]  # few, whatever the files
    if not folders:
        return spark.createDataFrame([], "path string, bytes long")
    found = spark.read.format("binaryFile").load(folders)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = pairs.select(plain(F.col("src")).alias("src"), "dst").join(found.select(plain(F.col("path")).alias("src"), "content"), "src")
    return write_artefacts(joined, "dst", "content")


def report_progress(say, done: int, total: int, what: str, error: str | None = None) -> None:
    """A line of progress for a person, by say (such as print or a logger's info)."""
    say(f"[{done}/{total}] {what}" + (f": {error}" if error else ""))


def pretty(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, indent=2, default=str)
