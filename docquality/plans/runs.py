"""Whole runs put together from the operators: recognition and evaluation of a folder of images, augmentation, scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.config import AugmentationConfig, ExtractionConfig
from ..operators import augment, classify, evaluate, extract, signals
from ..sources import annotations, files, images, ocr, sinks
from . import rules as R

# The names under which a run tells its counts.
DISCOVERED, SUCCEEDED, FAILED = "total_imagens_descobertas", "total_sucesso", "total_erros"


@dataclass
class Batch:
    """What a run made: frames, and the counts of a summary."""

    results: DataFrame
    comparisons: DataFrame
    metrics: DataFrame
    executive: DataFrame
    errors: DataFrame
    summary: dict[str, int]


def local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def dataset(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(doc_id, document_type, ground_truth_path, content) of the valid images below root, the first `limit` by path."""
    listed = files.files(spark, root)
    paths = listed.select("path")
    chosen = files.first_images(files.with_ground_truth(files.batch_images(paths), paths), limit)
    return chosen.join(listed.select("path", "content"), "path").withColumnRenamed("path", "doc_id")


def truth_documents(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """Documents as the ground truth beside the images has them."""
    texts = files.text_files(spark, root).join(chosen.filter("ground_truth_path is not null").select(F.col("ground_truth_path").alias("path"), "doc_id", "document_type"), "path")
    lines = ocr.truth_as_lines(annotations.transcriptions(texts, "doc_id"), "doc_id")
    return extract.line_documents(lines.join(chosen.select("doc_id", "document_type"), "doc_id"), "doc_id")


def recognised(chosen: DataFrame, backend: ocr.OcrBackend, on_error: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, selection, failures) of images: every version through the engine, and of each document the best one.

    documents are line_documents() with mean_confidence, n_lines and n_words; a document without lines has empty ones.
    """
    raw = ocr.recognise(chosen, backend, on_error=on_error).persist()
    kinds = chosen.select("doc_id", "document_type")
    failed = raw.filter("error is not null").groupBy("doc_id").agg(F.min("error").alias("error")).join(kinds, "doc_id")
    found = ocr.words(raw.filter("error is null and text is not null"), "doc_id", "version")
    versions = raw.filter("error is null").groupBy("doc_id", "version").agg(F.max("seconds").alias("seconds"))
    lines = ocr.lines(found, "doc_id", "version")
    counted = ocr.mean_confidence(found, versions, "doc_id", "version").join(lines.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n_lines")), ["doc_id", "version"], "left").join(versions, ["doc_id", "version"]).na.fill({"n_lines": 0})
    counted = counted.join(failed.select("doc_id"), "doc_id", "left_anti")
    best = ocr.best_candidate(counted)
    kept = lines.join(best.select("doc_id", "version"), ["doc_id", "version"]).join(kinds, "doc_id")
    docs = extract.line_documents(kept, "doc_id").drop("document_type")
    whole = best.select("doc_id", "mean_confidence", "n_lines", "n_words").join(kinds, "doc_id").join(docs, "doc_id", "left")
    return whole.withColumns({"full_text": F.coalesce("full_text", F.lit("")), "noise_text": F.coalesce("noise_text", F.lit(""))}), ocr.selection(counted), failed


def batch(spark: SparkSession, root: str, backend: ocr.OcrBackend, config: ExtractionConfig, limit: int | None = None, output: str | None = None, mode: str = "errorifexists", say=None) -> Batch:
    """Recognise, parse and evaluate the images below root. With config.on_error `collect` an image that fails becomes a row
    of the errors; with `fail` it ends the run. output: where the results are written."""
    chosen = dataset(spark, root, limit).persist()
    n = chosen.count()
    if not n:
        raise ValueError(f"no valid images below {root}")
    docs, selection, failed = recognised(chosen, backend, config.on_error)
    fields = signals.with_signals(extract.extract_fields(docs.filter("lines is not null")), config.as_of)
    truth = truth_documents(spark, root, chosen)
    true_fields = extract.extract_fields(truth).select("doc_id", "field_name", "value", "value_list")
    compared = evaluate.compare_fields(docs, fields, true_fields).unionByName(evaluate.compare_texts(docs, truth)).persist()
    by_document = evaluate.document_metrics(compared)
    warnings = signals.quality_warnings(fields, docs, "doc_id", config.least_confidence)
    own = fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("field_name", X.value_text(F.col("value"), F.col("value_list")).alias("value"), "ocr_confidence", "parsing_confidence"))).alias("fields"))
    warned = warnings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "kind", "field_name", "confidence"))).alias("warnings"))
    results = docs.select("doc_id", "document_type", "full_text", "mean_confidence", "n_lines", "n_words").join(own, "doc_id", "left").join(warned, "doc_id", "left").join(selection, "doc_id", "left")
    straight = docs.select("doc_id", F.lit(True).alias("contour_found"), F.lit(False).alias("fallback"))
    errors = evaluate.error_report(compared, by_document, straight, failures=failed)
    out = Batch(results, compared, evaluate.metrics_by_field(compared), evaluate.executive_by_type(by_document), errors, {})
    failures = failed.count()
    out.summary |= {DISCOVERED: n, SUCCEEDED: n - failures, FAILED: failures}
    if say:
        sinks.report_progress(say, n - failures, n, root, f"{failures} failed" if failures else None)
    if output:
        sinks.save_batch(output, out.results, out.comparisons, out.metrics, out.executive, out.errors, mode, (root,))
        sinks.write_file(spark, f"{output}/summary.json", sinks.pretty(out.summary))
    return out


def augmentation(spark: SparkSession, root: str, output: str, config: AugmentationConfig) -> DataFrame:
    """Augment the documents (image, mask, annotations) below root as planned, write the outputs below output, and return
    the manifest. Documents that are not complete are left out; triplets() tells which."""
    sinks.ready(output, "overwrite" if config.overwrite else "errorifexists", (root,))
    listed = files.files(spark, root)
    scored = listed.select("path", F.when(files.extension(F.col("path")).isin(*config.extensions), images.mask_likeness(F.col("content"))).otherwise(0.0).alias("mask_score"))
    triplets, _ = files.triplets(scored, config.extensions, config.most_documents)
    triplets = triplets.filter(F.col("class_name").isin(*config.classes))
    content = listed.select("path", "content")
    boxes = annotations.parse_boxes(annotations.annotation_lines(files.text_files(spark, root)), "path", "pos").filter("valid")
    held = boxes.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "width", "height", "transcription"))), lambda b: F.struct(*[b[c].alias(c) for c in ("x", "y", "width", "height", "transcription")])).alias("boxes"))
    known = triplets.join(content.toDF("image_path", "image"), "image_path").join(content.toDF("mask_path", "mask"), "mask_path").join(held.withColumnRenamed("path", "annotation_path"), "annotation_path", "left")
    planned = augment.plan(triplets, "class_name", "document_id", config.variants, config.seed, config.copy_originals)
    planned = planned.withColumn("color", augment.background(F.col("seed"))).join(known.select("class_name", "document_id", "image", "mask", "boxes"), ["class_name", "document_id"])
    made = images.augment(planned, R.TRANSFORMS, config.least_box).persist()
    placed = augment.output_paths(made.withColumn("is_augmented", F.col("variant") > 0), output)
    for path, column in (("image_path", "image"), ("mask_path", "mask"), ("annotation_path", "annotation"), ("sidecar_path", "transforms")):
        sinks.write_artefacts(placed.filter(F.col(column).isNotNull()), path, column).count()
    manifest = sinks.manifest_rows(placed.drop("image", "mask", "annotation"))
    sinks.write_csv(manifest, f"{output}/manifest", "overwrite", (root,))
    sinks.write_csv(augment.summary(placed), f"{output}/summary", "overwrite", (root,))
    sinks.write_file(spark, f"{output}/params.json", sinks.pretty(vars(config)))
    return manifest


def scoring(predictions: DataFrame, classes: list[str], threshold: float, output: str | None = None, mode: str = "errorifexists") -> dict[str, float]:
    """Metrics of scored images (logits, true_label or null) under a rejection threshold, and their reports."""
    final = classify.reject(classify.predict(predictions, classes), threshold)
    labels = [*classes, R.OTHER]
    if output:
        return sinks.save_external_reports(output, classify.probability_columns(final, classes), labels, mode)
    return {r["metric"]: r["value"] for r in classify.external_metrics(final, labels).collect()}
