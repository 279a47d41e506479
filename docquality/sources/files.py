"""Files of a data set: what their paths say, which belong together, and their bytes and lines.

Scans list files with the binaryFile source. Only queries that use `content` read it, since the scan is pruned.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import true_label
from ..operators.ranking import rank_within
from ..plans.rules import TYPES

# Extensions, and tokens of file names.
BATCH_IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
INFERENCE_IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")
TABLES = ("csv", "tsv", "parquet", "xlsx", "xls")
MASK_TOKENS = ("mask", "mascara", "bbox", "boxes", "label", "labels", "gt", "segmentation")
IMAGE_TOKENS = ("image", "imagem", "img", "doc", "document", "documento", "original", "in")
SUFFIX_TOKENS = ("gt_ocr", "gt_segmentation", "ocr", "bboxes", *MASK_TOKENS, *IMAGE_TOKENS)


def files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", glob) if glob else r).load(root)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def is_batch_image(path: Column) -> Column:
    return extension(path).isin(*BATCH_IMAGES) & ~stem(path).endswith("_mask")


def is_training_image(path: Column) -> Column:
    return file_name(path).endswith(".jpg") & ~file_name(path).endswith("_mask.jpg")


def is_inference_image(path: Column) -> Column:
    return extension(path).isin(*INFERENCE_IMAGES) & ~F.lower(file_name(path)).endswith("_mask.jpg")


def document_type(path: Column) -> Column:
    """The parent folder, if it names a type."""
    return F.when(parent(path).isin(*TYPES), parent(path))


def batch_images(paths: DataFrame) -> DataFrame:
    """(path, document_type) of valid images in folders of known types, by path."""
    p = F.col("path")
    return paths.filter(is_batch_image(p)).select("path", document_type(p).alias("document_type")).filter("document_type is not null").orderBy("path")


def with_ground_truth(images: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds ground_truth_path: the text file beside the image, or null."""
    texts = paths.filter(extension(F.col("path")) == "txt").select(F.col("path").alias("ground_truth_path"), without_extension(F.col("path")).alias("__base"))
    return images.withColumn("__base", without_extension(F.col("path"))).join(texts, "__base", "left").drop("__base")


def origin_id(path: Column) -> Column:
    """What an image and its variants share: the name before __orig or __augN, else before the first __."""
    s = stem(path)
    return F.coalesce(F.nullif(F.regexp_extract(s, r"(?i)^(.+)__(orig|aug\d+)$", 1), F.lit("")), F.split(s, "__", 2)[0])


def training_samples(paths: DataFrame, classes: list[str] = list(TYPES)) -> DataFrame:
    """(image_path, label, label_index, origin_id, group_id) of the images directly in folders of classes."""
    p = F.col("path")
    index = F.broadcast(paths.sparkSession.createDataFrame(list(enumerate(classes)), "label_index int, label string"))
    x = paths.filter(is_training_image(p)).select(p.alias("image_path"), parent(p).alias("label"), origin_id(p).alias("origin_id")).join(index, "label")
    return x.select("image_path", "label", "label_index", "origin_id", F.concat_ws("::", "label", "origin_id").alias("group_id"))


def inference_images(paths: DataFrame, root: str, classes: list[str] = list(TYPES)) -> tuple[DataFrame, DataFrame]:
    """Images below the folders directly in root, with their folder's class; and the folders without images."""
    p = F.col("path")
    folder = F.split(F.substr(p, F.lit(len(root.rstrip("/")) + 2)), "/")[0]
    inside = paths.filter(p.startswith(root.rstrip("/") + "/")).withColumn("source_folder", folder).filter(F.col("source_folder") != file_name(p))
    images = inside.filter(is_inference_image(p)).select("path", "source_folder", true_label(F.col("source_folder"), classes).alias("true_label"))
    empty = inside.select("source_folder").distinct().join(images.select("source_folder").distinct(), "source_folder", "left_anti")
    return images, empty.withColumn("warning", F.lit("no_images"))


def tables_in(paths: DataFrame, root: str | None = None) -> DataFrame:
    """(path) of tables, by path; with a root, only those directly in it."""
    p = F.col("path")
    x = paths.filter(extension(p).isin(*TABLES))
    if root is not None:
        start = root.rstrip("/") + "/"
        x = x.filter(p.startswith(start) & ~F.contains(F.substr(p, F.lit(len(start) + 1)), F.lit("/")))
    return x.select("path").orderBy("path")


def input_images(paths: DataFrame, at: str) -> DataFrame:
    """(path) of the one file at this path, whatever its kind, or of all .jpg files below it, by path."""
    p = F.col("path")
    below = p.startswith(at.rstrip("/") + "/") & p.endswith(".jpg")
    return paths.filter((p == at) | below).select("path").orderBy("path")


def first_images(images: DataFrame, n: int | None) -> DataFrame:
    """The first n by path, or all."""
    return images if n is None else images.orderBy("path").limit(n)


def document_key(s: Column) -> Column:
    """A file stem without the suffixes that name its role."""
    tokens = "|".join(sorted(map(re.escape, set(SUFFIX_TOKENS)), key=lambda x: (-len(x), x)))
    key = F.btrim(F.regexp_replace(s, rf"(?i)(?:[_\- ]*(?:{tokens}))+$", ""), F.lit("_- "))
    return F.coalesce(F.nullif(key, F.lit("")), s)


def contains_any(s: Column, tokens: tuple[str, ...]) -> Column:
    return F.lower(s).rlike("|".join(tokens))


def triplets(paths: DataFrame, images: tuple[str, ...] = ("jpg", "jpeg", "png"), cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Image, mask and annotation of each document, and the documents that do not have exactly these.

    The mask is the one of the two images whose name says so; else the one that is not named as an image; else the one
    that looks like one (mask_score, if the table has it, by likeness of its pixels), the first by path among equals.
    """
    p = F.col("path")
    scored = paths if "mask_score" in paths.columns else paths.withColumn("mask_score", F.lit(0.0))
    x = scored.filter(extension(p).isin(*images, "txt")).select("path", "mask_score", parent(p).alias("class_name"), document_key(stem(p)).alias("document_id"), (extension(p) == "txt").alias("is_text"), contains_any(stem(p), MASK_TOKENS).alias("as_mask"), contains_any(stem(p), IMAGE_TOKENS).alias("as_image"))
    image = ~F.col("is_text")
    g = x.groupBy("class_name", "document_id").agg(
        F.count_if("is_text").alias("n_text"), F.count_if(image).alias("n_image"), F.count_if(image & F.col("as_mask")).alias("n_mask"), F.count_if(image & F.col("as_image")).alias("n_named"),
        F.max(F.when(F.col("is_text"), F.col("path"))).alias("annotation_path"),
        F.max(F.when(image & F.col("as_mask"), F.col("path"))).alias("mask_named"), F.max(F.when(image & ~F.col("as_image"), F.col("path"))).alias("not_image"),
        F.max_by(F.when(image, F.col("path")), F.when(image, F.struct("mask_score", F.xxhash64("path")))).alias("__any"),
        F.min(F.when(image, F.struct((-F.col("mask_score")).alias("k"), "path"))).alias("likely"), F.min(F.when(image, F.col("path"))).alias("first"), F.max(F.when(image, F.col("path"))).alias("last"),
    )
    good = (F.col("n_text") == 1) & (F.col("n_image") == 2)
    mask = F.when(F.col("n_mask") == 1, F.col("mask_named")).when(F.col("n_named") == 1, F.col("not_image")).otherwise(F.col("likely.path"))
    ok = g.filter(good).withColumn("mask_path", mask).withColumn("image_path", F.when(F.col("mask_path") == F.col("first"), F.col("last")).otherwise(F.col("first"))).select("class_name", "document_id", "image_path", "mask_path", "annotation_path")
    if cap is not None:
        ok = rank_within(ok, ["class_name"], "document_id", name="__r").filter(F.col("__r") < cap).drop("__r")
    return ok, g.filter(~good).select("class_name", "document_id", "n_text", "n_image")


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark if valid, else as Windows-1252, else as Latin-1."""
    @F.pandas_udf("string")
    def fallback(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            try:
                return b.decode("cp1252")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        return s.astype(object).map(one, na_action="ignore").astype(object)

    text = F.try_validate_utf8(content.cast("string"))
    return F.when(text.isNotNull(), F.regexp_replace(text, "^﻿", "")).otherwise(fallback(content))


def text_files(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, value) of whole text files, whatever their encoding."""
    return files(spark, root, glob).select("path", decode(F.col("content")).alias("value"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
