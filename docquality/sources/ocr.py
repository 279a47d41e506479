"""Recognised words and lines, and the boundary to engines that recognise them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def words(raw: DataFrame, *keys: str) -> DataFrame:
    """raw (keys, pos, text, conf, left, top, width, height, page_num, block_num, par_num, line_num) → words with a
    confidence above 0 and a line_key."""
    x = raw.withColumns({"text": X.strip(F.col("text")), "confidence": X.confidence(F.col("conf")), "line_key": F.concat_ws("-", "page_num", "block_num", "par_num", "line_num")})
    return x.filter((F.col("text") != "") & (F.col("confidence") > 0)).select(*keys, "pos", "text", "confidence", "left", "top", "width", "height", "line_key")


def lines(found: DataFrame, *keys: str) -> DataFrame:
    """Words by line_key: text from left to right, the box around them, and their mean confidence; from top to bottom."""
    from pyspark.sql import Window as W

    parts = F.sort_array(F.collect_list(F.struct("left", "pos", "text")))  # the words of one line
    g = found.groupBy(*keys, "line_key").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.avg("confidence").alias("confidence"), F.min("left").alias("left"), F.min("top").alias("top"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
    )
    return g.withColumn("line_idx", F.row_number().over(W.partitionBy(*keys).orderBy("top", "left", "line_key")) - 1)


def mean_confidence(found: DataFrame, documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean_confidence, n_words) of every document; 0 without words."""
    g = found.groupBy(*keys).agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n_words"))
    return documents.select(*keys).join(g, list(keys), "left").na.fill({"mean_confidence": 0.0, "n_words": 0})


def truth_as_lines(transcribed: DataFrame, *keys: str) -> DataFrame:
    """Transcriptions (keys, line_idx, text) as lines that were recognised perfectly."""
    n = F.greatest(F.length("text"), F.lit(1))
    return transcribed.withColumns({"confidence": F.lit(100.0), "left": F.lit(0), "top": F.col("line_idx") * 20, "width": n * 10, "height": F.lit(12)})


def best_candidate(candidates: DataFrame, key: str = "doc_id", preferred: str = "pre_ocr") -> DataFrame:
    """Of each document's versions the one with the best mean confidence, then most words, then the preferred one."""
    rank = F.struct("mean_confidence", "n_words", (F.col("version") == preferred).cast("int"))
    return candidates.groupBy(key).agg(F.max_by(F.struct(*[c for c in candidates.columns if c != key]), rank).alias("b")).select(key, "b.*")


# Fixed value: the rule by which a version is selected.
SELECTION_RULE = "maior_confianca_media_tesseract_desempate_por_palavras_e_pre_ocr"


def selection(candidates: DataFrame, key: str = "doc_id", preferred: str = "pre_ocr") -> DataFrame:
    """(key, selected_version, selection_rule, candidates) of candidates (key, version, mean_confidence, n_lines, n_words,
    seconds): what each version had, for audits."""
    one = F.struct(F.bround("mean_confidence", 2).alias("mean_confidence"), "n_lines", "n_words", (F.col("n_words") == 0).alias("empty_text"), F.bround("seconds", 6).alias("seconds"))
    known = candidates.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("version", one.alias("facts"))))).alias("candidates"))  # of one document
    best = best_candidate(candidates, key, preferred).select(key, F.col("version").alias("selected_version"))
    return best.join(known, key).select(key, "selected_version", F.lit(SELECTION_RULE).alias("selection_rule"), "candidates")


class OcrBackend(Protocol):
    """recognise(content, version) → rows (text, conf, left, top, width, height, page_num, block_num, par_num, line_num)."""

    def recognise(self, content: bytes, version: str) -> list[dict]: ...


class TextBackend:
    """A stand-in for an engine: content is text, and each line's words are found with full confidence."""

    def recognise(self, content: bytes, version: str) -> list[dict]:
        out = []
        for i, line in enumerate(content.decode("utf-8", "replace").splitlines()):
            left = 0
            for word in line.split():
                out.append({"text": word, "conf": "100", "left": left, "top": 20 * i, "width": 10 * len(word), "height": 12, "page_num": 1, "block_num": 1, "par_num": 1, "line_num": i + 1})
                left += 10 * (len(word) + 1)
        return out


RAW = "doc_id string, version string, pos int, text string, conf string, left int, top int, width int, height int, page_num int, block_num int, par_num int, line_num int, seconds double, error string"


#: Columns that are text, and go to Arrow as objects.
TEXT_COLUMNS = ("doc_id", "version", "text", "conf", "error")


def recognise(images: DataFrame, backend: OcrBackend, versions: tuple[str, ...] = ("rectified", "pre_ocr"), on_error: str = "collect") -> DataFrame:
    """images (doc_id, content) through an engine, once for each version. on_error: `collect` turns an exception into a
    row with the error; `fail` lets it end the job."""
    if on_error not in ("collect", "fail"):
        raise ValueError("on_error must be collect or fail")
    names = [x.split()[0] for x in RAW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            for doc_id, content in zip(b["doc_id"], b["content"], strict=True):
                for version in versions:
                    began = time.perf_counter()
                    try:
                        rows, error = backend.recognise(bytes(content), version), None
                    except Exception as e:
                        if on_error == "fail":
                            raise
                        rows, error = [{}], f"{type(e).__name__}: {e}"
                    seconds = time.perf_counter() - began
                    yield pd.DataFrame([{"doc_id": doc_id, "version": version, "pos": i, "seconds": seconds, "error": error} | r for i, r in enumerate(rows)], columns=names).astype({c: object for c in TEXT_COLUMNS})

    return images.select("doc_id", "content").mapInPandas(run, RAW)
