"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import augment, classify, evaluate, extract, signals, splits
from ..sources import annotations, files, id_cards, ocr
from ..streaming import stages
from . import rules as R

AS_OF = "2020-01-01"
LEAST_CONFIDENCE = 55.0
CLASSES = list(range(10))
#: Distances between vectors and class means are close together; this sets classes apart.
SHARPNESS = 20.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Lines and text


def lines_of(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.filter(X.not_blank(F.col("line")))


def line_explode(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "pos", F.length("line").alias("n_chars"), F.md5("line").alias("digest"))


def norm_text(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "pos", X.normalize_text(F.col("line")).alias("norm"))


def norm_compare(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.compact(F.col("text")).alias("compact"))


def scalars(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    t = F.col("text")
    return c.select("conv_id", "turn", X.numeric_noise(t).alias("noise"), X.only_digits(t).alias("digits"), X.clean_value(t).alias("clean"))


def cpf_format_checksum(spark, sf_dir):
    c = id_cards.cards(spark, sf_dir).select("doc_id", "cpf")
    digits = X.only_digits(F.col("cpf"))
    text = F.concat(F.lit("CPF "), F.col("cpf"), F.lit(" N. "), F.substring(digits, 1, 4))
    return c.select("doc_id", X.format_cpf(digits).alias("formatted"), X.cpf_checksum_valid(F.col("cpf")).alias("valid"), X.first_cpf(text).alias("found"))


def _dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    written = (
        F.when(k % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 1, F.date_format(d, "d-M-yy")).when(k % 5 == 2, F.concat(F.lit("em "), F.translate(F.date_format(d, "dd/MM/yyyy"), "01", "OI")))
        .when(k % 5 == 3, F.concat(F.lit("31/02/"), F.date_format(d, "yyyy"))).otherwise(F.lit("sem data"))
    )
    return o.select(k.alias("o_orderkey"), written.alias("written"), F.when(k % 2 == 0, "data_nascimento").otherwise("validade").alias("field_name"))


def br_date_parse(spark, sf_dir):
    w = F.col("written")
    return _dates(spark, sf_dir).select("o_orderkey", X.parse_date(w).alias("parsed"), X.standard_date(w).alias("standard"))


def date_plausible(spark, sf_dir):
    ok = X.plausible_date(F.col("written"), F.col("field_name"), F.lit("1996-06-30").cast("date"))
    return _dates(spark, sf_dir).select("o_orderkey", "field_name", ok.alias("plausible"))


# Identity documents


def read_documents(spark, sf_dir):
    """Documents as an engine read them."""
    return extract.line_documents(id_cards.read_lines(id_cards.true_lines(id_cards.cards(spark, sf_dir))), "doc_id")


def true_documents(spark, sf_dir):
    return extract.line_documents(id_cards.true_lines(id_cards.cards(spark, sf_dir)), "doc_id")


def found_signals(spark, sf_dir):
    return signals.with_signals(extract.extract_fields(read_documents(spark, sf_dir)), AS_OF)


def true_fields(spark, sf_dir):
    return extract.extract_fields(true_documents(spark, sf_dir)).select("doc_id", "field_name", "value", "value_list")


def with_counts(docs: DataFrame) -> DataFrame:
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x["confidence"])
    words = F.aggregate("raw", F.lit(0), lambda a, x: a + F.size(F.split(X.squeeze(F.trim(x["text"])), " ")))
    return docs.withColumns({"mean_confidence": total / F.size("raw"), "n_lines": F.size("raw"), "n_words": words})


def comparisons(spark, sf_dir):
    docs = with_counts(read_documents(spark, sf_dir))
    fields = evaluate.compare_fields(docs, found_signals(spark, sf_dir), true_fields(spark, sf_dir))
    return fields.unionByName(evaluate.compare_texts(docs, true_documents(spark, sf_dir)))


def label_lines(spark, sf_dir):
    x = read_documents(spark, sf_dir).select("doc_id", F.explode("lines").alias("l"))
    return x.select("doc_id", F.col("l.idx").alias("idx"), F.col("l.norm").alias("norm"), X.is_label_line(F.col("l.norm")).alias("is_label"), F.col("l.value").alias("value"))


def label_value_search(spark, sf_dir):
    d = read_documents(spark, sf_dir)
    return d.select("doc_id", *[extract.value_near_label(F.col("lines"), labels).alias(name) for name, labels in {"nome": ("NOME",), "registro": ("N REGISTRO", "REGISTRO"), "categoria": ("CAT HAB", "CAT. HAB")}.items()])


def date_after_label(spark, sf_dir):
    d = read_documents(spark, sf_dir)
    return d.select("doc_id", *[extract.date_near_label(F.col("lines"), labels).alias(name) for name, labels in {"nascimento": ("DATA NASCIMENTO", "NASCIMENTO"), "validade": ("VALIDADE",), "expedicao": ("DATA EXPEDICAO", "EXPEDICAO")}.items()])


def label_candidates(spark, sf_dir):
    lines = F.col("lines")
    at = extract.label_index(lines, F.array(F.lit("NOME"), F.lit("REGISTRO")))
    return read_documents(spark, sf_dir).select("doc_id", at.alias("label_idx"), extract.label_candidates(lines, at).cast("int").alias("candidates"))


def filiation_collect(spark, sf_dir):
    return read_documents(spark, sf_dir).select("doc_id", F.array_join(extract.parent_names(F.col("lines")), "; ").alias("names"))


def value_line(spark, sf_dir):
    f = extract.extract_fields(read_documents(spark, sf_dir)).filter("value is not null")
    return f.select("doc_id", "field_name", extract.line_index(F.col("value"), F.col("lines")).alias("line_idx"), extract.line_confidence(F.col("value"), F.col("lines")).alias("confidence"))


def extract_fields(spark, sf_dir):
    f = extract.extract_fields(read_documents(spark, sf_dir))
    return f.select("doc_id", "document_type", "field_name", "value", F.array_join("value_list", " | ").alias("value_list"))


def parsing_signals(spark, sf_dir):
    s = found_signals(spark, sf_dir)
    return s.select("doc_id", "field_name", "expected_label_found", "came_after_expected_label", "distance_to_label", "regex_full_match", "format_valid", F.col("candidate_count").cast("int").alias("candidate_count"), "conflict_with_other_candidates", "minimum_expected_field", "minimum_expected_field_found", "cpf_has_11_digits", "cpf_check_digits_valid", "date_plausible")


def parsing_score(spark, sf_dir):
    s = found_signals(spark, sf_dir)
    return s.select("doc_id", "field_name", X.half_even(F.col("ocr_confidence"), 4).alias("ocr_confidence"), "parsing_confidence", F.size("score_components").alias("n_components"))


def quality_warnings(spark, sf_dir):
    w = signals.quality_warnings(found_signals(spark, sf_dir), read_documents(spark, sf_dir), "doc_id", LEAST_CONFIDENCE)
    return w.withColumn("confidence", X.half_even(F.col("confidence"), 1))


def field_comparison(spark, sf_dir):
    c = comparisons(spark, sf_dir).filter(F.col("field_name") != R.WHOLE_TEXT)
    return c.select("doc_id", "field_name", "predicted_value", "ground_truth_value", "field_found", "ground_truth_available", "exact_match", "accepted_match", "similarity", F.col("levenshtein_distance").cast("int").alias("levenshtein_distance"))


def text_similarity(spark, sf_dir):
    c = comparisons(spark, sf_dir).filter(F.col("field_name") == R.WHOLE_TEXT)
    return c.select("doc_id", "exact_match", "accepted_match", "similarity", F.col("levenshtein_distance").cast("int").alias("levenshtein_distance"))


def metrics_by_field(spark, sf_dir):
    return evaluate.metrics_by_field(comparisons(spark, sf_dir)).withColumn("field_name", F.coalesce("field_name", F.lit("*")))


def batch_metrics(spark, sf_dir):
    docs = with_counts(read_documents(spark, sf_dir))
    return evaluate.batch_metrics(found_signals(spark, sf_dir), evaluate.compare_texts(docs, true_documents(spark, sf_dir)), docs)


def document_metrics(spark, sf_dir):
    return evaluate.document_metrics(comparisons(spark, sf_dir))


def doc_group_summary(spark, sf_dir):
    return evaluate.group_summary(evaluate.document_metrics(comparisons(spark, sf_dir)), "document_type")


def executive_by_type(spark, sf_dir):
    return evaluate.executive_by_type(evaluate.document_metrics(comparisons(spark, sf_dir)))


def _rectification(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", (F.col("doc_id") % 10 != 3).alias("contour_found"), (F.col("doc_id") % 20 == 5).alias("fallback"))


def error_report(spark, sf_dir):
    c = comparisons(spark, sf_dir)
    m = evaluate.document_metrics(c)
    return evaluate.error_report(c, m, _rectification(m)).withColumn("problem_fields", F.array_join("problem_fields", ","))


def predominant_error(spark, sf_dir):
    return error_report(spark, sf_dir).groupBy("predominant_error").agg(F.count(F.lit(1)).alias("documents"))


# Recognition


def _raw_words(spark, sf_dir):
    """Words of documents as an engine would list them, with doubtful confidences among them."""
    x = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("w", "text"))
    k = F.col("doc_id") * 31 + F.col("line") * 17 + F.col("w") * 7
    conf = F.when(k % 29 == 0, "-1").when(k % 31 == 0, "n/a").when(k % 37 == 0, "250").otherwise((k % 101).cast("string"))
    return x.select(
        "doc_id", (F.col("line") * 100000 + F.col("w")).alias("pos"), "text", conf.alias("conf"), (F.col("w") * 50 % 977).alias("left"), (F.col("line") * 20).alias("top"), (F.length("text") * 8).alias("width"),
        F.lit(12).alias("height"), F.lit(1).alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("line").alias("line_num"),
    )


def word_confidence(spark, sf_dir):
    w = ocr.words(_raw_words(spark, sf_dir), "doc_id")
    m = ocr.mean_confidence(w, read(spark, sf_dir, "documents"), "doc_id")
    return m.withColumn("mean_confidence", X.half_even(F.col("mean_confidence"), 4))


def words_to_lines(spark, sf_dir):
    x = ocr.lines(ocr.words(_raw_words(spark, sf_dir), "doc_id"), "doc_id")
    return x.select("doc_id", "line_idx", "line_key", F.md5("text").alias("text_digest"), X.half_even(F.col("confidence"), 4).alias("confidence"), "left", "top", "width", "height")


def best_candidate(spark, sf_dir):
    d = with_counts(read_documents(spark, sf_dir)).select("doc_id", "n_words", "mean_confidence")
    shift = F.when(F.col("doc_id") % 3 == 0, 0.0).when(F.col("doc_id") % 3 == 1, 2.5).otherwise(-2.5)
    two = d.withColumn("version", F.lit("rectified")).unionByName(d.withColumns({"version": F.lit("pre_ocr"), "mean_confidence": F.col("mean_confidence") + shift}))
    return ocr.best_candidate(two).select("doc_id", "version", "n_words", X.half_even(F.col("mean_confidence"), 4).alias("mean_confidence"))


def timing_stats(spark, sf_dir):
    return evaluate.timing_stats(read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("value").alias("seconds")))


# Classification


def class_scores(spark, sf_dir):
    """Vectors with logits from the distances to class means; both come from the table."""
    e = read(spark, sf_dir, "embeddings").filter("label is not null and embedding is not null")
    cells = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # as many numbers as a vector has
    all_centres = centres.agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("centres"))  # one row, of a vector for each class
    sq = lambda c: F.aggregate(F.zip_with(F.col("embedding"), c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    logits = F.transform("centres", lambda s: -F.lit(SHARPNESS) * F.round(F.sqrt(sq(s["c"])), 4))
    x = e.crossJoin(F.broadcast(all_centres)).withColumn("logits", logits)
    return classify.predict(x, CLASSES).select("vec_id", F.col("label").alias("true_label"), "predicted", "max_probability", "probabilities")


def softmax_predict(spark, sf_dir):
    x = classify.probability_columns(class_scores(spark, sf_dir), CLASSES, 6)
    return x.withColumn("max_probability", X.half_even(F.col("max_probability"), 6))


def rejection_threshold(spark, sf_dir):
    return classify.rejection_threshold(class_scores(spark, sf_dir)).select(X.half_even(F.col("threshold"), 6).alias("threshold"))


def confidence_analysis(spark, sf_dir):
    x = class_scores(spark, sf_dir).withColumn("max_probability", F.round("max_probability", 9))
    a = classify.confidence_analysis(x, classify.rejection_threshold(x))
    return a.select(*[X.half_even(F.col(c), 6).alias(c) for c in a.columns])


def _rejected(spark, sf_dir):
    x = classify.reject(class_scores(spark, sf_dir), 0.15)
    folder = F.when(F.col("vec_id") % 17 == 0, "Desconhecido").when(F.col("vec_id") % 19 == 0, "misc").otherwise(F.col("true_label").cast("string"))
    return x.withColumn("true_label", classify.true_label(folder, [str(c) for c in CLASSES]))


def confusion_matrix(spark, sf_dir):
    return classify.confusion(class_scores(spark, sf_dir), [str(c) for c in CLASSES])


def classification_report(spark, sf_dir):
    r = classify.report(class_scores(spark, sf_dir), [str(c) for c in CLASSES])
    return r.select("label", *[X.half_even(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


def external_metrics(spark, sf_dir):
    m = classify.external_metrics(_rejected(spark, sf_dir), [*map(str, CLASSES), R.OTHER])
    return m.withColumn("value", X.half_even(F.col("value"), 6))


def binary_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("predicted"))
    x = read(spark, sf_dir, "labels").join(d, "doc_id").withColumnRenamed("quality", "true_label")
    r = classify.report(x, ["0", "1"])
    return r.select("label", *[X.half_even(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


# Splits and plans


def _samples(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("::", "lang", F.floor(F.col("doc_id") / 2).cast("string")).alias("group_id"), F.col("lang").alias("label"))


def group_split(spark, sf_dir):
    return splits.split_samples(_samples(spark, sf_dir), "group_id", "label")


def split_leakage(spark, sf_dir):
    return splits.leakage(group_split(spark, sf_dir), "group_id")


def scenario_round_robin(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("key"))
    return augment.plan(p, "p_brand", "key", variants=2)


def augmentation_summary(spark, sf_dir):
    return augment.summary(scenario_round_robin(spark, sf_dir))


def manifest(spark, sf_dir):
    from ..sources.sinks import manifest_rows

    m = augment.output_paths(scenario_round_robin(spark, sf_dir), "/out")
    return manifest_rows(m).select("class_name", "document_id", "variant", "label", "image_path", "mask_path", "annotation_path", "sidecar_path")


# Files


def _paths(spark, sf_dir):
    """Paths of a data set as it might be: images, masks and texts of parts, with some missing or misnamed."""
    k = F.col("p_partkey")
    stem = F.lpad(k.cast("string"), 8, "0")
    folder = F.when(k % 11 == 0, "misc").when(k % 13 == 0, "Desconhecido").otherwise(F.get(F.array(*map(F.lit, R.TYPES)), (k % 6).cast("int")))
    names = F.array(
        F.concat(stem, F.when(k % 4 == 0, "_in.JPG").when(k % 4 == 1, "__orig.jpg").when(k % 4 == 2, "__aug01.png").otherwise("_photo.jpeg")),
        F.concat(stem, F.when(k % 4 == 1, "__orig_mask.jpg").when(k % 5 == 0, "_x.jpg").otherwise("_gt_segmentation.jpg")),
        F.concat(stem, F.when(k % 7 == 0, ".csv").when(k % 4 == 2, "__aug01.txt").otherwise("_gt_ocr.txt")),
    )
    return read(spark, sf_dir, "part").select(folder.alias("folder"), F.explode(names).alias("name")).select(F.concat_ws("/", F.lit("/data"), "folder", "name").alias("path"))


def path_facts(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", files.is_batch_image(p).alias("batch_image"), files.is_inference_image(p).alias("inference_image"), files.document_type(p).alias("document_type"), files.origin_id(p).alias("origin_id"), files.document_key(files.stem(p)).alias("document_key"), classify.true_label(files.parent(p), list(R.TYPES)).alias("true_label"))


def ground_truth_join(spark, sf_dir):
    x = _paths(spark, sf_dir)
    return files.with_ground_truth(files.batch_images(x), x)


def triplet_grouping(spark, sf_dir):
    return files.triplets(_paths(spark, sf_dir))[0]


def triplet_errors(spark, sf_dir):
    return files.triplets(_paths(spark, sf_dir))[1]


def _annotation_files(spark, sf_dir):
    """An annotation file for each customer: a header, a row, a row with quotes, and a polygon."""
    k = F.col("c_custkey")
    n = lambda a, b: (k * a % b).cast("string")
    row = F.concat_ws(",", n(7, 500), n(11, 300), n(3, 90), F.lit("12"), F.col("c_name"))
    quoted = F.concat(F.concat_ws(",", n(5, 400), n(13, 200), n(2, 80), F.lit("9.5")), F.lit(',"Rua A, 12"'))
    polygon = F.concat(F.lit("["), F.concat_ws(", ", n(17, 600), n(19, 600), n(23, 600), n(29, 600)), F.lit("], ["), F.concat_ws(", ", n(31, 400), n(37, 400), n(41, 400), n(43, 400)), F.lit("], -1, -1, "), F.col("c_mktsegment"))
    head = F.when(k % 2 == 0, "x, y, width, height, transcription").otherwise("x,y,width,height,transcription")
    # a small file is one task, and parsing what is made of it takes far longer than dealing it to all cores
    dealt = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(spark.sparkContext.defaultParallelism)
    return dealt.select(k.cast("string").alias("path"), F.concat_ws("\n", head, row, F.lit(""), quoted, polygon).alias("value"))


def annotation_parse(spark, sf_dir):
    b = annotations.parse_boxes(annotations.annotation_lines(_annotation_files(spark, sf_dir)), "path", "pos")
    return b.select("path", "pos", "x", "y", "width", "height", "transcription")


def ground_truth_lines(spark, sf_dir):
    return ocr.truth_as_lines(annotations.transcriptions(_annotation_files(spark, sf_dir)), "path").select("path", "line_idx", "text", "confidence", "left", "top", "width", "height")


def bbox_convert(spark, sf_dir):
    sides = ("x", "y", "width", "height")
    b = annotation_parse(spark, sf_dir).withColumn("own", F.struct(*sides))
    moved = augment.affine(b, F.lit(90.0), F.lit(0.5), F.lit(10.0), F.lit(-5.0), F.lit(1000.0), F.lit(800.0), stay=True)
    r = moved.select("path", "pos", "own.*", *[X.half_even(F.col(c), 3).alias(f"moved_{c}") for c in sides])
    return augment.to_edges(r).select("path", "pos", "x_min", "y_min", "x_max", "y_max", *[f"moved_{c}" for c in sides])


def point_order(spark, sf_dir):
    k = F.col("c_custkey")
    p = lambda a, b: F.struct((k * a % 997).cast("double").alias("x"), (k * b % 991).cast("double").alias("y"))
    x = read(spark, sf_dir, "customer").select("c_custkey", augment.order_points(F.array(p(3, 5), p(7, 11), p(13, 17), p(19, 23))).alias("o"))
    x = x.withColumn("size", augment.target_size(F.col("o")))
    return x.select("c_custkey", *[F.col("o")[i][c].alias(f"{c}{i}") for i in range(4) for c in ("x", "y")], F.col("size.width").alias("width"), F.col("size.height").alias("height"))


# Streams, as tables


def stage_window_counts(spark, sf_dir):
    return stages.stage_metrics(read(spark, sf_dir, "events"), window="1 day")


def session_counts(spark, sf_dir):
    return stages.sessions(read(spark, sf_dir, "events"), gap="6 hours")


def routing(spark, sf_dir):
    s = found_signals(spark, sf_dir)
    r = stages.route(F.col("ocr_confidence"), F.when(F.col("doc_id") % 2 == 0, F.col("parsing_confidence")))
    return s.select("document_type", r.alias("route")).groupBy("document_type", "route").agg(F.count(F.lit(1)).alias("fields"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        line_explode, norm_text, norm_compare, scalars, cpf_format_checksum, br_date_parse, date_plausible, label_lines, label_value_search, date_after_label, label_candidates, filiation_collect, value_line,
        extract_fields, parsing_signals, parsing_score, quality_warnings, field_comparison, text_similarity, metrics_by_field, batch_metrics, document_metrics, doc_group_summary, executive_by_type, error_report,
        predominant_error, word_confidence, words_to_lines, best_candidate, timing_stats, softmax_predict, rejection_threshold, confidence_analysis, confusion_matrix, classification_report, external_metrics,
        binary_report, group_split, split_leakage, scenario_round_robin, augmentation_summary, manifest, path_facts, ground_truth_join, triplet_grouping, triplet_errors, annotation_parse, ground_truth_lines, bbox_convert,
        point_order, stage_window_counts, session_counts, routing,
    ]
    return {f.__name__: f for f in own}
