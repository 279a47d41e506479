"""Extraction, evaluation, files and plans on invented documents."""

import pytest
from pyspark.sql import functions as F

from docquality.functions.config import AugmentationConfig, ExtractionConfig
from docquality.operators import augment, evaluate, extract, ranking, signals, splits
from docquality.sources import annotations, files, ocr, sinks
from docquality.streaming import stages


def documents(spark, kind, *lines):
    rows = [(1, kind, i, t, 90.0 - i) for i, t in enumerate(lines)]
    return extract.line_documents(spark.createDataFrame(rows, "doc_id long, document_type string, line_idx int, text string, confidence double"), "doc_id")


def fields(spark, kind, *lines):
    return {r["field_name"]: r["value"] if r["value_list"] is None else r["value_list"] for r in extract.extract_fields(documents(spark, kind, *lines)).collect()}


def test_front_of_a_licence(spark):
    got = fields(
        spark, "CNH_Frente", "CARTEIRA NACIONAL", "NOME", "Rita Moura", "", "CPF", "131.334.317-06", "DATA NASCIMENTO", "08/07/1997", "FILIAÇÃO", "Abel Moura", "Lia Moura", "Zé", "CAT. HAB.", "Nº REGISTRO", "04522960000", "VALIDADE", "21/12/2O30",
    )
    assert got["nome"] == "Rita Moura"
    assert got["cpf"] == "131.334.317-06"
    assert got["data_nascimento"] == "08/07/1997"
    assert got["filiacao"] == ["Abel Moura", "Lia Moura"]
    assert got["numero_registro"] == "NO"  # what is left of the label line
    assert got["categoria"] == "."
    assert got["validade"] == "21/12/2030"
    assert "primeira_habilitacao" not in got


def test_no_window_for_a_value_without_date(spark):
    got = fields(spark, "RG_Verso", "DATA EXPEDIÇÃO", "sem data", "01/02/2003")
    assert "data_expedicao" not in got
    assert got["filiacao"] == []


def test_site_cannot_survive_digit_noise(spark):
    assert "site" not in fields(spark, "CPF_Verso", "WWW.CORREIOS.COM.BR")


def test_unknown_types_have_no_fields(spark):
    assert fields(spark, "XYZ", "NOME", "Rita") == {}


def test_scores_of_an_empty_list(spark):
    found = signals.with_signals(extract.extract_fields(documents(spark, "CNH_Frente", "CARTEIRA", "CPF")), "2024-01-01")
    row = found.filter("field_name = 'filiacao'").first()
    assert row["format_valid"] is False
    assert row["parsing_confidence"] == pytest.approx(65.22)
    assert {c["name"]: c["score"] for c in row["score_components"]}["field_extracted"] == 47.83


def test_warnings(spark):
    docs = documents(spark, "CPF_Frente", "NOME", "Rita")
    w = signals.quality_warnings(signals.with_signals(extract.extract_fields(docs), "2024-01-01"), docs, "doc_id", 95.0)
    assert {(r["kind"], r["field_name"]) for r in w.collect()} >= {("missing_field", "numero_cpf"), ("missing_field", "data_nascimento"), ("low_ocr_confidence", "nome")}


def test_predominant_error(spark):
    t, f = True, False
    rows = [(t, t, f), (f, t, t), (f, f, t), (t, f, f), (f, f, f)]
    df = spark.createDataFrame(rows, "r boolean, o boolean, p boolean")
    got = [x[0] for x in df.select(evaluate.predominant_error(F.col("r"), F.col("o"), F.col("p"))).collect()]
    assert got == ["retificacao_imagem", "ocr", "parsing", "retificacao_sem_impacto_final_claro", "sem_erro_relevante"]


def test_document_without_ground_truth_is_a_severe_failure(spark):
    docs = documents(spark, "CPF_Verso", "EMISSÃO", "2001").withColumn("mean_confidence", F.lit(1.0))
    s = signals.with_signals(extract.extract_fields(docs), "2024-01-01")
    none = s.limit(0)
    c = evaluate.compare_fields(docs, s, none.select("doc_id", "field_name", "value", "value_list")).unionByName(evaluate.compare_texts(docs, docs.limit(0)))
    m = evaluate.document_metrics(c).first()
    assert m["total_fields"] == 0 and m["severe_failure"] and m["end_to_end_error"] and not m["document_accuracy_strict"] and not m["ocr_is_good"]


def test_split_sizes_and_leakage(spark):
    rows = [(f"{c}{i}", c, k) for c in "abcdef" for i in range(100) for k in range(2)]
    s = splits.split_samples(spark.createDataFrame(rows, "g string, label string, k int"), "g", "label")
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(n.values()) == 1200 and splits.leakage(s, "g").first()["leaking"] == 0
    whole = splits.split_groups(spark.createDataFrame([(f"g{i}", f"l{i}") for i in range(600)], "g string, label string"), "g", "label")
    assert {r["split"]: r["count"] for r in whole.groupBy("split").count().collect()} == {"train": 419, "val": 120, "test": 61}
    with pytest.raises(ValueError):
        splits.split_groups(s, "g", "label", shares=(0.5, 0.2, 0.1))


def test_ranks_without_a_window_over_the_group(spark):
    rows = [("c", f"{i * 37 % 1000:04d}") for i in range(1000)]
    got = ranking.rank_within(spark.createDataFrame(rows, "c string, k string"), ["c"], "k").collect()
    assert all(r["rank"] == int(r["k"]) for r in got)


def test_round_robin(spark):
    p = augment.plan(spark.createDataFrame([("a", f"{i:03d}") for i in range(8)], "c string, d string"), "c", "d")
    names = [r["scenario"] for r in p.filter("is_augmented").orderBy("document_id").collect()]
    assert names[0] == "phone_tilt_color_background" and names[6] == names[0] and names[5] == "multi_degradation"
    assert {r["seed"] for r in p.filter("not is_augmented").collect()} == {42}


def test_points(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 0), (0, 0), (0, 5), (10, 5))])
    r = spark.range(1).select(augment.order_points(pts).alias("o")).withColumn("s", augment.target_size(F.col("o"))).first()
    assert [(p["x"], p["y"]) for p in r["o"]] == [(0, 0), (10, 0), (10, 5), (0, 5)] and tuple(r["s"]) == (10, 5)


def test_applied_transforms(spark):
    kind = "array<struct<name:string,applied:boolean,params:string,children:array<struct<name:string,applied:boolean,params:string>>>>"
    df = spark.createDataFrame([([("OneOf", True, "", [("Blur", True, "3"), ("Median", False, "5")]), ("Affine", True, "r", [])],)], f"t {kind}")
    got = df.select(augment.applied_transforms(F.col("t"), 1)).first()[0]
    assert [(x["name"], list(x["applied_to"])) for x in got] == [("Blur", ["image"]), ("Affine", ["image", "mask", "annotations"])]


def test_paths(spark):
    df = spark.createDataFrame([("/d/CNH_Frente/00003658__aug01.jpg",), ("/d/x/x__y__z.jpg",), ("/d/RG_Verso/a_mask.png",)], "path string")
    p = F.col("path")
    got = df.select(files.origin_id(p), files.document_type(p), files.is_batch_image(p), files.document_key(files.stem(p))).collect()
    assert [tuple(r)[:3] for r in got] == [("00003658", "CNH_Frente", True), ("x", None, True), ("a_mask", "RG_Verso", False)]
    keys = spark.createDataFrame([("00003658_gt_ocr",), ("00003658_in",), ("00003658_gt_segmentation",), ("mask",)], "s string")
    assert [r[0] for r in keys.select(files.document_key(F.col("s"))).collect()] == ["00003658"] * 3 + ["mask"]


def test_files_and_encodings(spark, tmp_path):
    d = tmp_path / "CNH_Frente"
    d.mkdir()
    (d / "a.txt").write_bytes("x,y,width,height,transcription\n1,2,3,4,NÃO".encode("cp1252"))
    (d / "a.jpg").write_bytes(b"\xff\xd8\xff0")
    (d / "b.jpg").write_bytes(b"\xff\xd8\xff0")
    (d / "a_mask.jpg").write_bytes(b"GIF8")
    listed = files.files(spark, str(tmp_path))
    images = files.with_ground_truth(files.batch_images(listed), listed)
    assert [(r["path"][-5:], r["ground_truth_path"] is not None) for r in images.orderBy("path").collect()] == [("a.jpg"[-5:], True), ("b.jpg"[-5:], False)]
    t = annotations.transcriptions(files.text_files(spark, str(tmp_path)))
    assert [r["text"] for r in t.collect()] == ["NÃO"]
    checked = stages.with_validity(listed).select("path", "validity").collect()
    assert {r["path"].rsplit("/")[-1]: r["validity"] for r in checked}["a_mask.jpg"] == "unknown_format"


def test_annotations(spark):
    text = '﻿x, y, width, height, transcription\n1,2,3,4,"A, B"\n\n[519, 187, 188, 520], [23, 27, 44, 41], -1, -1, T\nbad'
    df = spark.createDataFrame([("f", text)], "path string, value string")
    got = annotations.parse_boxes(annotations.annotation_lines(df), "path", "pos").orderBy("pos").collect()
    assert [(r["x"], r["y"], r["width"], r["height"], r["transcription"], r["valid"]) for r in got] == [(1, 2, 3, 4, "A, B", True), (187, 23, 333, 21, "T", True), (None, None, None, None, "", False)]
    spark.udtf.register("parse_annotations", annotations.ParseAnnotations)
    good = text.rsplit("\n", 1)[0].replace("'", "")
    spark.createDataFrame([(good,)], "v string").createOrReplaceTempView("ann")
    assert spark.sql("select count(*) from ann, lateral parse_annotations(v)").first()[0] == 2


def test_recognition_boundary(spark):
    images = spark.createDataFrame([("a", bytearray(b"NOME RITA\nX")), ("b", bytearray(b""))], "doc_id string, content binary")
    raw = ocr.recognise(images, ocr.TextBackend(), ("pre_ocr",))
    lines = ocr.lines(ocr.words(raw, "doc_id"), "doc_id").orderBy("line_idx").collect()
    assert [r["text"] for r in lines] == ["NOME RITA", "X"]

    class Broken:
        def recognise(self, content, version):
            raise RuntimeError("no engine")

    assert {r["error"] for r in ocr.recognise(images, Broken(), ("v",)).collect()} == {"RuntimeError: no engine"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"], None)], "b int, a array<string>, c string")
    assert sinks.flat(df).columns == ["a", "b", "c"]
    sinks.save_batch(str(tmp_path / "out"), df, df, df, df, df)
    assert (tmp_path / "out" / "metrics.md").read_text().startswith("# Metrics")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_json(df, str(tmp_path / "out" / "results"))
    with pytest.raises(ValueError):
        sinks.check_output("/data/set", ("/data/set/images",))
    rows = spark.createDataFrame([(str(tmp_path / "x" / "f.txt"), "hi")], "p string, c string")
    assert sinks.write_artefacts(rows, "p", "c").first()["bytes"] == 2 and (tmp_path / "x" / "f.txt").read_text() == "hi"


def test_job_states():
    s = None
    for e in ("upload", "start", "low_confidence", "nonsense", "review"):
        s = stages.next_state(s, e)
    assert s == "Completed"


def test_stream_of_stage_metrics(spark, tmp_path):
    import datetime

    rows = [(datetime.datetime(2024, 1, 1, h), "ocr", float(h)) for h in range(4)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stages.stage_metrics(stream, window="2 hours").writeStream.outputMode("complete").format("memory").queryName("stage_metrics").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["n"], r["mean_value"]) for r in spark.table("stage_metrics").collect())
    assert got == sorted((r["n"], r["mean_value"]) for r in stages.stage_metrics(events, window="2 hours").collect()) == [(2, 0.5), (2, 2.5)]


def test_settings():
    with pytest.raises(ValueError):
        ExtractionConfig("2024-01-01", least_confidence=101)
    with pytest.raises(ValueError):
        AugmentationConfig(jpeg_quality=10)
    assert AugmentationConfig(extensions=(".JPG",)).extensions == ("jpg",)


def test_cells_of_annotations(spark):
    import csv

    rows = ["1,2,3,4,Rua A,,12", "1,2,3,4," + ",".join(f"c{i}" for i in range(100)), '1,2,3,4,"say ""no"", twice"x,y', '"1",2,3,4, a b\t', "1,2,3,4,", "1,2,3,4", "a,2,3,4,t", '1,2,3,4,"open, to the end', "1.5,-2,3e1,4,x"]
    rows += ["[1, 2.5 -3],[4;5],-1,7,T, U", "[1],[2],x,1,t", "[1],[2],1,1,", "[],[2],1,1,t", '1,2,3,4,' + '""' * 5000]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(rows)], "path string, pos int, line string")
    got = {r["pos"]: r for r in annotations.parse_boxes(df, "pos").collect()}
    for i in (0, 1, 2, 3, 4, 7, 8):
        want = next(csv.reader([rows[i]]))
        assert got[i]["valid"] and got[i]["transcription"] == ",".join(want[4:]).strip(), rows[i]
        assert [got[i][c] for c in annotations.HEADER] == [float(x) for x in want[:4]]
    assert not got[5]["valid"] and not got[6]["valid"] and not got[10]["valid"] and not got[12]["valid"]
    assert [got[9][c] for c in (*annotations.HEADER, "transcription")] == [-3.0, 4.0, 5.5, 1.0, "T, U"] and got[11]["valid"]
    said = {r["pos"]: r["t"] for r in df.select("pos", annotations.transcription(F.col("line")).alias("t")).collect()}
    assert said[0] == "Rua A,,12" and said[2] == '"say ""no"", twice"x,y' and said[9] == "T, U" and said[5] is None
