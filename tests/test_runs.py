"""Whole runs, images and training on small folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquality.functions.config import AugmentationConfig, ExtractionConfig
from docquality.operators import augment, classify, splits, train
from docquality.plans import rules, runs
from docquality.sources import files, images, ocr, sinks


def png(height=40, width=60, seed=0):
    rng = np.random.default_rng(seed)
    return images.encode(rng.integers(0, 256, (height, width, 3), dtype=np.uint8))


def test_files_of_pixels():
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 256, (7, 5), dtype=np.uint8), rng.integers(0, 256, (6, 9, 3), dtype=np.uint8)):
        assert (images.decode(images.encode(image)) == image).all()
    raw = b"P6 2 1 255\n" + bytes([1, 2, 3, 4, 5, 6])
    assert images.decode(raw).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    for kind in range(5):  # every way in which a row may be written
        image = rng.integers(0, 256, (4, 6), dtype=np.uint8).astype(int)
        out, up = [], np.zeros(6, int)
        for row in image:
            left = np.concatenate([[0], row[:-1]])
            corner = np.concatenate([[0], up[:-1]])
            near = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner, strict=True)]
            guess = (np.zeros(6, int), left, up, (left + up) // 2, np.array(near))[kind]
            out.append(images._unfiltered(kind, (row - guess) % 256, up, 1))
            up = row
        assert (np.array(out) == image).all(), kind
    assert images.decode(b"") is None and images.decode(b"\x89PNG\r\n\x1a\nx") is None and images.decode(b"GIF89a") is None


def test_likeness_and_sizes(spark):
    mask = np.zeros((50, 50), np.uint8)
    mask[10:20] = 255
    rows = [("m", bytearray(images.encode(mask))), ("p", bytearray(png())), ("bad", bytearray(b"x")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, content binary")
    got = {r["k"]: r for r in df.select("k", images.mask_likeness(F.col("content")).alias("s"), images.size(F.col("content")).alias("z")).collect()}
    assert got["m"]["s"] > 1.5 > got["p"]["s"] and got["bad"]["s"] == got["none"]["s"] == 0.0
    assert tuple(got["p"]["z"]) == (60, 40) and got["bad"]["z"]["width"] is None
    w, h = F.col("w"), F.col("h")
    r = spark.createDataFrame([(2400, 1000), (600, 301), (1500, 700)], "w int, h int").select(augment.detection_size(w, h).alias("d"), augment.ocr_size(w, h).alias("o")).collect()
    assert [tuple(x["d"])[:2] for x in r] == [(1200, 500), (600, 301), (1200, 560)]
    assert [tuple(x["o"])[:2] for x in r] == [(2200, 916), (1200, 602), (1500, 700)]


def scene(angle=0.2):
    """A bright sheet on a dark table."""
    image = np.full((300, 400, 3), 30, np.uint8)
    corners = np.array([[100, 70], [310, 90], [300, 220], [90, 200]], float)
    sheet = np.full((120, 200, 3), 220, np.uint8)
    sheet[40:60, 30:170] = 20
    m = images.homography(np.array([[0, 0], [199, 0], [199, 119], [0, 119]], float), corners)
    laid = images.warped(sheet, m, 400, 300)
    inside = images.warped(np.full((120, 200), 255, np.uint8), m, 400, 300) > 128
    image[inside] = laid[inside]
    return image, corners


def test_documents_in_pictures(spark):
    image, corners = scene()
    found = images.ordered(images.document_corners(image))
    assert np.abs(found - images.ordered(corners)).max() < 8
    flat, facts = images.rectified(image, "CNH_Frente")
    assert facts["contour_found"] and abs(flat.shape[1] / flat.shape[0] - 210 / 131) < 0.2
    assert images.rectified(np.full((80, 90, 3), 128, np.uint8), "CPF_Frente")[1]["fallback"]
    assert images.oriented(np.zeros((9, 5)), "RG_Verso").shape == (5, 9) and images.oriented(np.zeros((9, 5)), "CPF_Verso").shape == (9, 5)
    clean = images.ready_for_ocr(flat, 200, 300)
    assert set(np.unique(clean)) <= {0, 255} and 200 <= clean.shape[1] <= 300
    df = spark.createDataFrame([("a", "CNH_Frente", bytearray(images.encode(image))), ("b", "CNH_Frente", bytearray(b"x"))], "doc_id string, document_type string, content binary")
    got = {r["doc_id"]: r for r in images.rectify(df).collect()}
    assert got["a"]["contour_found"] and images.decode(bytes(got["a"]["rectified"])) is not None and got["b"]["error"] == "undecodable image"


def test_boxes_under_a_perspective(spark):
    m = images.homography(np.array([[0, 0], [100, 0], [100, 80], [0, 80]], float), np.array([[5, 4], [96, 0], [100, 80], [0, 76]], float))
    box = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, "t"), (0.0, 0.0, 0.5, 9.0, "thin")], "x double, y double, width double, height double, transcription string")
    got = augment.perspective(box, [F.lit(float(v)) for v in m.ravel()], F.lit(100.0), F.lit(80.0)).collect()
    p = np.array([[10, 20, 1], [40, 20, 1], [40, 60, 1], [10, 60, 1]], float) @ m.T
    p = p[:, :2] / p[:, 2:]
    assert len(got) == 1 and np.allclose([got[0]["x"], got[0]["y"]], p.min(0)) and np.allclose([got[0]["width"], got[0]["height"]], np.ptp(p, 0))
    moved, left = images.Scenario._moved(np.array([[10.0, 20, 30, 40], [0, 0, 0.5, 9]]), m, 100, 80, 2.0)
    assert left.tolist() == [0] and np.allclose(moved[0], [got[0][c] for c in ("x", "y", "width", "height")])


def test_transforms_and_colours(spark):
    tree = '[{"name":"OneOf","applied":true,"children":[{"name":"Compose","applied":true,"children":[{"name":"Blur","applied":true,"params":{"k":3}},{"name":"Rotate","applied":false}]}]},{"name":"Affine","applied":true,"params":"r"}]'
    got = spark.createDataFrame([(tree,), (None,)], "t string").select(augment.applied_in_json(F.col("t")).alias("x")).collect()
    assert [(x["name"], list(x["applied_to"])) for x in got[0]["x"]] == [("Blur", ["image"]), ("Affine", ["image", "mask", "annotations"])] and list(got[1]["x"]) == []
    colours = [tuple(r["c"]) for r in spark.range(200).select(augment.background(F.col("id")).alias("c")).collect()]
    assert all(any(all(lo <= v <= hi for v, (lo, hi) in zip(c, p, strict=True)) for p in rules.PALETTES) for c in colours) and len(set(colours)) > 150
    both = spark.createDataFrame([([1, 2], ["a", "b"])], "b array<int>, l array<string>")
    assert [tuple(x) for x in both.select(augment.zip_boxes(F.col("b"), F.col("l"))).first()[0]] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="differ in number"):
        spark.createDataFrame([([1], ["a", "b"])], "b array<int>, l array<string>").select(augment.zip_boxes(F.col("b"), F.col("l"))).collect()
    assert set(rules.TRANSFORMS) == set(rules.SCENARIOS) and rules.scenario_parameters(spark).filter("low > high").count() == 0


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "set" / "CPF_Frente"
    d.mkdir(parents=True)
    for i, name in enumerate(("RITA", "JOSE", "ANA")):
        lines = ["CPF", "131.334.317-06", "NOME", f"{name} SILVA", "NASCIMENTO", "01/02/1980"]
        (d / f"{i}.png").write_bytes("\n".join(lines).encode())
        (d / f"{i}.txt").write_text("\n".join(f"1,{k},3,4,{t}" for k, t in enumerate(lines)))
    (d / "3.png").write_bytes(b"bad")
    return tmp_path


def engine():
    class Engine:  # made here, so that workers need not import this module
        def recognise(self, content, version):
            if content == b"bad":
                raise ValueError("empty image")
            return ocr.TextBackend().recognise(content, version)

    return Engine()


def test_a_batch_from_folder_to_reports(spark, folder):
    root, said = str(folder / "set"), []
    out = runs.batch(spark, root, engine(), ExtractionConfig("2024-01-01", on_error="collect"), output=str(folder / "out"), say=said.append)
    assert out.summary == {runs.DISCOVERED: 4, runs.SUCCEEDED: 3, runs.FAILED: 1} and "1 failed" in said[0]
    fields = {x["field_name"]: x["value"] for r in out.results.filter("doc_id like '%0.png'").collect() for x in r["fields"]}
    assert fields["nome"] == "RITA SILVA" and fields["numero_cpf"] == "131.334.317-06"
    r = out.results.first()
    assert r["selected_version"] == "pre_ocr" and set(r["candidates"]) == {"rectified", "pre_ocr"}
    assert out.executive.filter("document_type = 'CPF_Frente'").first()["perfect_document_rate"] == 1.0
    assert out.errors.filter("predominant_error = 'falha_execucao'").first()["error"] == "ValueError: empty image"
    assert (folder / "out" / "metrics.md").exists() and (folder / "out" / "summary.json").exists()
    assert runs.batch(spark, root, engine(), ExtractionConfig("2024-01-01", on_error="collect"), limit=2).summary[runs.DISCOVERED] == 2
    with pytest.raises(Exception, match="empty image"):
        runs.batch(spark, root, engine(), ExtractionConfig("2024-01-01", on_error="fail")).results.collect()
    with pytest.raises(ValueError, match="no valid images"):
        runs.batch(spark, str(folder / "out"), engine(), ExtractionConfig("2024-01-01"))
    with pytest.raises(ValueError, match="refusing"):
        sinks.write_json(out.errors, root, "overwrite", (root,))


def test_augmentation_of_a_folder(spark, tmp_path):
    d = tmp_path / "set" / "RG_Verso"
    d.mkdir(parents=True)
    mask = np.zeros((40, 60), np.uint8)
    mask[5:30, 5:50] = 255
    for i in range(3):
        (d / f"{i:03d}_in.png").write_bytes(png(seed=i))
        (d / f"{i:03d}_gt_segmentation.png").write_bytes(images.encode(mask))
        (d / f"{i:03d}_gt_ocr.txt").write_text('x,y,width,height,transcription\n10,10,20,8,"A, B"\n30,20,15,8,C\n')
    config = AugmentationConfig(total_factor=2)
    got = runs.augmentation(spark, str(tmp_path / "set"), str(tmp_path / "out"), config).collect()
    assert len(got) == 9 and {r["variant"] for r in got} == {0, 1, 2} and not any(r["error"] for r in got)
    first = next(r for r in got if r["document_id"] == "000" and r["variant"] == 1)
    assert images.decode((tmp_path / "out" / "RG_Verso" / "000__aug01.jpg").read_bytes()).shape == (40, 60, 3)
    assert set(np.unique(images.decode((tmp_path / "out" / "RG_Verso" / "000__aug01_mask.jpg").read_bytes()))) <= {0, 255}
    assert first["label"] == "RG_Verso" and first["scenario"] == "phone_tilt_color_background" and "affine" in first["transforms"]
    assert (tmp_path / "out" / "RG_Verso" / "000__orig.txt").read_text().splitlines()[1] == '10,10,20,8,"A, B"'
    again = images.Scenario(rules.TRANSFORMS["noise_jpeg"], 5, (1, 2, 3)).apply(images.decode(png()), mask, np.empty((0, 4)))
    assert (again[0] == images.Scenario(rules.TRANSFORMS["noise_jpeg"], 5, (1, 2, 3)).apply(images.decode(png()), mask, np.empty((0, 4)))[0]).all()


def test_copies(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"123")
    pairs = spark.createDataFrame([(str(tmp_path / "a" / "x.bin"), str(tmp_path / "b" / "y.bin"))], "src string, dst string")
    assert sinks.copy_files(spark, pairs).first()["bytes"] == 3 and (tmp_path / "b" / "y.bin").read_bytes() == b"123"


def labelled(spark, n=240):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        k = i % 3
        x = rng.normal(size=4) + np.eye(4)[k] * 4
        rows.append((f"g{i}", [float(v) for v in x], "abc"[k], "train" if i % 10 < 7 else "val" if i % 10 < 9 else "test"))
    return spark.createDataFrame(rows, "id string, features array<double>, label string, split string")


def test_training_with_checkpoints(spark, tmp_path):
    data = labelled(spark)
    model, history = train.train(data, ["a", "b", "c"], epochs=12, rate=0.3)
    got = train.evaluate(model, data.filter("split = 'test'"))
    assert got["accuracy"] >= 0.9 and got["macro_f1"] >= 0.9 and got["loss"] < 0.5
    assert history[0]["train_loss"] == pytest.approx(np.log(3)) and history[-1]["train_loss"] < history[0]["train_loss"]
    best = classify.best_epoch(train.history_table(spark, history)).first()
    assert best["best_epoch"] == model.info["best_epoch"]
    train.save(spark, model, str(tmp_path / "m.json"))
    again = train.load(spark, str(tmp_path / "m.json"))
    assert np.allclose(again.weights, model.weights) and again.info["rejection_threshold"] == pytest.approx(model.info["rejection_threshold"])
    layers = spark.createDataFrame([*model.parameters(), ("frozen", 5, False)], "name string, parameters long, trainable boolean")
    assert tuple(classify.parameter_counts(layers).first()) == (20, 15, 5)
    batches = spark.createDataFrame([(2, 1.0), (6, 2.0)], "n int, loss double")
    assert classify.batch_means(batches, "loss").first()["loss"] == 1.75
    logits = data.withColumn("logits", model.logits()).withColumn("true_label", F.when(F.col("id") != "g1", F.col("label")))
    m = runs.scoring(logits.select("id", "logits", "true_label"), ["a", "b", "c"], 0.4, str(tmp_path / "reports"))
    assert m["external_total_images"] == 240 and m["external_labeled_images"] == 239
    names = {p.name for p in (tmp_path / "reports").iterdir()}
    assert {"real_inference_predictions", "real_inference_metrics.json", "real_inference_classification_report.csv", "real_inference_classification_report.txt", "real_inference_confusion_matrix.csv", "real_inference_confusion_matrix.svg"} <= names


def test_exact_thresholds(spark):
    rng = np.random.default_rng(3)
    for values in (rng.random(5000), np.round(rng.random(3000), 2), [0.5], [0.9] * 7, 1 - rng.random(2000) ** 9):
        df = spark.createDataFrame([(float(v),) for v in values], "max_probability double")
        for q in (0, 5, 50, 100):
            assert classify.rejection_threshold(df, q).first()[0] == pytest.approx(np.percentile(values, q), abs=1e-12)
    assert classify.rejection_threshold(df.limit(0)).first()[0] is None


def test_scores_of_labels_that_occur(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "z")], "true_label string, predicted string")
    r = classify.scores(df).first()
    assert r["accuracy"] == 0.5 and r["n"] == 4 and r["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_second_split_is_judged_on_its_own(spark):
    rows = [(f"{c}{i}", c) for c, n in (("a", 60), ("b", 2)) for i in range(n)]
    s = splits.split_groups(spark.createDataFrame(rows, "g string, label string"), "g", "label")
    n = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert n["b", "train"] == 1 and sum(v for (_, p), v in n.items() if p == "test") == 7 and sum(n.values()) == 62


def test_listings(spark):
    paths = spark.createDataFrame([("/d/a.csv",), ("/d/x/b.csv",), ("/d/c.jpg",), ("/d/x/d.jpg",), ("/d/x/e.png",)], "path string")
    assert [r[0] for r in files.tables_in(paths, "/d").collect()] == ["/d/a.csv"]
    assert [r[0] for r in files.input_images(paths, "/d").collect()] == ["/d/c.jpg", "/d/x/d.jpg"]
    assert [r[0] for r in files.input_images(paths, "/d/x/e.png").collect()] == ["/d/x/e.png"]
    assert files.first_images(paths, 2).count() == 2 and files.first_images(paths, None).count() == 5
