"""The pipeline, stage by stage."""

import random

import corpus_pipeline as P
from docquality.llm import language, registry
from docquality.llm.common import Scratch, documents

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns, before = docs.columns, docs.count()
    scratch = Scratch(spark, "test")
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "best_fit_packing"]
    for name, stage in P.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, SF))
        assert docs.columns == columns, name
        now = docs.count()
        assert 0.5 * before < now <= before
        before = now
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert language.UNKNOWN == "und" and registry.queries()["pipeline"] is P.run


def test_decisions(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("the and with thing over where there is that from".split()) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(n))
    passage = text(40)
    base = [text(60) for _ in range(30)]
    near = " ".join(w if i != 30 else "other" for i, w in enumerate(base[1].split()[:30])) + " " + " ".join(base[1].split()[30:])
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*base, base[0], near + " tail", "start " + passage + " end of it", "1234", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()}
    assert kept == set(range(30))
    empty = documents(spark, str(tmp_path)).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
