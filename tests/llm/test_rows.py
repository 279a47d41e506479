"""Rows without an id, rows that share one, repeated rows, and columns with the names of results."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docquality.llm import decontam, embed_dedup, language, licenses, line_dedup, ngram_join, packing, pii, quality, tokens
from docquality.llm.common import Scratch


def one_edit(a, b):
    """At most one word changed, added or left out."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


CLASH = ("score", "lang_pred", "n_lines", "n_exact", "n_near", "component_id", "n_shingles", "sequence_id", "offset", "item_id", "th", "row", "id", "value", "keep", "__id", "__th", "__gone", "spans", "labels", "n_tokens")


def table(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7.5) for c in CLASH} | more)
    return df


def text(rng, n):
    return " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(400)) for _ in range(n))


def test_components_by_every_way(spark, monkeypatch):
    """Crowded keys, keys of many classes, and clusters that enter another arrangement give the same components."""
    rng = random.Random(8)
    base = text(rng, 80).split()
    texts = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(80), i % 9):
            w[k] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.jaccard_components(df).collect()))
    for settings in ({"SAMPLED": 1, "SEEN": 2}, {"FEW": 1, "CLUSTER": 1, "BLOCK": 4}):
        with monkeypatch.context() as m:
            for k, v in settings.items():
                m.setattr(ngram_join, k, v)
            assert sorted(map(tuple, ngram_join.jaccard_components(df).collect())) == want
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert [r[2] for r in want] == root


def test_components_of_rows_without_an_id(spark):
    rng = random.Random(1)
    a, b, c = text(rng, 60), text(rng, 60), text(rng, 60)
    near = a.rsplit(" ", 2)[0] + " other words"
    rows = [(7, a), (None, near), (5, b), (5, b), (5, c), (9, c + " more"), (None, None), (None, ""), (3, None), (3, "")]
    got = ngram_join.jaccard_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert by == [(3, 3), (3, 3), (5, 5), (5, 5), (5, 5), (7, 7), (9, 5)]
    assert sorted(r["component_id"] or 0 for r in got if r["doc_id"] is None) == [0, 0, 7]
    kept = ngram_join.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(7, a), (5, b), (5, c), (0, ""), (0, ""), (3, ""), (3, "")])


def test_overlaps_of_rows_that_share_an_id(spark):
    rng = random.Random(2)
    item, clean = text(rng, 30), text(rng, 50)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string").withColumn("words", F.lit(1))
    rows = [(4, item + " x"), (4, clean), (None, "y " + item), (None, clean), (4, item + " x")]
    got = decontam.contaminated(table(spark, rows), bench)
    assert sorted((r["doc_id"] or 0, r["doc_word"]) for r in got.collect()) == [(0, 1), (4, 0), (4, 0)]
    kept = decontam.drop_contaminated(table(spark, rows), bench)
    assert [r["text"] for r in kept.collect()] == [clean, clean] and kept.columns == table(spark, rows).columns


@pytest.mark.parametrize("replaced", ["random", "spread"])
def test_every_overlap_within_the_bound_is_found(spark, replaced):
    rng = random.Random(3)
    items, rows, want = [], [], set()
    for n in (6, 8, 11, 12, 13, 15, 16, 20, 25, 30, 50):
        for k in range(n // 5 + 1):
            if n - k < 0.8 * n:
                continue
            w = text(rng, n).split()
            items.append((len(items), " ".join(w)))
            at = rng.sample(range(n), k) if replaced == "random" else [round((i + 0.5) * n / k) % n for i in range(k)]
            changed = ["other" if i in at else x for i, x in enumerate(w)]
            rows.append((len(rows), " ".join([*text(rng, 9).split(), *changed, *text(rng, 9).split()])))
            want.add((len(rows) - 1, len(items) - 1))
    rows += [(1000 + i, text(rng, 80)) for i in range(40)]
    got = decontam.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "same line here"), (2, "uniq first\nsame line here"), (2, "uniq first\nunique second only in this row"), (None, "same line here"), (None, "of its own"), (2, "uniq first\nsame line here")]
    df = table(spark, rows)
    got = line_dedup.dedup_lines(df, counts=False)
    assert got.columns == df.columns and got.filter("n_lines <> 7.5 or __gone <> 7.5").count() == 0
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect())
    # a null id comes first, so its line is the earliest; of the two texts of id 2 the one with the lesser hash keeps what they share
    order = [r["text"] for r in df.filter("doc_id = 2").select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h").collect()]
    first = {order[0]: "uniq first"}
    assert texts[:3] == [(0, "of its own"), (0, "same line here"), (1, "")]
    for t in (rows[1][1], rows[2][1]):
        lines = [x for x in t.split("\n") if x != "same line here" and (x != "uniq first" or t in first)]
        assert texts[3:].count((2, "\n".join(lines))) == (2 if t == rows[1][1] else 1)
    counted = line_dedup.dedup_lines(df)
    assert {c: t for c, t in counted.dtypes if c.startswith("n_")}["n_lines"] == "bigint"


def test_long_documents_in_linear_time(spark):
    lines = "\n".join(f"line number {i % 30_000} of a long document with words" for i in range(60_000))
    got = line_dedup.dedup_lines(table(spark, [(1, lines), (2, "line number 5 of a long document with words\nnew")])).orderBy("doc_id").collect()
    assert got[0]["n_lines"] == 60_000 and got[0]["n_exact"] + got[0]["n_near"] == 59_999 and got[1]["text"] == "new"


def test_lengths_of_repeated_rows(spark):
    rows = [(1, "hello world"), (1, "hello world"), (None, "hello"), (2, None)]
    h = {r["n_tokens"]: r["n_docs"] for r in tokens.length_histogram(table(spark, rows)).collect()}
    assert h == {2: 2, 1: 1, 0: 1}
    assert tokens.length_histogram(table(spark, rows).limit(0)).count() == 0


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=16)
    rows = [(1, [float(x) for x in v * 1e200], "a"), (2, [float(x) for x in v * 1e-200], "a"), (3, [float(x) for x in v], "a"), (3, [float(x) for x in -v], "a"), (None, [float(x) for x in v], "a"), (5, [float(x) for x in v], None), (6, [float(x) for x in v * 3], "a"), (6, [float(x) for x in v * 3], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"rep": F.lit(1), "n_links": F.lit("x"), "dim": F.lit(0)})
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embed_dedup.near_vectors(df).collect())
    assert got == [(0, 0, 0, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (5, 0, 5, True), (6, 3, 1, False), (6, 3, 1, False)]


def test_personal_data_of_rows_that_share_an_id(spark):
    texts = [(i, f"write to user{i}@mail.example.com today") for i in range(8)]
    rows = [*texts, (50, "write to agent4711x today"), (50, "zz"), (None, "write to agent4712x today"), (None, "no data")]
    got = pii.digest(pii.find_pii(table(spark, rows))).collect()
    assert len(got) == len(rows)
    assert sorted(r["spans"] for r in got if r["doc_id"] == 50 or r["doc_id"] is None) == ["", "", "id:9:19", "id:9:19"]


def test_context_words_are_whole():
    long = "x" * 90 + "1"
    one, other = (pii.candidates(f"{w} a1b2c3d4", [], 6) for w in (long + "a", long + "b"))
    assert one[-1]["patterns"] != other[-1]["patterns"]  # a difference beyond the 64th code point counts
    t = "mail to a1@b.c,d2@e.f now"
    assert [x["patterns"] for x in pii.candidates(t, pii.base_spans(t), 6)] == [["mail to _", "to _ ,"], [", _ now", "to , _"]]
    big = "w" * 50_000 + "," + ",".join(f"1.2.3.{i % 250}" for i in range(4000))
    pii.candidates(big, pii.base_spans(big), 6)  # in linear time


def test_languages_of_long_words_and_repeated_rows(spark):
    words = {"de": "schön straße über nicht und", "en": "the with where thing over"}
    rows = [(i, " ".join(words["de" if i % 2 else "en"].split() * 4), "de" if i % 2 else "en") for i in range(200)]
    probe = [(500, "straßeschön" * 400, None), (500, "straßeschön" * 400, None), (None, "thewhere" * 900, None), (501, "x" * 255 + "ß", None), (502, "—🙂 12", None)]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string, lang string").withColumns({"score": F.lit("c"), "SCORE2": F.lit(1)})
    got = {(r["doc_id"], r["text"][:9]): r for r in language.identify(df, F.col("doc_id") < 200).filter("doc_id is null or doc_id >= 500").collect()}
    assert got[500, "straßesch"]["lang_pred"] == "de" and got[None, "thewherethe"[:9]]["lang_pred"] == "en" and got[502, "—🙂 12"]["lang_pred"] == "und"
    word = b"ab" * 500
    cut = language.windows(word)
    assert sum(hi - lo for _, lo, hi in cut) == len(word) + 2 and all(len(x) == language.WINDOW for x, _, _ in cut)
    seen = b"".join(x[lo:hi] for x, lo, hi in cut)
    assert seen == b" " + word + b" "
    assert all((lo >= language.CONTEXT or i == 0) and (len(x) - hi >= language.CONTEXT or i == len(cut) - 1) for i, (x, lo, hi) in enumerate(cut))


def test_pooling_is_the_mean_over_all_positions():
    rng = np.random.default_rng(5)
    net = language.Network.new(3, 4, rng)
    reader = language.Reader(net.weights)
    t = "Abc déf abc xyzzy"
    want, n = np.zeros(3), 0
    for w in language.words_of(t):
        y = net.log_probabilities(np.frombuffer(b" " + w + b" ", np.uint8)[None])
        want += y[0].sum(0)
        n += len(w) + 2
    got = reader.read([t, "", "12"])
    assert np.allclose(got[0], [*want, n], rtol=1e-4) and not got[1:].any()
    slow = np.stack([s[0] for s in net.states("f", np.frombuffer(b" abc ", np.uint8)[None])])
    assert np.allclose(slow, net.read("f", np.frombuffer(b" abc ", np.uint8)[None]), atol=1e-6)


def test_licenses_of_rows_that_share_an_id(spark):
    rows = [(1, "the MIT License"), (1, "nothing"), (None, "the MIT License"), (1, "the MIT License")]
    got = licenses.license_scan(table(spark, rows)).collect()
    assert sorted(r["base_labels"] for r in got) == ["", "mit", "mit", "mit"]


def test_quality_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, 20) + (" junk!!" * 5 if i % 3 == 0 else ""), "h", "p") for i in range(90)]
    rows += [(1, text(rng, 20), None, None), (1, text(rng, 20), None, None), (None, text(rng, 20), "h", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"n": F.lit(1), "mass": F.lit(2), "quality": F.lit("x"), "p": F.lit(0)})
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, labels).collect()
    assert len(got) == 93 and sum(r["doc_id"] == 1 for r in got) == 3 and all(0 <= r["score"] <= 1 for r in got)


def unpacked(rows, size):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= size
    return len(at)


@pytest.mark.parametrize("size", [1, 64, 1024, 2048, 4096])
def test_sweeps_against_serial_best_fit(spark, size):
    from collections import Counter

    from docquality.llm.common import Scratch

    rng = random.Random(size)
    kinds = [lambda: rng.randint(1, size), lambda: min(size, 1 + int(rng.expovariate(6 / size))), lambda: rng.choice([size, size // 2 or 1, size // 3 or 1, size // 7 or 1])]
    for kind in kinds[: 3 if size in (64, 1024) else 1]:
        lengths = [max(1, kind()) for _ in range(1500)]
        pieces = spark.createDataFrame(list(enumerate(lengths)), "id long, value long")
        rows = [{"sequence_id": r["sequence"], "offset": r["offset"], "length": lengths[r["id"]]} for r in packing.matched(pieces, size, Scratch(spark, "t")).collect()]
        assert len(rows) == len(lengths)
        serial = max((f + n for _, _, n, f, _ in packing.best_fit(Counter(lengths), size)), default=0)
        assert unpacked(rows, size) <= serial + max(1, serial // 200)


def test_packing_of_rows_that_share_an_id(spark):
    rows = [(1, "hello world"), (1, "hello world"), (1, "other"), (None, "hello"), (None, None), (2, "a " * 5000)]
    got = packing.pack(table(spark, rows), size=64).collect()
    unpacked(got, 64)
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got if r["doc_id"] != 2) == [(0, 1), (0, 2), (1, 2), (1, 3), (1, 3)]
    assert packing.pack(table(spark, rows).limit(0)).columns == packing.pack(table(spark, rows)).columns


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = "the and with thing over where there is that from about other people would could after first water".split()
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
    passage, shared = say(30), say(12)
    base = ["\n".join(say(rng.randrange(10, 40)) for _ in range(3)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[0]), (101, base[1].replace(" ", "  ") + " tail"), (102, say(20) + "\n" + passage), (103, shared + "\n" + say(30)), (104, shared + "\n" + say(31)), (105, "1234"), (106, None), (107, " ")]
    rows += [(200, say(40)), (200, say(40)), (None, say(40)), (None, say(41)), (201, base[2]), (201, base[2])]
    df = table(spark, rows, lang=F.lit("en"), source=F.lit("s"), n_chars=F.length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    th = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}

    # language: letters make it; lines: the earliest stays, by id (none first), hash and place; long ones within one edit
    docs = [(i, t) for i, t in rows if t and re.search("[a-z]", t)]
    ranked = sorted({(i is not None, i or 0, th[i, t], n, x) for i, t in docs for n, x in enumerate(t.split("\n")) if x.strip()})
    seen, gone = [], set()
    for some, i, h, n, x in ranked:
        w = x.lower().split()
        if any(w == s or min(len(w), len(s)) >= 8 and one_edit(w, s) for s in seen):
            gone.add((i if some else None, h, n))
        seen.append(w)
    docs = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, th[i, t], n) not in gone)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t.strip()]
    # near duplicates: five-word shingles, four fifths; one row of each component
    sets = []
    for _, t in docs:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    sizes = len({r for r in root})
    least = {}
    for k, r in enumerate(root):
        key = (docs[k][0] is None, docs[k][0] or 0)
        least[r] = min(least.get(r, key), key)
    want = sorted(x for r, x in least.items() if not any(passage in docs[k][1] for k in range(len(docs)) if root[k] == r))

    got = P.run(spark, str(tmp_path)).collect()
    unpacked(got, 1024)
    assert sizes > 20 and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["piece"] == 0) == want
    stage = df
    for _, f in P.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == df.columns and stage.filter("score <> 7.5 or n_lines <> 7.5 or item_id <> 7.5").count() == 0


def test_near_duplicates_write_no_more_than_texts(spark, monkeypatch):
    """Beside the keys no table is larger than the texts, though every text has a near copy."""
    rng = random.Random(5)
    texts = [[rng.choice("abcdefghijklm") + str(rng.randrange(3000)) for _ in range(1500)] for _ in range(60)]
    rows = [(2 * i + j, " ".join([*t[: len(t) - 20 * j], *["new"] * j])) for i, t in enumerate(texts) for j in (0, 1)]
    df = table(spark, rows).repartition(4)
    size, keep = {}, Scratch.keep

    def kept(self, x, *of):
        out = keep(self, x, *of)
        if not any(c.startswith("k") for c in x.columns):
            size[tuple(x.columns)] = max(size.get(tuple(x.columns), 0), self.bytes_of(out))
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    want = sorted(map(tuple, ngram_join.jaccard_components(df).collect()))
    assert [r[2] for r in want] == [i - i % 2 for i in range(120)]
    assert max(size.values()) < sum(len(t) for _, t in rows), size


def test_pairs_in_parts(spark, monkeypatch):
    """Pairs and blocks that are moved in many parts give the same components."""
    rng = random.Random(8)
    base = text(rng, 80).split()
    rows = [(i, " ".join([*(f"x{rng.randrange(50)}" if rng.random() < i % 9 / 80 else w for w in base)])) for i in range(24)]
    want = sorted(map(tuple, ngram_join.jaccard_components(table(spark, rows)).collect()))
    for k, v in {"FEW": 1, "BLOCK": 4, "MOVED": 60}.items():
        monkeypatch.setattr(ngram_join, k, v)
    assert sorted(map(tuple, ngram_join.jaccard_components(table(spark, rows)).collect())) == want
