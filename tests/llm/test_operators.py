"""Each operator against a brute-force version, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquality.llm import decontam, embed_dedup, language, licenses, line_dedup, ngram_join, packing, pii, quality, tokens

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


ODD = [None, "", " \n\t", "x", "\x00 é 🙂", "word " * 30_000, "a" * 50_000]


def test_jaccard_components_by_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    base = [words(rng, n) for n in (3, 4, 9, 12, 40, 41, 120)]
    texts = [" ".join(b) for b in base for _ in range(2)] + ODD
    for b in base[2:]:
        for _ in range(12):
            c = list(b)
            for _ in range(rng.randrange(1, 3)):
                c[rng.randrange(len(c))] = "new" + str(rng.randrange(1000))
            texts.append(" ".join(c).upper())

    def brute(n, num, den):
        sets = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            k = min(n, len(w))
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
        root = list(range(len(texts)))
        for i, j in itertools.combinations(range(len(texts)), 2):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
        return {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))}

    got = ngram_join.jaccard_components(docs(spark, texts), words=4, num=85, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(4, 85, 100)
    monkeypatch.setattr(ngram_join, "FEW", 1)  # keys of two classes count as crowded
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    got = ngram_join.jaccard_components(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(5, 4, 5)


def test_jaccard_of_empty_tables(spark):
    assert ngram_join.jaccard_components(docs(spark, ["x"]).limit(0)).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :] or a == b


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(2)
    long = words(rng, 70)
    lines = [words(rng, n) for n in (1, 2, 8, 9, 15)] + [long]
    texts = list(ODD)
    for _ in range(25):
        part = []
        for _ in range(4):
            w = list(rng.choice(lines))
            change = rng.randrange(4)
            i = rng.randrange(len(w))
            w[i : i + (change != 1)] = [[w[i]], ["ins"], ["sub" + str(rng.randrange(3))], []][change]
            part.append("  ".join(w) if rng.random() < 0.2 else " ".join(w).upper())
        texts.append("\n".join(part))
    flat = [(d, i, re.split(r"[\x09-\x0D\x20]+", x.strip(" \t\r\f\v").lower())) for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n"))]
    gone, seen = set(), []
    for d, i, w in flat:
        if w != [""]:
            if w in seen or any(min(len(w), len(s)) >= 8 and one_edit(w, s) for s in seen):
                gone.add((d, i))
            if w not in seen:
                seen.append(w)
    got = line_dedup.dedup_lines(docs(spark, texts).withColumn("n_lines", F.lit("clash")).withColumn("d", F.lit(1))).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (r["doc_id"], i) not in gone)
        assert r["text"] == want
        assert r["n_exact"] + r["n_near"] == sum(d == r["doc_id"] for d, _ in gone)
    assert line_dedup.dedup_lines(docs(spark, ["x"]).limit(0)).count() == 0


def test_embeddings_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 24))
    v = [c + rng.normal(size=24) * s for c in centre for s in (0, 0, 0.02, 0.1, 0.15, 0.2, 0.25)] + [rng.normal(size=24) for _ in range(20)]
    rows = [(i, [float(np.float32(y)) for y in x], i % 2 if i < 42 else None if i % 7 == 0 else 1) for i, x in enumerate(v)]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 24, 1), (103, [float("nan")] * 24, 1), (104, [None] * 24, 1), (105, [float("inf")] + [0.0] * 23, 1), (106, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: (np.array(x, float), c) for i, x, c in rows if x and c is not None and None not in x and np.isfinite(x).all() and np.any(x)}
    root = {i: i for i, _, _ in rows}
    n = dict.fromkeys(root, 0)
    for i, j in itertools.combinations(good, 2):
        (x, a), (y, b) = good[i], good[j]
        if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            n[i] += 1
            n[j] += 1
            lo, hi = sorted((root[i], root[j]))
            root = {k: lo if r == hi else r for k, r in root.items()}
    want = {i: (n[i], root[i], root[i] == i) for i in root}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df).collect()} == want
    monkeypatch.setattr(embed_dedup, "BLOCK", 2)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df).collect()} == want
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 8))
    assert np.allclose(np.linalg.norm(embed_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embed_dedup.hadamard(embed_dedup.hadamard(x)), x)


def base_by_regex(t):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=pii.order)


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    parts = ["a.b@c.d", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4785380592391139", "4785 3805-9239 1139", "+1 (743) 555-3824", "+12", "é", " ", "-", "0010.1.1.1", "..", "+1.2.3.4.5.6.7.8.9.0", "x%+-@a-b.c-d."]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))
        assert pii.base_spans(t) == base_by_regex(t), t
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(t)  # in linear time
        pii.candidates(t, [], 6)


def test_pii_digest_and_context(spark):
    texts = [f"write to user{i}@mail.example.com today" for i in range(8)] + ["write to agent4711x today", "we saw agent4711x there", *ODD[:5]]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    assert got[0]["n_email"] == 1 and got[0]["base_sha256"] == hashlib.sha256(b"email:9:31").hexdigest() and got[0]["spans"] == "email:9:31"
    assert got[8]["spans"] == "id:9:19" and got[8]["n_email"] == 0  # found by the pattern that the seeds taught
    assert got[9]["spans"] == ""
    assert all(got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() for i in range(10, 15))
    assert pii.digest(pii.find_pii(docs(spark, ["x"]).limit(0))).count() == 0


def test_identifiers_teach_patterns(spark):
    texts = [f"write to user{i}@mail.example.com today" for i in range(20)] + [f"write to agent{i}4711x today" for i in range(10)]
    texts += [f"badge holder agent{i}4711x enters" for i in range(10)] + ["badge holder zeta9988q enters", "some other zeta7788q here"]
    got = {r["doc_id"]: r["n_id"] for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    assert got == {i: int(20 <= i <= 40) for i in range(42)}  # 40 by a pattern that no base kind was seen in
    one = {r["doc_id"]: r["n_id"] for r in pii.digest(pii.find_pii(docs(spark, texts), rounds=1)).collect()}
    assert one == {i: int(20 <= i < 30) for i in range(42)}


def test_licenses(spark):
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "MIT License mit-license", "See the GNU General Public License v3", *ODD, "CC BY-NC 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, texts)).collect()}
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["base_labels"], got[0]["labels"]) == (5, 1, 3, "mit", "mit")
    assert got[1]["base_labels"] == "apache" and got[1]["labels"] == "apache,apache-2.0"
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 2)
    assert got[3]["base_labels"] == "gpl" and "gpl" in got[3]["labels"]
    assert got[11]["labels"] == "" and got[12]["labels"] == "mit"  # a bare name is no signature
    for i, t in enumerate(ODD, 4):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        assert got[i]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) and got[i]["first_word"] is None
    assert len(licenses.rules()) > 200
    assert licenses.license_scan(docs(spark, ["x"]).limit(0)).count() == 0


def test_suppression():
    kept = licenses.detections("licensed under the apache license version 2 0")
    assert [x[3] for x in kept] == ["apache-2.0"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_library(tokenizer):
    rng = random.Random(5)
    parts = ["hello", " world", "  ", "\n", " \n", "\t", "é", "ção", "🙂", "<|endoftext|>", "'s", "123", "!!", " ", "   x", " ", "\r\n", "　"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000))]
    enc = tokens.encoder(tokens.default_vocabulary())
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == e.ids, repr(t)


def test_added_tokens_are_read_as_the_library_does(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    rng = random.Random(13)
    parts = ["hello", " world", "  ", "\n", " ", "é", "<|endoftext|>", "<|endoftext", "|>", "'s", "   x"]
    texts = ["", "hello <|endoftext|> world", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    enc = tokens.encoder(tokens.default_vocabulary(), added=True)
    assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == want
    few = docs(spark, texts[:40])
    assert {r["n_tokens"]: r["n_docs"] for r in tokens.length_histogram(few).collect()} == Counter(map(len, want[:40]))
    packed = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(few, with_ids=True).collect()}
    assert packed == {i: [*x, 2] for i, x in enumerate(want[:40])}


def test_length_histogram_by_brute_force(spark, tokenizer):
    texts = [*ODD[:5], *(" ".join(words(random.Random(i), i % 90)) for i in range(200))]
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    table = {r["context_limit"]: r for r in tokens.context_table(tokens.length_histogram(docs(spark, texts)), block=8).collect()}
    assert set(table) == set(n)
    for limit, r in table.items():
        assert (r["n_docs"], r["docs_within"], r["docs_over"]) == (n.count(limit), sum(x <= limit for x in n), sum(x > limit for x in n))
        assert (r["tokens_truncated"], r["tokens_total"]) == (sum(min(x, limit) for x in n), sum(n))
    at = {r["context_limit"]: r["tokens_truncated"] for r in tokens.totals_at(tokens.length_histogram(docs(spark, texts)), [7, 50]).collect()}
    assert at == {k: sum(min(x, k) for x in n) for k in (7, 50)}
    assert tokens.context_table(tokens.length_histogram(docs(spark, ["x"]).limit(0))).count() == 0


def test_packing_is_a_round_trip(spark, tokenizer):
    rng = random.Random(6)
    texts = [None, "", *(" ".join(words(rng, rng.choice([1, 5, 5, 5, 20, 60, 300]))) for _ in range(300))]
    size = 128
    packed = packing.pack(docs(spark, texts).withColumn("length", F.lit("clash")), size=size, with_ids=True)
    rows = packed.collect()
    at = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= size
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(parts[-1]) <= size
    for i, t in enumerate(texts):
        own = sorted((r["piece"], r["start"], r["ids"]) for r in rows if r["doc_id"] == i)
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(x[2] for x in own), "<u4").tolist() == ids
        assert [x[0] for x in own] == list(range(len(own))) and (len(ids) > size or len(own) == 1)
    total = sum(r["length"] for r in rows)
    assert len(at) <= 1.03 * total / size + 1
    assert packing.sequences(packed).count() == len(at)
    assert packing.pack(docs(spark, ["x"]).limit(0)).count() == 0


def test_best_fit_on_lengths():
    assert packing.best_fit({6: 2, 4: 2}, 10) == [(6, 0, 2, 0, 0), (4, 0, 2, 0, 6)]
    assert packing.best_fit({10: 3}, 10) == [(10, 0, 3, 0, 0)]
    assert packing.best_fit({}, 10) == []


def test_decontamination(spark, monkeypatch):
    rng = random.Random(7)
    items = [words(rng, n) for n in (60, 25, 8, 3, 40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    changed = list(items[0])
    for i in range(4, 60, 9):
        changed[i] = "other"
    clean = [" ".join(words(rng, 200)) for _ in range(20)]
    texts = [*clean, clean[0] + " " + " ".join(changed) + "!", (", ".join(items[1]) + ".").upper(), "so " + " ".join(items[2]) + " it is", " ".join(items[3]), " ".join(items[4][5:25]), " ".join(items[4][:9]), *ODD]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(20, 0), (21, 1), (22, 2), (24, 4)}
    monkeypatch.setattr(decontam, "BITS_EACH", 1)  # a filter that lets nearly everything pass
    assert got == {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {20, 21, 22, 24}
    assert decontam.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def longest_by_brute_force(equal, least):
    return max((e - s for s in range(len(equal)) for e in range(s + least, len(equal) + 1) if 5 * sum(equal[s:e]) >= 4 * (e - s)), default=None)


def test_stretch_by_brute_force():
    rng = random.Random(10)
    assert decontam.stretch(np.array([True] * 12 + [False] + [True] * 3), 0.8, 13) == (0, 16)
    for _ in range(3000):
        equal = np.array([rng.random() < rng.choice([0.5, 0.8, 0.9]) for _ in range(rng.randrange(45))], bool)
        least = rng.choice([6, 12, 13])
        got, want = decontam.stretch(equal, 0.8, least), longest_by_brute_force(equal.tolist(), least)
        assert (got is None) == (want is None)
        if got:
            s, e = got
            assert least <= e - s <= want and 5 * equal[s:e].sum() >= 4 * (e - s)


def hit(seed, equal):
    return any(all(equal[s + i] for i in decontam.open_positions(seed)) for s in range(len(equal) - len(seed) + 1))


def test_seeds_by_enumeration():
    for n in (13, 15, 20, 25):  # the least lengths that allow 2 to 5 replaced words; 26 and more hold a shorter one
        assert decontam.replaced(n, 0.8) == n // 5
        masks = [sum(1 << i for i in decontam.open_positions(seed)) << s for seed in decontam.SEEDS for s in range(n - len(seed) + 1)]
        gaps = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 5)])
        assert np.any([gaps & m == 0 for m in masks], axis=0).all(), n
    for identity, least in ((0.8, 13), (0.7, 9)):
        for n in range(1, least):
            for c in itertools.combinations(range(n), min(decontam.replaced(n, identity), n - 1)):
                equal = [i not in c for i in range(n)]
                assert any(hit(seed, equal) for seed in decontam.whole_seeds(n, identity)), (n, c)
    assert decontam.long_seeds(13, 0.9) == decontam.SEEDS
    for n in range(9, 18):
        for c in itertools.combinations(range(n), decontam.replaced(n, 0.7)):
            assert any(hit(seed, [i not in c for i in range(n)]) for seed in decontam.long_seeds(9, 0.7)), (n, c)


@pytest.mark.parametrize(("least", "identity", "least_item"), [(13, 0.8, 6), (13, 0.9, 3), (8, 0.7, 5), (13, 1.0, 6)])
def test_overlaps_by_brute_force(least, identity, least_item):
    rng = random.Random(11)
    for _ in range(12):
        items = [words(rng, n) for n in (*range(15), 20, 25, 40)] + [["same"] * 14]
        texts = [[], ["same"] * 30]
        for _ in range(120):
            item = rng.choice(items)
            a = rng.randrange(len(item) + 1) if rng.random() < 0.5 else 0
            part = [w if rng.random() < 0.83 else "other" for w in item[a : rng.randrange(a, len(item) + 1) if rng.random() < 0.3 else None]]
            texts.append(words(rng, rng.randrange(6)) + part + words(rng, rng.randrange(6)))
        want = []
        for t in texts:
            want.append(set())
            for k, item in enumerate(items):
                n = min(least, len(item))
                for d in range(-len(item), len(t)):
                    equal = [item[i] == t[i + d] for i in range(max(0, -d), min(len(item), len(t) - d))]
                    runs = (equal[s:e] for s in range(len(equal)) for e in range(s + n, len(equal) + 1))
                    if len(item) >= least_item and any(round(1000 * identity) * len(x) <= 1000 * sum(x) for x in runs):
                        want[-1].add(k)
        coded = lambda w: decontam.word_hashes(" ".join(w))
        index = decontam.Index([coded(x) for x in items], least, identity, least_item)
        got = index.overlaps([coded(t) for t in texts])
        assert [set(x) for x in got] == want
        for t, found in zip(texts, got, strict=True):
            for k, (same, n, at, first) in found.items():
                assert same == sum(x == y for x, y in zip(t[at : at + n], items[k][first : first + n], strict=True)) and n >= min(least, len(items[k]))


def labelled(spark, n=240):
    rng = random.Random(8)
    lang = {"de": "und der die das schön über straße nicht", "en": "the and with thing over where there is", "fr": "être où très cette nous avec était là"}
    rows = []
    for i in range(n):
        k = sorted(lang)[i % 3]
        rows.append((i, " ".join(rng.choice(lang[k].split()) for _ in range(rng.randrange(4, 30))), k if i % 10 else None, f"s{i % 4}"))
    return spark.createDataFrame([*rows, (n, None, "en", None), (n + 1, "123 !!", "en", "s1"), (n + 2, "", None, "s1"), (None, "the thing is where", "en", "s1")], "doc_id long, text string, lang string, source string")


def test_language_on_held_out_rows(spark):
    d = labelled(spark).withColumn("score", F.lit("clash"))
    got = language.identify(d, language.fold() > 0).withColumn("held", language.fold() == 0)
    rows = got.collect()
    true = {0: "de", 1: "en", 2: "fr"}
    held = [r for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert held and sum(true[r["doc_id"] % 3] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None and r["doc_id"] >= 240} == {240: "und", 241: "und", 242: "und"}
    assert language.identify(d.limit(0), language.fold() > 0).count() == 0
    none = language.identify(d.withColumn("lang", F.lit(None).cast("string")), language.fold() > 0)
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_rare_languages_are_sampled(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("the and with thing").alias("text"), F.when(F.col("id") % 1000 == 7, "is").when(F.col("id") == 20_000, "eo").otherwise("en").alias("lang"))
    rows = rows.union(spark.createDataFrame([(50_000, " ", "no"), (50_001, None, "no"), (50_002, "thing", None)], "doc_id long, text string, lang string"))
    got = Counter(r["lang"] for r in language.sampled_words(rows, F.lit(True), 100, 5))
    assert got["eo"] == 1 and 15 <= got["is"] <= 40 and 15 <= got["en"] <= 60 and len(got) == 3
    assert language.sampled_words(rows.limit(0), F.lit(True), 100, 5) == []


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = language.Network.new(3, 4, rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, w = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones(5)

    def loss():
        p = net.log_probabilities(x)
        return -p[np.arange(5), :, y].mean()

    grads = net.gradients(x, y, w)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, e = net.weights[name][at], 1e-3
        net.weights[name][at] = keep + e
        up = loss()
        net.weights[name][at] = keep - e
        down = loss()
        net.weights[name][at] = keep
        assert abs((up - down) / (2 * e) - g[at]) < 2e-3 * max(1, abs(g[at])), name


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words(rng, 40)) + (" scoundrel" if toxic else "")
        rows.append((i, text, f"h{i % 3}", f"p{i % 9}"))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    d = spark.createDataFrame([*rows, (300, None, None, None), (301, "", "h0", None)], "doc_id long, text string, source string, lang string").withColumn("keep", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    unseen = [i for i in range(300) if i % 2]
    assert sum(got[i]["keep"] == (i % 5 != 0 and i % 7 != 0) for i in unseen) >= 0.95 * len(unseen)
    none = quality.classify(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.filter("keep").count() == 302
    assert quality.classify(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_rare_classes_are_sampled(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 20)) + (" scoundrel" if i % 200 == 0 else ""), "h", "p") for i in range(8000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 200 == 0).cast("int").alias("toxic"))
    got = quality.sample(d, labels, 400)
    toxic = [r["weight"] for r in got if r["toxic"]]
    assert toxic == [1.0] * 40 and 300 <= len(got) <= 420 and 0.8 * 8000 <= sum(r["weight"] for r in got) <= 1.2 * 8000
    dropped = {r["doc_id"] for r in quality.classify(d, labels, sample_docs=400).filter("not keep").collect()}
    assert len(dropped & set(range(0, 8000, 200))) >= 36 and len(dropped) <= 50
    assert quality.shares({1: 10, 2: 1000, 3: 50}, 210) == {1: 1.0, 3: 1.0, 2: 0.15}


def test_sparse_groups_shrink(spark):
    even = spark.createDataFrame([(10.0, 5.0)] * 20, "n double, mass double")
    apart = spark.createDataFrame([(10.0, 0.5), (10.0, 9.5)] * 10, "n double, mass double")
    assert quality.strength(even) > 100 * quality.strength(apart)


def test_strength_of_known_groups(spark):
    rng = np.random.default_rng(14)
    for k_host, k_path in ((3.0, 30.0), (40.0, 5.0)):
        rows = []
        for _ in range(400):
            host = rng.beta(0.4 * k_host, 0.6 * k_host)
            paths = []
            for _ in range(6):
                n = int(rng.integers(1, 60))
                path = rng.beta(max(1e-3, host * k_path), max(1e-3, (1 - host) * k_path))
                x = (rng.random(n) < path).astype(float)
                paths.append((float(n), float(x.sum()), float((x * x).sum())))
            pn, pmass = sum(p[0] for p in paths), sum(p[1] for p in paths)
            rows += [(*p, pn, pmass) for p in paths]
        got = quality.strength(spark.createDataFrame(rows, "n double, mass double, sq double, pn double, pmass double"))
        assert 0.7 * k_path <= got <= 1.4 * k_path  # the spread of paths within hosts, whatever that of hosts is
    soft = spark.createDataFrame([(100.0, 50.0 + d, (50.0 + d) ** 2 / 100 + 0.01) for d in (-5.0, 5.0) * 20], "n double, mass double, sq double")
    hard = soft.drop("sq")
    assert quality.strength(soft) < 1.001 < quality.strength(hard)  # documents of one value each say more than chance would


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(15)
    parts = ["MIT", "License", "license", "Apache", "GENERAL", "public", "é", "mit-license", "x", "general public", "\x7f", "'", "licensé", "  ", "\n", "mit license."]
    texts = [*ODD, *("".join(rng.choice(parts) + rng.choice([" ", "-", "/", ""]) for _ in range(rng.randrange(12))) for _ in range(600))]
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for t, r in zip(texts, licenses.license_scan(docs(spark, texts)).orderBy("doc_id").collect(), strict=True):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        assert (r["n_words"], r["n_base"]) == (len(w), len(at)), t
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None)), t
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_rules_hold_their_keyword():
    known = licenses.rules()
    assert len(known) > 250 and len({r.keyword for r in known}) > 0.95 * len(known)
    for rule, (_, keyword, strength, x) in zip(known, licenses.RULES, strict=True):
        assert keyword in x.replace("licen[cs]e", "license") and 0 < strength <= 101, x
    assert [x[3] for x in licenses.detections("spdx license identifier gpl 2 0 or later")] == ["gpl-2.0"]
    assert [x[3] for x in licenses.detections("the gnu lesser general public license version 2 1 and the isc license")] == ["lgpl-2.1", "isc"]
