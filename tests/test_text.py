"""Scalars against hand-made cases."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquality.functions import text as X
from docquality.operators import classify


def values(spark, rows, use, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("use", "cases"),
    [
        (X.format_cpf, {"13133431706": "131.334.317-06", " 123 ": "123", None: None}),
        (X.cpf_checksum_valid, {"131.334.317-06": True, "505.960.271-09": True, "111.111.111-11": False, "123.456.789-00": False, "12": False, "": False, None: None}),
        (X.parse_date, {"5-6-30": datetime.date(2030, 6, 5), "05/06/31": datetime.date(1931, 6, 5), "31/02/2020": None, "O1/O2/2OOO": datetime.date(2000, 2, 1), "x": None, None: None}),
        (X.standard_date, {"em 5-6-30": "05/06/2030", "31/02/2020": "31/02/2020", "nada": "nada"}),
        (X.clean_value, {" :- A | B ,": "A B", "|": ""}),
        (X.normalize_text, {"Nº  REGISTRO": "NO REGISTRO", "1ª HABILITAÇÃO": "1A HABILITACAO", "a b": "A B", "": ""}),
        (X.strip_accents_full, {"ﬁm": "fim", "½": "1⁄2", "ção": "cao"}),
        (X.numeric_noise, {"OoIlSB": "001158"}),
        (X.compact, {"São Paulo-SP 1": "SAOPAULOSP1"}),
        (X.confidence, {"x": 0.0, "-1": 0.0, "250": 100.0, "41.5": 41.5, None: 0.0}),
        (X.first_cpf, {"cpf l31.334.317-O6 x": "131.334.317-06", "nada": None}),
    ],
)
def test_scalars(spark, use, cases):
    assert values(spark, list(cases), use) == list(cases.values())


def test_distance_score(spark):
    assert values(spark, [None, 0, 1, -2, 5, 9], X.distance_score, "int") == [None, 1.0, 1.0, 0.75, 0.0, 0.0]


def test_half_even(spark):
    assert values(spark, [0.03125, 0.125], lambda c: X.half_even(c, 4), "double") == [0.0312, 0.125]


def test_similarity(spark):
    df = spark.createDataFrame([("", ""), ("ABC", ""), ("KITTEN", "SITTING"), ("A", "A")], "a string, b string")
    assert [r[0] for r in df.select(X.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 - 3 / 7, 1.0]


def test_seed_of_a_variant(spark):
    assert spark.range(1).select(X.fnv1a(F.lit(42), F.lit("CNH_Frente"), F.lit("00003658"), F.lit(1))).first()[0] == 3021627498


def test_plausible_dates(spark):
    df = spark.createDataFrame([("01/01/2030", "data_nascimento"), ("01/01/2030", "validade"), ("01/01/2050", "validade"), ("01/01/1899", "validade"), (None, "validade")], "x string, f string")
    assert [r[0] for r in df.select(X.plausible_date(F.col("x"), F.col("f"), F.lit("2024-01-01").cast("date"))).collect()] == [False, True, False, False, False]


def test_sql_functions(spark):
    X.register(spark)
    r = spark.sql("select cpf_valid('131.334.317-06') a, cpf_valid('111.111.111-11') b, norm_text('Nº  é') c, norm_cmp('a-é 1') d, similarity('AB', 'AC') e").first()
    assert tuple(r) == (True, False, "NO E", "AE1", 0.5)


def luhn_like(n: str) -> str:
    """Check digits of nine digits, by the definition."""
    d = [int(c) for c in n]
    for _ in range(2):
        d.append(sum(x * w for x, w in zip(d, range(len(d) + 1, 1, -1), strict=True)) * 10 % 11 % 10)
    return "".join(map(str, d))


@settings(max_examples=3, deadline=None, derandomize=True)
@given(st.lists(st.from_regex(r"[0-9]{9}", fullmatch=True), min_size=20, max_size=40))
def test_checksums_by_definition(spark, numbers):
    good = [luhn_like(n) for n in numbers]
    bad = [g[:-1] + str((int(g[-1]) + 1) % 10) for g in good]
    assert values(spark, good, X.cpf_checksum_valid) == [len(set(g)) > 1 for g in good]
    assert not any(values(spark, bad, X.cpf_checksum_valid))


def test_softmax_and_rejection(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, 0.0],)], "logits array<double>")
    out = classify.reject(classify.predict(df, ["a", "b", "c"]), 0.4).select("predicted", "final", F.round("max_probability", 4)).collect()
    assert [tuple(r) for r in out] == [("b", "b", 0.4683), ("a", "outros", 0.3333)]


def test_threshold_is_linear_between_neighbours(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "max_probability double")
    assert classify.rejection_threshold(df).first()[0] == pytest.approx(1.1)


def test_best_epoch(spark):
    h = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.45), (4, 0.46), (5, 0.1)], "epoch int, loss double")
    assert tuple(classify.best_epoch(h, patience=2).first()) == (2, 0.4, 4)


def test_folds_are_the_full_decomposition(spark):
    import unicodedata

    fold = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    every = [chr(c) for c in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x30000)] if fold(chr(c)) != chr(c)]
    rows = ["".join(every[i : i + 60]) for i in range(0, len(every), 60)] + ["№ 3 ½ … ™", "한국어 text", "ção ﬁm 𝐀𝟙", "", None, "ascii only"]
    assert values(spark, rows, X.strip_accents) == [None if t is None else fold(t) for t in rows]
    assert values(spark, ["№ 3 ½ … ™"], X.normalize_text) == ["NO 3 1⁄2 ... TM"]


def test_white_space_of_any_kind(spark):
    rows = [" \t x  ", " ", "\t", "\x1f", "", "a   b"]
    assert values(spark, rows, X.strip) == [t.strip() for t in rows]
    assert values(spark, rows, X.not_blank) == [bool(t.strip()) for t in rows]
    assert values(spark, rows, X.squeeze) == ["".join(" " if k else "".join(g) for k, g in __import__("itertools").groupby(t, str.isspace)) for t in rows]
