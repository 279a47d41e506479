"""Text, identifier and date expressions. Every function takes and returns Columns, so all of it stays in the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers and dates, and the characters that OCR takes for digits.
CPF = r"(?U)\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"
DATE = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
RG = r"(?U)\b\d{1,2}\.?\d{3}\.?\d{3}-?[\dXx]?\b"
LONG_DIGITS = r"(?U)\b\d{8,12}\b"
SITE = r"(?U)\b(?:WWW\.)?[A-Z0-9.-]+\.(?:COM|BR)(?:\.[A-Z]{2})?\b"
NOISE = ("OoIlSB", "001158")
LABEL_WORDS = ("NOME", "CPF", "NASCIMENTO", "FILIACAO", "VALIDADE", "REGISTRO", "EXPEDICAO", "NATURALIDADE", "DOC", "ORGAO", "ASSINATURA", "TERRITORIO", "MINISTERIO", "SECRETARIA", "REPUBLICA", "CARTEIRA")

#: Years up to this belong to the 2000s when written with two digits.
PIVOT = 30


_ASCII_ONLY = r"^[\x00-\x7F]*+$"
#: Compatibility decomposition in the JVM: class and method of the library that Spark's collations come with.
DECOMPOSE = ("com.ibm.icu.text.Normalizer", "decompose")


@functools.cache
def _combining() -> str:
    """A pattern of all combining marks."""
    runs: list[list[int]] = []
    for p in (p for p in range(0x300, 0x20000) if unicodedata.combining(chr(p))):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in runs) + "]+"


@functools.cache
def _latin() -> tuple[str, str, str]:
    """A pattern of texts in Latin letters of which each folds to one character or none, and their folds for translate()."""
    fold = {chr(p): "".join(x for x in unicodedata.normalize("NFKD", chr(p)) if not unicodedata.combining(x)) for p in range(0x80, 0x180)}
    one, gone = {c: k for c, k in fold.items() if len(k) == 1 and k != c}, [c for c, k in fold.items() if not k]
    several = "".join(c for c, k in fold.items() if len(k) > 1)
    return rf"^[\x00-\x{{17F}}&&[^{several}]]*+$", "".join([*one, *gone]), "".join(one.values())


def strip_accents(c: Column) -> Column:
    """The compatibility decomposition without combining marks: accents, ligatures, fractions, signs and syllables."""
    pattern, *folds = _latin()
    full = F.regexp_replace(F.java_method(F.lit(DECOMPOSE[0]), F.lit(DECOMPOSE[1]), c, F.lit(True)), _combining(), "")
    return F.when(c.isNull() | c.rlike(_ASCII_ONLY), c).when(c.rlike(pattern), F.translate(c, *folds)).otherwise(full)


strip_accents_full = strip_accents


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space, with the separators of files, groups, records and units.
SPACE = r"[\s\x1C-\x1F]"


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def strip(c: Column) -> Column:
    """Without white space at either end, of whatever kind."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}++|{SPACE}++$", "")


def not_blank(c: Column) -> Column:
    return c.rlike(r"(?U)[^\s\x1C-\x1F]")


def normalize_text(c: Column) -> Column:
    """Accents folded, white space squeezed, upper case."""
    return F.trim(F.upper(squeeze(strip_accents(c))))


def numeric_noise(c: Column) -> Column:
    """Letters that stand for digits, as digits."""
    return F.translate(c, *NOISE)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def compact(c: Column) -> Column:
    """For comparison: normalised, and A-Z and 0-9 only."""
    return F.regexp_replace(normalize_text(c), "[^A-Z0-9]", "")


def clean_value(c: Column) -> Column:
    """Without bars, extra white space, and marks at either end."""
    return F.btrim(squeeze(F.translate(c, "|", " ")), F.lit(" :;,-\t"))


def format_cpf(c: Column) -> Column:
    dotted = F.regexp_replace(only_digits(c), r"^(.{3})(.{3})(.{3})(.{2})$", "$1.$2.$3-$4")
    return let(dotted, lambda d: F.when(F.length(d) == 14, d).otherwise(F.btrim(c, F.lit(" \t\n\r\f"))))


def cpf_checksum_valid(c: Column) -> Column:
    """Eleven digits, not all equal, whose last two are the check digits of the others."""

    def checked(d: Column) -> Column:
        digit = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.substring(d, i, F.lit(1)).try_cast("int"))
        total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.struct(F.lit(0).alias("s"), F.lit(n + 1).alias("w")), lambda x, v: F.struct((x["s"] + x["w"] * v).alias("s"), (x["w"] - 1).alias("w")))["s"] * 10 % 11 % 10
        ok = let(digit, lambda a: (total(a, 9) == a[9]) & (total(a, 10) == a[10]))
        return F.when(F.length(d) == 11, F.coalesce(ok, F.lit(False)) & ~d.rlike(r"^(.)\1{10}$")).when(d.isNotNull(), F.lit(False))

    return let(only_digits(c), checked)


def first_match(c: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def first_cpf(c: Column) -> Column:
    return format_cpf(first_match(numeric_noise(c), CPF))


def first_date(c: Column) -> Column:
    return first_match(numeric_noise(c), DATE)


def _with_date(c: Column, use) -> Column:
    """use(day, month, year) of the first date as numbers, with the century added; they are null without a date."""

    def numbers(parts: Column) -> Column:
        n = F.transform(parts, lambda p: p.try_cast("int"))
        return let(n, lambda a: use(F.get(a, F.lit(0)), F.get(a, F.lit(1)), let(F.get(a, F.lit(2)), lambda y: F.when(y <= PIVOT, 2000 + y).when(y < 100, 1900 + y).otherwise(y))))

    return let(F.split(first_match(numeric_noise(c), DATE), "[/-]"), numbers)


def parse_date(c: Column) -> Column:
    """The first day/month/year in a text as a date, or null."""
    return _with_date(c, lambda d, m, y: F.try_to_date(F.when(d.isNotNull(), F.format_string("%04d-%02d-%02d", y, m, d)), "yyyy-MM-dd"))


def standard_date(c: Column) -> Column:
    """The first date as dd/mm/yyyy, whether it exists or not; else the text."""
    return F.coalesce(_with_date(c, lambda d, m, y: F.when(d.isNotNull(), F.format_string("%02d/%02d/%04d", d, m, y))), c)


def plausible_date(c: Column, field_name: Column, as_of: Column) -> Column:
    """A date from 1900 to 20 years after as_of; a date of birth not after as_of."""
    ok = let(parse_date(c), lambda d: F.year(d).between(1900, F.year(as_of) + 20) & ~(field_name.contains("nascimento") & (d > as_of)))
    return F.coalesce(ok, F.lit(False))


def is_label_line(norm: Column) -> Column:
    return norm.rlike("|".join(LABEL_WORDS)) & (F.size(F.split(F.trim(norm), " ")) <= 5)


def distance_score(d: Column) -> Column:
    """1 at the label or next to it, less by a quarter for each further line, 0 from five lines on."""
    return F.when(d.isNull(), F.lit(None).cast("double")).when(d == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.abs(d) - 1) / 4.0))


def count_matches(c: Column, pattern: str) -> Column:
    """How many different matches there are, in their compact form."""
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), compact)
    return F.size(F.array_distinct(F.filter(found, lambda x: x != "")))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b), F.lit(0))
    return F.when(n == 0, 1.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / n))


def value_text(value: Column, values: Column) -> Column:
    """A field's value or list of values as text; empty for null."""
    return F.coalesce(F.array_join(values, " | "), value, F.lit(""))


def is_cpf_field(name: Column) -> Column:
    return name.isin("cpf", "numero_cpf")


def is_date_field(name: Column) -> Column:
    return name.contains("data") | name.isin("validade", "primeira_habilitacao")


def comparable(name: Column, text: Column) -> Column:
    """A value of field `name` in the form in which values are compared."""
    x = F.trim(squeeze(text))
    digits = only_digits(x)
    cpf = F.when(F.length(digits) == 11, digits).otherwise(x)
    return compact(F.when(is_cpf_field(name), cpf).when(is_date_field(name), standard_date(x)).otherwise(x))


def confidence(raw: Column) -> Column:
    """A confidence between 0 and 100; 0 for what is no number."""
    return F.least(F.greatest(F.coalesce(raw.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def share_known(flag: Column) -> Column:
    """Share of true among known values."""
    return half_even(F.avg(flag.cast("int")), 4)


def share_all(flag: Column) -> Column:
    """Share of true among all rows; unknown counts as false."""
    return half_even(F.avg(F.coalesce(flag, F.lit(False)).cast("int")), 4)


def mean4(c: Column) -> Column:
    return half_even(F.avg(c), 4)


def fnv1a(*parts: Column) -> Column:
    """32-bit FNV-1a over the code points of parts joined by colons."""
    points = F.transform(F.split(F.concat_ws(":", *[p.cast("string") for p in parts]), ""), F.ascii)
    return F.aggregate(F.filter(points, lambda x: x > 0), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def register(spark) -> None:
    """The scalar functions that SQL users need, as temporary SQL functions: no Python runs in them."""
    marks = _combining().replace("\\", "\\\\")
    fold = f"case when s is null or s rlike '^[\\\\x00-\\\\x7F]*+$' then s else regexp_replace(java_method('{DECOMPOSE[0]}', '{DECOMPOSE[1]}', s, true), '{marks}', '') end"
    norm = f"trim(upper(regexp_replace({fold}, '(?U)\\\\s+', ' ')))"
    digit = lambda i: f"try_cast(substring(regexp_replace(s, '(?U)\\\\D', ''), {i + 1}, 1) as int)"
    check = lambda n: "(" + " + ".join(f"{digit(i)} * {n + 1 - i}" for i in range(n)) + f") * 10 % 11 % 10 = {digit(n)}"
    body = {
        "norm_text(s STRING) RETURNS STRING": norm,
        "norm_cmp(s STRING) RETURNS STRING": f"regexp_replace({norm}, '[^A-Z0-9]', '')",
        "cpf_valid(s STRING) RETURNS BOOLEAN": f"length(regexp_replace(s, '(?U)\\\\D', '')) = 11 and not regexp_replace(s, '(?U)\\\\D', '') rlike '^(.)\\\\1{{10}}$' and {check(9)} and {check(10)}",
        "similarity(a STRING, b STRING) RETURNS DOUBLE": "case when greatest(length(a), length(b)) = 0 then 1D else greatest(0D, 1 - levenshtein(a, b) / greatest(length(a), length(b))) end",
    }
    for head, expr in body.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {expr}")
