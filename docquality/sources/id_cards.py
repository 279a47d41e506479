"""Invented identity documents, made from customers: their true lines, and the same lines as an engine might read them.

Every value follows from the customer's number, so that any engine makes the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import TYPES

FIRST = ("Ana", "João", "Márcia", "José", "Antônia", "Luís", "Inês")
LAST = ("da Silva", "Conceição", "Gonçalves", "Araújo", "Pereira")
#: A line's reading is one of these many; the first five are damaged.
READINGS = 23


def _pick(names: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))).cast("int"))


def _whole(c: Column) -> Column:
    return F.floor(c)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the values of a document."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    first_order = read("orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("issued"))
    c = read("customer", "c_custkey", "c_nationkey").join(F.broadcast(read("nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # a table of 25 rows at every scale
    c = c.join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey").cast("long")
    issued = F.coalesce("issued", F.to_date(F.lit("1990-01-01")))
    day = lambda d: F.date_format(d, "dd/MM/yyyy")
    nine = F.lpad(((k * 102947 + 123456789) % 1000000000).cast("string"), 9, "0")
    c = c.select(k.alias("doc_id"), _pick(TYPES, k).alias("document_type"), F.col("n_name").alias("city"), nine.alias("nine"), issued.alias("issued"), k.alias("k"))
    digit = lambda i: F.substring("nine", i + 1, 1).cast("int")
    one = sum((digit(i) * (10 - i) for i in range(1, 9)), digit(0) * 10) * 10 % 11 % 10
    two = (sum((digit(i) * (11 - i) for i in range(1, 9)), digit(0) * 11) + 2 * F.col("one")) * 10 % 11 % 10
    c = c.withColumn("one", one).withColumn("two", two)
    last = F.when(F.col("k") % 7 == 0, (F.col("two") + 1) % 10).otherwise(F.col("two"))
    s = lambda i: F.substring("nine", i, 3)
    return c.select(
        "doc_id", "document_type", "city",
        F.concat(s(1), F.lit("."), s(4), F.lit("."), s(7), F.lit("-"), F.col("one").cast("string"), last.cast("string")).alias("cpf"),
        F.concat_ws(" ", _pick(FIRST, F.col("k")), _pick(LAST, _whole(F.col("k") / 7))).alias("name"),
        F.concat_ws(" ", F.lit("Pedro"), _pick(LAST, _whole(F.col("k") / 3))).alias("father"),
        F.concat_ws(" ", _pick(FIRST, F.col("k") + 2), _pick(LAST, _whole(F.col("k") / 5))).alias("mother"),
        day(F.date_add(F.to_date(F.lit("1950-01-01")), (F.col("k") * 37 % 18000).cast("int"))).alias("born"),
        day(F.col("issued")).alias("issued"), day(F.date_add("issued", 3650)).alias("valid"),
        F.lpad((F.col("k") * 7907 % 100000000).cast("string"), 9, "0").alias("rg"), F.lpad((F.col("k") * 104729 % 10000000000).cast("string"), 11, "0").alias("number"),
    )


#: The lines of each type; a name in braces is a column of cards().
LAYOUT = {
    "CNH_Frente": ("REPÚBLICA FEDERATIVA DO BRASIL", "CARTEIRA NACIONAL DE HABILITAÇÃO", "NOME", "{name}", "DOC IDENTIDADE", "{rg}", "CPF", "{cpf}", "DATA NASCIMENTO", "{born}", "FILIAÇÃO", "{father}", "{mother}", "CAT HAB", "AB", "Nº REGISTRO", "{number}", "VALIDADE", "{valid}", "1ª HABILITAÇÃO", "{issued}"),
    "CNH_Verso": ("OBSERVAÇÕES", "EXERCE ATIVIDADE", "LOCAL", "{city}", "DATA EMISSÃO", "{issued}", "{number}", "ASSINATURA DO EMISSOR"),
    "CPF_Frente": ("MINISTÉRIO DA FAZENDA", "CADASTRO DE PESSOAS FÍSICAS", "NÚMERO DE INSCRIÇÃO", "{cpf}", "NOME", "{name}", "NASCIMENTO", "{born}"),
    "CPF_Verso": ("EMISSÃO: {issued}", "WWW.RECEITA.COM.BR", "CORREIOS"),
    "RG_Frente": ("REPÚBLICA FEDERATIVA DO BRASIL", "SECRETARIA DE SEGURANÇA PÚBLICA", "{city}", "NÃO DOADOR", "CARTEIRA DE IDENTIDADE"),
    "RG_Verso": ("REGISTRO GERAL", "{rg}", "DATA EXPEDIÇÃO", "{issued}", "NOME {name}", "FILIAÇÃO", "{father}", "E {mother}", "NATURALIDADE", "{city}", "DOC ORIGEM", "CERT 123 | LIV A", "CPF", "{cpf}", "DATA DE NASCIMENTO", "{born}"),
}


def _line(template: str) -> Column:
    parts = [F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in template.replace("{", "\0{").replace("}", "}\0").split("\0") if p]
    return F.concat(*parts)


def true_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, document_type, line_idx, text, confidence)."""
    layout = F.when(F.lit(False), F.array().cast("array<string>"))
    for t, lines in LAYOUT.items():
        layout = layout.when(F.col("document_type") == t, F.array(*map(_line, lines)))
    return documents.select("doc_id", "document_type", F.posexplode(layout).alias("line_idx", "text")).withColumn("confidence", F.lit(100.0))


def read_lines(lines: DataFrame) -> DataFrame:
    """true_lines() as read with errors, with the confidence of the reading."""
    k, i, t = F.col("doc_id"), F.col("line_idx"), F.col("text")
    n = (k * 31 + i * 17) % READINGS
    text = F.when(n == 0, "").when(n == 1, F.translate(t, "01", "OI")).when(n == 2, F.lower(t)).when(n == 3, F.concat(t, F.lit(" |"))).when(n == 4, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return lines.withColumn("text", text).withColumn("confidence", (40 + (k * 31 + i * 17) % 60).cast("double"))
