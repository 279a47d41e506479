"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docquality.operators import augment
from docquality.plans import extras, oracle, queries
from docquality.sources import annotations

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


QUERIES, SQL = queries.queries() | extras.QUERIES, oracle.oracle_sql() | extras.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def against_sql(spark, tmp_path, name, **tables):
    """The rows of a query over invented tables, which have to be those of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in cursor.fetchall())
    return got


def test_split_of_groups_that_share_a_name(spark, tmp_path):
    parts = [(k, f"Brand#{b}") for k, b in [*((k, 1 + k % 25) for k in range(1, 130)), *((10 + k, 1) for k in range(10)), *((k, 11) for k in range(10)), *((110 + k, 2) for k in range(10)), *((10 + k, 21) for k in range(10))]]
    parts = [p for p in parts if p[0] not in (1, 98)] + [(1, "Brand#3"), (98, "Brand#4"), (500, None), (501, None)]
    got = against_sql(spark, tmp_path, "split_with_a_rare_class", part=(parts, "p_partkey int, p_brand string"))
    assert len(got) > len(parts) > len({repr(g) for g in got})


def test_sizes_of_very_wide_images(spark, tmp_path):
    """The longer side is 1,200 exactly, also where 1,200 / width times the width is not."""
    against_sql(spark, tmp_path, "image_sizes", customer=([(k, "n", "s") for k in (*range(1, 3001), 1591 + 3_000_000, -5, None)], "c_custkey int, c_name string, c_mktsegment string"))


def test_boxes_are_parsed_once(spark, tmp_path):
    """Not once for every use of a side, and one row for each box, also of files that share a path."""
    customers = [(k, f"Customer#{k}", "AUTO") for k in (1, 2, 2, 3, 977)]
    against_sql(spark, tmp_path, "bbox_convert", customer=(customers, "c_custkey bigint, c_name string, c_mktsegment string"))
    df = queries.bbox_convert(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") < 30 and "Join" not in plan


def test_filtered_boxes_are_parsed_once(spark):
    lines = spark.createDataFrame([("a", "10,20,30,40,x"), ("b", "10,20,1,1,y"), ("c", "[1, 90], [2, 80], -1, -1, z")], "path string, line string")
    at = [F.lit(float(v)) for v in (0, 1, 0, 0, 1000, 800)]
    moved = augment.affine(annotations.parse_boxes(lines, "path"), *at)
    assert sorted((r.path, round(r.x), round(r.width)) for r in moved.collect()) == [("a", 10, 30), ("c", 1, 89)]
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("try_cast") < 30
    stay = augment.affine(annotations.parse_boxes(lines, "path"), *at, stay=True)
    assert {r.path: r.x for r in stay.collect()}["b"] is None and stay.columns == moved.columns
