from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from assetweave.operators import search
from assetweave.plans import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(engine.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = engine.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    result = c.sql(engine.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_top_k_is_stable(spark):
    rows = [("b", "image", [1.0, 0.0]), ("a", "image", [1.0, 0.0]), ("c", "image", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "path string, kind string, vector array<float>")
    from pyspark.sql import functions as F

    from assetweave.functions import vectors

    scored = df.withColumn("score", vectors.dot(F.col("vector"), vectors.literal([1.0, 0.0])))
    assert [r["path"] for r in search.ranked(search.top(scored, 2)).orderBy("rank").collect()] == ["a", "b"]


def test_vectors_of_another_length(spark):
    from assetweave.errors import AssetError

    assets = spark.createDataFrame([(p, "image", p, "indexed", [p]) for p in "abc"], "path string, kind string, content_hash string, state string, path_tokens array<string>")
    made = lambda rows: spark.createDataFrame([(h, "s", len(v), v) for h, v in rows], "content_hash string, space_id string, dims int, vector array<float>")
    ask = lambda e, v: [r["path"] for r in search.search_by_vector(assets, e, v, kind="image", space_id="s").collect()]
    assert ask(made([("a", [1.0, 0.0]), ("b", [0.0, 1.0])]), [1.0, 0.0]) == ["a", "b"]
    mixed = made([("a", [1.0, 0.0]), ("b", [1.0]), ("c", [0.5, 0.5])])
    assert ask(mixed, [1.0, 0.0]) == ["a", "c"]
    with pytest.raises(AssetError) as error:
        ask(mixed, [1.0])
    assert error.value.code == "INDEX_INCOMPATIBLE"
    assert ask(made([("z", [1.0])]), [1.0, 0.0]) == []


def test_fused_search_with_vectors_of_another_length(spark):
    from assetweave.errors import AssetError

    assets = spark.createDataFrame([(p, "image", p, "indexed", [p]) for p in "abc"], "path string, kind string, content_hash string, state string, path_tokens array<string>")
    rows = [("a", [1.0, 0.0]), ("b", [1.0]), ("c", [0.5, 0.5])]
    mixed = spark.createDataFrame([(h, "s", len(v), v) for h, v in rows], "content_hash string, space_id string, dims int, vector array<float>")
    ask = lambda v: search.search_across_kinds(assets, mixed, "x", [("image", "s", v)])
    assert [r["path"] for r in ask([1.0, 0.0]).orderBy("rank").collect()] == ["a", "c"]
    assert "Window" not in ask([1.0, 0.0]).drop("rank")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(AssetError) as error:
        ask([1.0])
    assert error.value.code == "INDEX_INCOMPATIBLE"


def test_queries_in_blocks(spark, monkeypatch):
    """More queries than one block give the same hits."""
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.filter("id % 3 = 0").selectExpr("id AS query_id", "vector AS query_vector")
    told = lambda: sorted(map(tuple, search.batch_top_k(q, v, 3).collect()))
    want = told()
    monkeypatch.setattr(search, "QUERIES", 4)
    assert told() == want and len(want) == 42


def test_entry_has_the_engine():
    assert set(engine.queries()) <= set(entry.queries())
    assert set(engine.oracle_sql()) <= set(entry.oracle_sql())
