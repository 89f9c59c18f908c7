from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assetweave.errors import AssetError
from assetweave.functions import numbers, paths, vectors
from assetweave.functions.models import resolve
from assetweave.operators import ranking

PATHS = ["a/Big Sword.PNG", "icons/goldCoin_02.tar.gz", ".hidden", "plain", "x/.env", "dir.d/file", "Ünï/Äpfel.webp", ""]


def test_tokens_and_extension_agree_with_the_driver(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", paths.tokens(F.col("p")).alias("t"), paths.extension(F.col("p")).alias("e")).collect()
    for r in rows:
        assert list(r["t"]) == paths.tokens_of(r["p"])
        assert r["e"] == paths.extension_of(r["p"])
    assert paths.tokens_of("icons/goldCoin_02.png") == ["icons", "gold", "coin", "02"]
    assert [paths.extension_of(p) for p in PATHS[:4]] == ["png", "gz", "", ""]


def test_query_words():
    assert ranking.query_tokens("a picture of the Gold coin, gold") == ["gold", "coin"]
    # Text after a last dot is lost, and 3D falls into 3 and d.
    assert ranking.query_tokens("a sword. dark") == ["sword"]
    assert ranking.intent_kind("3D chair") is None
    assert ranking.intent_kind("3d chair") == "model3d"
    assert ranking.intent_kind("sound of an icon") is None
    assert ranking.intent_kind("sound of coins") == "audio"


def test_lexical_score(spark):
    tokens = ranking.query_tokens("golden swords tree")
    df = spark.createDataFrame([("weapons/golden_sword.png",)], "path string")
    got = df.select(ranking.lexical(tokens, paths.tokens(F.col("path"))).alias("x"), ranking.lexical([], paths.tokens(F.col("path"))).alias("none")).first()
    assert got["x"] == pytest.approx(2 / 3)
    assert got["none"] == 0


def test_z_scores(spark):
    def z(values):
        df = spark.createDataFrame([(i, float(v), "k") for i, v in enumerate(values)], "i int, x float, kind string")
        return [r["z"] for r in ranking.with_z(df, "x", ["kind"]).orderBy("i").collect()]

    assert z([0.3]) == [0]
    assert z([0.2, 0.2, 0.2]) == [0, 0, 0]
    assert z([0.1, 0.3])[1] == pytest.approx(2 / 12, rel=1e-5)
    assert z([i / 1000 for i in range(1000)])[-1] > 1.6


def test_paths():
    assert paths.normalize_input(".\\a\\..\\b//c/.") == "b/c"
    assert paths.normalize_input("../x") is None
    assert paths.normalize_input("/x") is None
    assert paths.normalize_input("C:\\x") is None
    assert paths.normalize_input(".") == ""
    assert paths.to_logical("/p", "/p/a/b") == "a/b"
    assert paths.to_logical("/p", "/q") is None
    assert paths.to_logical("C:\\p", "C:\\p\\a\\b", windows=True) == "a/b"
    assert paths.to_logical("C:\\p", "D:\\x", windows=True) is None
    assert paths.to_native("/p", "a/b") == "/p/a/b"
    assert paths.is_within_path("a", "a/b") and not paths.is_within_path("a", "ab") and paths.is_within_path("", "x")
    assert paths.fold_roots(["a/b", "c", "a", "c"]) == ["c", "a"]
    assert paths.match_key_of("E\u0301.PNG") == "é.png"


def test_same_path_and_within(spark):
    df = spark.createDataFrame([("E\u0301a.png",), ("sub/x.png",), ("subway.png",), (None,)], "p string")
    assert df.filter(paths.same_path(F.col("p"), "éA.PNG")).count() == 1
    assert [r["p"] for r in df.filter(paths.is_within("sub", F.col("p"))).collect()] == ["sub/x.png"]


def test_numbers(spark):
    row = spark.range(1).select(
        numbers.round_up(F.lit(-0.00005)).alias("a"),
        numbers.iso_time(F.lit(1500)).alias("t"),
        numbers.human_size(F.lit(2048)).alias("s"),
        numbers.decibels(F.lit(0.5)).alias("d"),
        numbers.decibels(F.lit(0.0)).alias("silent"),
        numbers.hex_color(F.lit(255), F.lit(0), F.lit(16)).alias("c"),
        paths.channel_of_space(F.lit("clap:x:q8:r1")).alias("ch"),
    ).first()
    assert row["a"] == 0 and numbers.round_up_of(-0.00005) == 0
    assert row["t"] == "1970-01-01T00:00:01.500Z"
    assert row["s"] == "2.0 KB" and row["d"] == -6.0 and row["silent"] is None
    assert row["c"] == "#ff0010" and row["ch"] == "audio"
    with pytest.raises(AssetError):
        numbers.checked_int("0", 1, 10, "limit")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "o int, vector array<float>")
    assert [list(r["v"]) for r in df.select(vectors.l2_normalize(F.col("vector")).alias("v")).collect()][0] == pytest.approx([0.6, 0.8])
    means = {r["o"]: list(r["vector"]) for r in vectors.mean_vector(df, ["o"]).collect()}
    assert means[1] == pytest.approx([3 / 34**0.5, 5 / 34**0.5], rel=1e-6) and means[2] == [0, 0]
    assert vectors.decode(vectors.encode([0.5, -2])) == [0.5, -2]
    q = [0.25, -1.5]
    both = df.select(vectors.dot(F.col("vector"), vectors.literal(q)).alias("a"), vectors.dot_batch(q)("vector").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_models():
    assert resolve("visual", "test-hash").space_id == "test-hash:none:fp32:r1"
    custom = resolve("visual", "clip:owner/name", "fp16")
    assert (custom.family, custom.space_id, custom.dimensions) == ("clip", "clip:owner/name:fp16:r1", None)
    with pytest.raises(AssetError):
        resolve("audio", "siglip:owner/name")
