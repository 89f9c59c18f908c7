from __future__ import annotations

import json
import os
import socket

import pytest

from assetweave.errors import AssetError
from assetweave.plans.commands import Project
from assetweave.sources.config import parse
from assetweave.sources.store import Store, WriterLock
from tests import helpers as h

SETTINGS = {"models": {"visual": "test-hash", "audio": "test-audio"}}


def project(spark, folder, **more) -> Project:
    return Project(spark, folder, parse(SETTINGS | more))


@pytest.fixture(scope="module")
def media(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("media")
    h.write(folder / "props/red chest.png", h.png("red"))
    h.write(folder / "props/blue door.png", h.png("blue"))
    h.write(folder / "icons/green_icon.png", h.png("green"))
    h.write(folder / "icons/copy.png", h.png("green"))
    h.write(folder / "Ünï/glass.png", h.png("white", border=True))
    h.write(folder / "corrupt.png", "not an image")
    h.write(folder / "readme.txt", "text")
    h.write(folder / "sfx/white_noise.wav", h.wav("noise", 0.5))
    h.write(folder / "sfx/beep.wav", h.wav("sine", 1.5, 44100, 2))
    h.write(folder / "sfx/broken.ogg", "x")
    h.write(folder / "models/cube.glb", h.glb())
    made = project(spark, folder)
    return made, made.index()


def test_first_run(media):
    made, stats = media
    assert (stats["discovered"], stats["supported"], stats["indexed"], stats["failed"], stats["reusedEmbeddings"]) == (11, 10, 8, 2, 1)
    assert {f["path"] for f in stats["failures"]} == {"corrupt.png", "sfx/broken.ogg"}
    status = made.status()
    assert status["types"] == {"audio": 2, "image": 5, "model3d": 1} and status["missingEmbeddings"] == 0
    assert status["stale"] == {"added": 0, "modified": 0, "removed": 0, "unchanged": 10}


def test_search_one_kind(media):
    made, _ = media
    got = made.search("red chest", kind="image", limit=3)
    assert got["results"][0]["path"] == "props/red chest.png" and got["ranking"] == "visual+lexical/v1"
    first = got["results"][0]
    assert first["score"] == pytest.approx(1 + 0.05, abs=1e-3) and first["evidence"]["lexical"] == 1
    assert got["candidates"] == 5 and not got["queryCached"]
    assert made.search("red chest", kind="image")["queryCached"]
    inside = made.search("red chest", kind="image", within="icons")
    assert {r["path"] for r in inside["results"]} == {"icons/green_icon.png", "icons/copy.png"} and inside["candidates"] == 5


def test_search_fused(media):
    made, _ = media
    got = made.search("sound of noise")
    assert got["ranking"] == "zscore-fusion/v2" and got["results"][0]["kind"] == "audio"
    for r in got["results"]:
        e = r["evidence"]
        assert r["score"] == pytest.approx(e["z"] + e["lexical"] + 4 * e["intent"], abs=2e-4)


def test_similar_and_duplicates(media):
    made, _ = media
    got = made.similar("icons/green_icon.png")
    assert got["results"][0]["path"] == "icons/copy.png" and got["results"][0]["duplicate"]
    assert all(r["path"] != "icons/green_icon.png" for r in got["results"])
    assert made.similar("icons/green_icon.png", kind="model3d")["results"][0]["path"] == "models/cube.glb"
    with pytest.raises(AssetError) as e:
        made.similar("icons/green_icon.png", kind="audio")
    assert e.value.code == "USAGE_ERROR"


def test_inspect(media):
    made, _ = media
    got = made.inspect("models/cube.glb")
    assert got["state"] == "indexed" and got["metadata"]["triangleCount"] == 12 and len(got["previews"]) == 1
    assert made.inspect("PROPS/RED CHEST.png")["path"] == "props/red chest.png"
    assert made.inspect("corrupt.png")["state"] == "failed"
    assert made.inspect("readme.txt")["state"] == "unsupported"
    with pytest.raises(AssetError):
        made.inspect("nowhere.png")


def test_contact_sheet(media):
    made, _ = media
    got = made.contact_sheet(["sfx/beep.wav", "models/cube.glb", "corrupt.png"], search="green", limit=2)
    assert [i["path"] for i in got["items"]][:2] == ["icons/green_icon.png", "icons/copy.png"] and list(got["errors"]) == ["5"]
    assert os.path.getsize(got["output"]) > 100


def test_contracts_and_evaluation(media):
    from assetweave.plans.contracts import check
    from assetweave.plans.evaluate import evaluate

    made, stats = media
    check("index", stats)
    check("search", made.search("green"))
    check("similar", made.similar("icons/copy.png"))
    check("inspect", made.inspect("icons/copy.png"))
    check("status", made.status(check=False))
    check("models", made.model_status())
    check("error", AssetError("INDEX_BUSY", "x").document())
    with pytest.raises(AssetError):
        check("status", {"schemaVersion": 1})
    got = evaluate(made, [("red", "CHEST"), ("blue", "door"), ("white", "nothing")], {"props/red chest.png": ["chest_01"], "props/blue door.png": ["door"]}, kind="image")
    assert got == {"hit_at_1": pytest.approx(2 / 3), "hit_at_5": pytest.approx(2 / 3), "hit_at_10": pytest.approx(2 / 3), "mrr_at_10": 0.667, "queries": 3}


def test_images_that_the_jvm_decodes(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(24, 16, 1)
    for x in range(24):
        for y in range(16):
            image.setRGB(x, y, 0x0000FF)
    (tmp_path / "a b").mkdir()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a b/blue+sky.jpg")))
    made = project(spark, tmp_path)
    assert made.index()["indexed"] == 1
    got = made.inspect("a b/blue+sky.jpg")["metadata"]
    assert (got["width"], got["height"], got["format"]) == (24, 16, "jpeg")
    assert made.search("blue", kind="image")["results"][0]["evidence"]["visual"] > 0.99


def test_incremental_runs(spark, tmp_path):
    for i in range(6):
        h.write(tmp_path / f"a/img{i}.png", h.png("red", 32 + i))
    made = project(spark, tmp_path)
    first = made.index(batch_size=2, should_stop=lambda done: done == 1)
    assert first["interrupted"] and 0 < first["indexed"] < 6 and made.status(check=False)["lastIndexedAt"] is None
    second = made.index()
    assert second["indexed"] + second["unchanged"] == 6 and second["unchanged"] == first["indexed"]
    # Touched but equal, changed, removed and new.
    os.utime(tmp_path / "a/img0.png", (1, 1))
    h.write(tmp_path / "a/img1.png", h.png("blue", 40))
    (tmp_path / "a/img2.png").unlink()
    h.write(tmp_path / "b/new.png", h.png("white"))
    assert made.status()["stale"] == {"added": 1, "modified": 2, "removed": 1, "unchanged": 3}
    third = made.index()
    assert (third["indexed"], third["unchanged"], third["removed"]) == (2, 4, 1)
    assert made.store().table("embeddings").count() == made.store().table("assets").count() == 6
    # Another version of a processor makes its assets work again.
    made.registry.by_id("image").version = "9"
    assert made.index()["indexed"] == 6


def test_failures_stay_until_asked(spark, tmp_path):
    h.write(tmp_path / "bad.png", "x")
    h.write(tmp_path / "big.png", h.png("red", 400))
    made = project(spark, tmp_path, maxFileSizeMb=0.0001)
    assert made.index()["failed"] == 2
    assert made.index()["unchanged"] == 2
    assert made.index(retry_failed=True)["failed"] == 2
    assert "larger than" in made.inspect("big.png")["error"]


def test_streaming(spark, tmp_path):
    from assetweave.streaming.incremental import index_new_files

    h.write(tmp_path / "in/a.png", h.png("red"))
    made = project(spark, tmp_path / "in")
    store = Store.create(spark, tmp_path / "store")
    run = lambda: index_new_files(spark, str(tmp_path / "in"), store, made.registry, made.models, str(tmp_path / "cp"))
    assert run() == 1
    h.write(tmp_path / "in/sub/b.png", h.png("blue"))
    assert run() == 1 and run() == 0
    assert {r["path"] for r in store.table("assets").collect()} == {"a.png", "sub/b.png"}


def test_store(spark, tmp_path):
    store = Store.create(spark, tmp_path)
    store.add_roots(["a/b", "c"], 1)
    assert store.add_roots(["a"], 2) == ["a", "c"] == store.roots()
    store.set_meta(x="1")
    store.set_meta(x="2", y="3")
    assert store.get_meta("x") == "2" and store.get_meta("z") is None
    store.cache_query("s", "q", [0.5], 1)
    assert store.cached_query("s", "q", 2) == [0.5] and store.cached_query("s", "other", 2) is None
    assert store.vacuum() > 0 and store.get_meta("y") == "3"
    store._put(store.manifest() | {"schema_version": 99})
    with pytest.raises(AssetError) as e:
        Store.open(spark, tmp_path)
    assert e.value.exit_code == 9
    with pytest.raises(AssetError) as e:
        Store.open(spark, tmp_path / "none")
    assert e.value.exit_code == 3


def test_lock(tmp_path):
    with WriterLock(tmp_path), pytest.raises(AssetError), WriterLock(tmp_path):
        pass
    h.write(tmp_path / "writer.lock", json.dumps({"pid": 2**22 + 1, "host": socket.gethostname()}))
    with WriterLock(tmp_path):
        pass
    h.write(tmp_path / "writer.lock", json.dumps({"pid": 1, "host": "elsewhere"}))
    with pytest.raises(AssetError), WriterLock(tmp_path):
        pass


def test_cli_usage(capsys):
    from assetweave.cli import main

    assert main(["nonsense"]) == 2
    capsys.readouterr()
