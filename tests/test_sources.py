from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetweave.errors import AssetError
from assetweave.functions.providers import ColorGrid, Envelope
from assetweave.sources import audio, config, contact_sheet, discovery, fbx, images, obj, render, scene
from assetweave.sources.ignore import IgnoreRules
from tests import helpers as h


def test_config(tmp_path):
    assert config.load(tmp_path, {}).max_file_size_mb == 256
    h.write(tmp_path / config.CONFIG_FILE, "\ufeff" + json.dumps({"roots": ["a"], "model3d": {"views": 4}, "models": {"visual": "test-hash"}}))
    got = config.load(tmp_path, {"ASSETWEAVE_AUDIO_MODEL": "test-audio"})
    assert (got.roots, got.views, got.models["visual"], got.models["audio"]) == (["a"], 4, "test-hash", "test-audio")
    for bad in ({"unknown": 1}, {"model3d": {"views": 3}}, {"maxFileSizeMb": 0}, {"processors": {"image": "yes"}}):
        with pytest.raises(AssetError):
            config.parse(bad)
    assert config.find_project(tmp_path) == tmp_path
    assert config.choose_roots([], ["rec"], got) == ["rec"]


def test_ignore_rules(spark, tmp_path):
    names = [".assetignore", "a.png", "keep/h.png", "build/x.png", "b.TMP", "cache/c/d.png", ".git/e.png", "node_modules/f/g.png", ".assetweave/i.png"]
    rules = IgnoreRules([".assetweave/", ".git/", "node_modules/", "build/", "*.tmp", "# note", "cache/**"])
    for n in names:
        h.write(tmp_path / n, "x")
    files, issues, seen = discovery.walk(str(tmp_path), [""], rules, lambda p: p.endswith("png"))
    assert [f[0] for f in files] == ["a.png", "keep/h.png"] and seen == 3 and not issues
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r["p"] for r in df.filter(~rules.column(F.col("p"))).collect()] == [".assetignore", "a.png", "keep/h.png"]
    back = IgnoreRules(["*.png", "!keep.png", "/top.txt", "docs/*.md"])
    assert not back.ignores("x/keep.png", False) and back.ignores("x/y.png", False)
    assert back.ignores("top.txt", False) and not back.ignores("x/top.txt", False)
    assert back.ignores("docs/a.md", False) and not back.ignores("docs/b/a.md", False)


def test_discovery_issues(spark, tmp_path):
    h.write(tmp_path / "a.png", "x")
    os.symlink(tmp_path / "a.png", tmp_path / "link.png")
    os.symlink(tmp_path, tmp_path / "loop")
    found = discovery.discover(spark, str(tmp_path), ["", "gone"], IgnoreRules([]))
    assert [r["path"] for r in found.files.orderBy("path").collect()] == ["a.png", "link.png"]
    assert [(r["path"], r["missing"]) for r in found.issues.collect()] == [("gone", True)]
    store = discovery.discover_store(spark, str(tmp_path), IgnoreRules([]), ["png"])
    assert {r["path"] for r in store.collect()} >= {"a.png"}


def test_png_round_trip_and_metadata():
    deal = np.random.default_rng(0)
    for channels in (3, 4):
        pixels = deal.integers(0, 256, (7, 9, channels), dtype=np.uint8)
        assert (images.decode(images.encode_png(pixels)).pixels == pixels).all()
    got = images.describe(images.decode(h.png("red", 32, border=True)))
    assert (got["width"], got["aspect"], got["hasTransparency"], got["format"]) == (32, "1:1", True, "png")
    assert images.for_embedding(images.decode(h.png("red"))).shape == (224, 224, 3)
    assert images.for_embedding(images.decode(images.encode_png(np.zeros((100, 1024, 3), np.uint8)))).shape == (50, 512, 3)
    with pytest.raises(ValueError):
        images.decode(b"no image")


def test_png_filters():
    import struct
    import zlib

    deal = np.random.default_rng(1)
    pixels = deal.integers(0, 256, (5, 6, 3), dtype=np.uint8).reshape(5, 18)
    lines = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        above = pixels[y - 1] if y else np.zeros(18, np.uint8)
        left = np.r_[np.zeros(3, np.uint8), pixels[y][:-3]]
        corner = np.r_[np.zeros(3, np.uint8), above[:-3]]
        a, b, c = (x.astype(int) for x in (left, above, corner))
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = {0: 0 * a, 1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kind]
        lines += bytes([kind]) + ((pixels[y].astype(int) - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.decode(data).pixels.reshape(5, 18) == pixels).all()


def test_gif():
    # 2 x 1 pixels, red and blue, uncompressed codes of a 2-bit LZW.
    data = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0]) + bytes([255, 0, 0, 0, 0, 255]) + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0]) + bytes([2, 2, 0x44, 0x0A, 0]) + b"\x3b"
    got = images.decode(data)
    assert got.frames == 1 and got.pixels.shape == (1, 2, 3)
    assert got.pixels[0, 0].tolist() == [255, 0, 0] and got.pixels[0, 1].tolist() == [0, 0, 255]


def test_audio():
    metadata, mono, rate = audio.describe("wav", h.wav("sine", 1.5, 44100, 2))
    assert (metadata["durationSeconds"], metadata["channels"], metadata["sampleRate"], metadata["format"]) == (1.5, 2, 44100, "wav")
    assert metadata["peakDb"] == pytest.approx(-6.0) and metadata["rmsDb"] == pytest.approx(-9.0)
    assert audio.describe("wav", h.wav("silence", 0.25))[0]["peakDb"] is None
    assert audio.downmix(np.array([[1, 0], [0, 1]], np.float32)).tolist() == [0.5, 0.5]
    assert audio.resample(np.array([0, 1, 2, 3], np.float32), 4, 2).tolist() == [0.5, 2.5]
    assert audio.resample(np.array([0, 1], np.float32), 1, 2).tolist() == [0, 0.5, 1, 1]
    second = np.zeros(audio.RATE, np.float32)
    assert [len(audio.windows(np.tile(second, s))) for s in (5, 10, 20, 30)] == [1, 1, 2, 3]
    with pytest.raises(ValueError):
        audio.describe("wav", b"broken")


def test_gltf_cube():
    loaded = scene.load("glb", h.glb(), lambda _: None)
    got = scene.describe(loaded)
    assert (got["vertexCount"], got["triangleCount"], got["meshCount"], got["nodeCount"], got["jointCount"]) == (8, 12, 1, 2, 1)
    assert got["boundingBox"] == {"min": [10, 0, 0], "max": [12, 2, 2]} and got["dimensions"] == [2, 2, 2]
    assert got["animations"] == [{"name": "spin", "durationSeconds": 1.5}] and got["hasSkeleton"]
    assert (got["units"], got["upAxis"], got["generator"], got["materials"]) == ("meters", "Y", "tests", ["paint"])


def test_obj_box():
    files = {"box.mtl": h.BOX_MTL.encode()}
    got = scene.describe(loaded := obj.load(h.BOX_OBJ.encode(), files.get))
    assert (got["triangleCount"], got["vertexCount"], got["dimensions"]) == (2, 4, [2, 3, 0])
    assert got["missingResources"] == ["tex/wood.png"] and got["units"] is None
    assert got["textures"] == [{"uri": "tex/wood.png", "mimeType": "image/png", "embedded": False, "missing": True}]
    assert loaded.primitives[0].base[:3] == (0.5, 0.4, 0.3)
    assert obj.texture_path("-s 1 1 1 -clamp on my tex.png") == "my tex.png"


def test_fbx_ascii():
    loaded = fbx.load(h.FBX.encode(), lambda _: None)
    got = scene.describe(loaded)
    assert (got["triangleCount"], got["sourceVersion"], got["sourceUnitScale"], got["dimensions"]) == (2, "7.3", 100, [1, 1, 0])
    assert got["materials"] == ["wood"]
    with pytest.raises(ValueError, match="too old"):
        fbx.load(b"; FBX 6.0.0 project file\n", lambda _: None)
    assert fbx.texture_candidates("C:\\Users\\x\\wood.png")[0] == "wood.png"


def test_strips_and_fans():
    from assetweave.sources.gltf import FAN, STRIP, triangles

    assert triangles(STRIP, np.arange(5)).tolist() == [[0, 1, 2], [2, 1, 3], [2, 3, 4]]
    assert triangles(FAN, np.arange(4)).tolist() == [[0, 1, 2], [0, 2, 3]]


def test_render():
    loaded = scene.load("glb", h.glb(), lambda _: None)
    shown = render.render(loaded, render.VIEWS["front"], 64)
    assert shown.shape == (64, 64, 3) and (shown == render.render(loaded, render.VIEWS["front"], 64)).all()
    assert (shown[0] == 255).all()
    middle = shown[32, 32].astype(int)
    assert middle[0] > 90 and middle[1] == middle[2] == 0
    filled = (shown != 255).any(axis=2).any(axis=0).sum() / 64
    assert filled == pytest.approx(render.FILL, abs=0.05)


def test_providers():
    grid, envelope = ColorGrid(), Envelope()
    image = images.for_embedding(images.decode(h.png("red")))
    v, red, blue = grid.embed_media([image])[0], *grid.embed_texts(["a Red door", "blue"])
    assert len(v) == 64 and v @ red == pytest.approx(1) and v @ blue == pytest.approx(0)
    noise = envelope.embed_media([(audio.describe("wav", h.wav("noise"))[1], 16000)])[0]
    tone = envelope.embed_media([(audio.describe("wav", h.wav("sine"))[1], 16000)])[0]
    asked = envelope.embed_texts(["white noise"])[0]
    assert len(noise) == 16 and noise @ asked > tone @ asked


def test_contact_sheet():
    png, told = contact_sheet.sheet([contact_sheet.Item(str(i), f"{i}.png", h.png("green")) for i in range(1, 6)] + [contact_sheet.Item("6", "bad", b"x")], thumb=64)
    assert (told["columns"], told["rows"]) == (3, 2) and list(told["errors"]) == ["6"]
    assert images.decode(png).pixels.shape[:2] == (told["height"], told["width"])
    assert contact_sheet.truncate_middle("abcdefgh", 5) == "ab…gh"
    assert contact_sheet.size_of(7, 10_000, None) == (512, 3, 3)


def test_a_lock_that_says_nothing_is_taken_over(tmp_path):
    from assetweave.errors import AssetError
    from assetweave.sources.store import Store, WriterLock

    for left in ("", "{", "[]", '{"pid": 999999999, "host": "' + __import__("socket").gethostname() + '"}'):
        (tmp_path / "writer.lock").write_text(left)
        with WriterLock(tmp_path):
            with pytest.raises(AssetError):
                WriterLock(tmp_path).__enter__()
        assert not list(tmp_path.iterdir())
    (tmp_path / "writer.lock").write_text('{"pid": 1, "host": "elsewhere"}')
    with pytest.raises(AssetError):
        WriterLock(tmp_path).__enter__()
    with pytest.raises(AssetError):
        Store(None, "hdfs://host/x")
