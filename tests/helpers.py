"""Synthetic files, written with the standard library."""

from __future__ import annotations

import json
import math
import random
import struct
from pathlib import Path

import numpy as np

from assetweave.sources.images import encode_png

COLORS = {"red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "white": (255, 255, 255)}


def write(path: Path, data: bytes | str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return path


def png(color: str, size: int = 32, border: bool = False) -> bytes:
    pixels = np.zeros((size, size, 4 if border else 3), np.uint8)
    pixels[:, :, :3] = COLORS[color]
    if border:
        pixels[4:-4, 4:-4, 3] = 255
    return encode_png(pixels)


def wav(signal: str, seconds: float = 1.0, rate: int = 16000, channels: int = 1, frequency: float = 440) -> bytes:
    deal, n = random.Random(1), int(seconds * rate)
    make = {"sine": lambda i: math.sin(2 * math.pi * frequency * i / rate) * 0.5, "noise": lambda i: deal.uniform(-0.5, 0.5), "silence": lambda i: 0.0}[signal]
    frames = b"".join(struct.pack("<h", round(make(i) * 32767)) * channels for i in range(n))
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(frames)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(frames)) + frames


CUBE = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
FACES = [0, 1, 3, 0, 3, 2, 4, 6, 7, 4, 7, 5, 0, 4, 5, 0, 5, 1, 2, 3, 7, 2, 7, 6, 0, 2, 6, 0, 6, 4, 1, 5, 7, 1, 7, 3]


def glb() -> bytes:
    """A cube, moved by 10 and doubled, with one animation of 1.5 s and one joint."""
    body = struct.pack("<24f", *[c for p in CUBE for c in p]) + struct.pack("<36H", *FACES) + struct.pack("<2f", 0, 1.5) + struct.pack("<6f", *[0] * 6)
    document = {
        "asset": {"version": "2.0", "generator": "tests"},
        "scene": 0,
        "scenes": [{"nodes": [0]}],
        "nodes": [{"mesh": 0, "translation": [10, 0, 0], "scale": [2, 2, 2], "children": [1]}, {"name": "joint"}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "material": 0}]}],
        "materials": [{"name": "paint", "pbrMetallicRoughness": {"baseColorFactor": [1, 0, 0, 1]}}],
        "skins": [{"joints": [1]}],
        "animations": [{"name": "spin", "samplers": [{"input": 2, "output": 3}], "channels": [{"sampler": 0, "target": {"node": 0, "path": "translation"}}]}],
        "buffers": [{"byteLength": len(body)}],
        "bufferViews": [{"buffer": 0, "byteOffset": o, "byteLength": n} for o, n in ((0, 96), (96, 72), (168, 8), (176, 24))],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": 8, "type": "VEC3"},
            {"bufferView": 1, "componentType": 5123, "count": 36, "type": "SCALAR"},
            {"bufferView": 2, "componentType": 5126, "count": 2, "type": "SCALAR", "max": [1.5]},
            {"bufferView": 3, "componentType": 5126, "count": 2, "type": "VEC3"},
        ],
    }
    text = json.dumps(document).encode()
    text += b" " * (-len(text) % 4)
    return b"glTF" + struct.pack("<II", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


BOX_OBJ = "mtllib box.mtl\r\no box\r\nv 0 0 0\r\nv 2 0 0\r\nv 2 3 0\r\nv 0 3 0\r\nvt 0 0\r\nvt 1 0\r\nvt 1 1\r\nvt 0 1\r\nusemtl wood\r\nf -4/-4 -3/-3 -2/-2 -1/-1\r\n"
BOX_MTL = "newmtl wood\r\nKd 0.5 0.4 0.3\r\nmap_Kd -s 1 1 1 tex\\wood.png\r\n"
FBX = """; FBX 7.3.0 project file
GlobalSettings:  {
\tProperties70:  {
\t\tP: "UnitScaleFactor", "double", "Number", "",100
\t}
}
Objects:  {
\tGeometry: 1, "Geometry::quad", "Mesh" {
\t\tVertices: *12 {
\t\t\ta: 0,0,0,1,0,0,1,1,0,
0,1,0
\t\t\t}
\t\tPolygonVertexIndex: *4 {
\t\t\ta: 0,1,2,-4,
\t\t}
\t}
\tModel: 2, "Model::quad", "Mesh" {
\t}
\tMaterial: 3, "Material::wood", "" {
\t}
}
Connections:  {
\tC: "OO",1,2
\tC: "OO",2,0
\tC: "OO",3,2
}
"""
