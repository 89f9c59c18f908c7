"""Wavefront OBJ with MTL materials."""

from __future__ import annotations

import posixpath
import re

import numpy as np

from .scene import Primitive, Scene, Sibling, Texture, media_type

# Arguments that options of a texture statement take.
_OPTION_ARGUMENTS = {"-s": 3, "-o": 3, "-t": 3, "-mm": 2, "-bm": 1, "-boost": 1, "-texres": 1, "-blendu": 1, "-blendv": 1, "-clamp": 1, "-imfchan": 1, "-cc": 1}


def _statements(text: str):
    for line in text.splitlines():
        word, _, rest = line.strip().replace("\t", " ").partition(" ")
        if word and word[0] != "#":
            yield word, rest.strip()


def texture_path(rest: str) -> str:
    """The path of a texture statement, after its options, with forward slashes."""
    words = rest.split()
    while words and words[0] in _OPTION_ARGUMENTS:
        words = words[1 + _OPTION_ARGUMENTS[words[0]] :]
    return " ".join(words).replace("\\", "/")


def _number(text: str, default: float) -> float:
    try:
        return float(text)
    except ValueError:
        return default


def materials_of(text: str) -> dict[str, dict]:
    """name -> color (RGBA) and map, of an MTL file."""
    out: dict[str, dict] = {}
    now: dict | None = None
    for word, rest in _statements(text):
        key = word.lower()
        if key == "newmtl":
            now = out[rest] = {"color": [1.0, 1.0, 1.0, 1.0], "map": None}
        elif now is None:
            continue
        elif key == "kd":
            rgb = [_number(x, 1.0) for x in rest.split()[:3]]
            now["color"][:3] = (rgb + rgb[:1] * 3)[:3] if rgb else [1.0, 1.0, 1.0]
        elif key in ("d", "tr"):
            value = _number(rest, 1.0 if key == "d" else 0.0)
            now["color"][3] = (value or 1.0) if key == "d" else 1.0 - value
        elif key == "map_kd":
            now["map"] = texture_path(rest)
    return out


def load(data: bytes, sibling: Sibling) -> Scene:
    """Faces become fans of triangles; indices may count from the end. Vertices are those stated."""
    points: list[tuple] = []
    colors: list[tuple] = []
    uvs: list[tuple] = []
    corners: dict[str, list[tuple[int, int]]] = {}
    materials: dict[str, dict] = {}
    objects: dict[str, None] = {}
    missing: list[str] = []
    material, triangles, colored = "", 0, False

    def at(text: str, n: int) -> int:
        i = int(text)
        return n + i if i < 0 else i - 1

    for word, rest in _statements(data.decode("utf-8", "replace")):
        if word == "v":
            x = [_number(s, float("nan")) for s in rest.split()]
            points.append(tuple((x + [float("nan")] * 3)[:3]))
            has = len(x) >= 6
            colored |= has
            colors.append(tuple(x[3:6]) if has else (1.0, 1.0, 1.0))
        elif word == "vt":
            x = [_number(s, 0.0) for s in rest.split()]
            uvs.append((x[0] if x else 0.0, x[1] if len(x) > 1 else 0.0))
        elif word == "f":
            face = []
            for corner in rest.split():
                p, _, more = corner.partition("/")
                t = more.partition("/")[0]
                face.append((at(p, len(points)), at(t, len(uvs)) if t else -1))
            fan = corners.setdefault(material, [])
            for b, c in zip(face[1:], face[2:], strict=False):
                fan += (face[0], b, c)
                triangles += 1
        elif word == "usemtl":
            material = rest
        elif word in ("o", "g"):
            objects[rest or f"{word} {len(objects)}"] = None
        elif word == "mtllib":
            for library in re.split(r"(?<=\.mtl)\s+", rest, flags=re.IGNORECASE):
                path = library.replace("\\", "/")
                text = sibling(path)
                if text is None:
                    missing.append(path)
                    continue
                for name, made in materials_of(text.decode("utf-8", "replace")).items():
                    if made["map"]:
                        made["map"] = posixpath.normpath(posixpath.join(posixpath.dirname(path), made["map"]))
                    materials[name] = made

    xyz = np.array(points, np.float64).reshape(-1, 3)
    rgb = np.array(colors, np.float64).reshape(-1, 3)
    uv = np.array(uvs, np.float64).reshape(-1, 2)
    textures: dict[str, Texture] = {}
    primitives = []
    for name, listed in corners.items():
        pairs = np.array(listed, np.int64).reshape(-1, 2)
        known = (pairs[:, 0] >= 0) & (pairs[:, 0] < len(xyz))
        where = np.where(known, pairs[:, 0], 0)
        positions = np.where(known[:, None], xyz[where] if len(xyz) else np.nan, np.nan).astype(np.float32)
        made = materials.get(name)
        primitive = Primitive(positions, np.arange(len(pairs)).reshape(-1, 3), base=tuple(made["color"]) if made else (1.0, 1.0, 1.0, 1.0), material=name or None)
        mapped = (pairs[:, 1] >= 0) & (pairs[:, 1] < len(uv))
        if (pairs[:, 1] >= 0).any():
            found = uv[np.where(mapped, pairs[:, 1], 0)] if len(uv) else np.zeros((len(pairs), 2))
            found = np.where(mapped[:, None], found, [0.0, 0.0])
            # The file counts from the bottom left, the scene from the top left.
            primitive.uvs = np.where((pairs[:, 1] >= 0)[:, None], np.c_[found[:, 0], 1 - found[:, 1]], 0.0).astype(np.float32)
        if colored:
            primitive.colors = rgb[where].astype(np.float32)
        if made and made["map"]:
            path = made["map"]
            if path not in textures:
                textures[path] = Texture(sibling(path), media_type(path), path)
                if textures[path].data is None:
                    missing.append(path)
            primitive.texture = textures[path]
        primitives.append(primitive)
    return Scene(
        "obj",
        primitives,
        mesh_count=max(len(objects), 1 if primitives else 0),
        node_count=len(objects),
        materials=list(materials),
        textures=list(textures.values()),
        has_vertex_colors=colored,
        vertex_count=len(points),
        triangle_count=triangles,
        missing=list(dict.fromkeys(missing)),
    )
