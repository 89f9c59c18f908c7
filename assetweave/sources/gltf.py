"""glTF 2.0, as JSON or binary container, without compressed geometry."""

from __future__ import annotations

import base64
import json
import struct
import urllib.parse

import numpy as np

from .scene import Primitive, Scene, Sibling, Texture

# Fixed values of the format.
_MAGIC = b"glTF"
_TYPES = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}
_UNSUPPORTED = {"KHR_draco_mesh_compression", "EXT_meshopt_compression"}
TRIANGLES, STRIP, FAN = 4, 5, 6


def container(data: bytes) -> tuple[str, dict, bytes | None]:
    """(format, document, binary chunk)."""
    if data[:4] != _MAGIC:
        return "gltf", json.loads(data.decode("utf-8-sig")), None
    if len(data) < 20:
        raise ValueError("Not a GLB file")
    document, body = None, None
    at, end = 12, min(len(data), struct.unpack("<I", data[8:12])[0])
    while at + 8 <= end:
        size, kind = struct.unpack("<I4s", data[at : at + 8])
        if kind == b"JSON":
            document = json.loads(data[at + 8 : at + 8 + size])
        elif kind == b"BIN\0":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size
    if document is None:
        raise ValueError("GLB has no JSON chunk")
    return "glb", document, body


def _resource(uri: str, sibling: Sibling) -> bytes | None:
    if uri.startswith("data:"):
        head, _, body = uri.partition(",")
        return base64.b64decode(body) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(body)
    return sibling(urllib.parse.unquote(uri).replace("\\", "/"))


def triangles(mode: int, index: np.ndarray) -> np.ndarray:
    """Corner indices of triangles from a list, strip or fan; strips keep their winding."""
    n = len(index)
    if mode == TRIANGLES or n < 3:
        return index[: n // 3 * 3].reshape(-1, 3)
    i = np.arange(n - 2)
    if mode == FAN:
        return np.c_[np.full(n - 2, index[0]), index[i + 1], index[i + 2]]
    odd = i % 2
    return np.c_[index[i + odd], index[i + 1 - odd], index[i + 2]]


def _local(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], np.float64).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
            [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
            [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
        ]
    )
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), np.float64)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


class _Document:
    def __init__(self, document: dict, body: bytes | None, sibling: Sibling):
        self.json = document
        self.buffers = []
        for b in document.get("buffers", []):
            found = body if "uri" not in b else _resource(b["uri"], sibling)
            if found is None:
                raise ValueError(f'Missing geometry buffer "{b.get("uri", "")}"')
            self.buffers.append(found)

    def view(self, i: int) -> tuple[bytes, int]:
        v = self.json["bufferViews"][i]
        start = v.get("byteOffset", 0)
        return self.buffers[v["buffer"]][start : start + v["byteLength"]], v.get("byteStride", 0)

    def accessor(self, i: int) -> np.ndarray:
        """Rows of numbers; normalised integers become shares of their range."""
        a = self.json["accessors"][i]
        kind, width, n = np.dtype(_TYPES[a["componentType"]]), _WIDTHS[a["type"]], a["count"]
        if "bufferView" in a:
            raw, stride = self.view(a["bufferView"])
            stride = stride or kind.itemsize * width
            out = np.ndarray((n, width), kind, raw, a.get("byteOffset", 0), (stride, kind.itemsize)).copy()
        else:
            out = np.zeros((n, width), kind)
        if sparse := a.get("sparse"):
            raw, _ = self.view(sparse["indices"]["bufferView"])
            where = np.frombuffer(raw, _TYPES[sparse["indices"]["componentType"]], sparse["count"], sparse["indices"].get("byteOffset", 0))
            raw, _ = self.view(sparse["values"]["bufferView"])
            out[where] = np.frombuffer(raw, kind, sparse["count"] * width, sparse["values"].get("byteOffset", 0)).reshape(-1, width)
        return np.maximum(out / np.iinfo(kind).max, -1.0) if a.get("normalized") else out


def load(data: bytes, sibling: Sibling) -> Scene:
    """The default scene with node transforms applied. A missing texture is reported, a missing
    geometry buffer is an error."""
    form, document, body = container(data)
    if needs := _UNSUPPORTED.intersection(document.get("extensionsRequired", [])):
        raise ValueError(f"No decoder for {', '.join(sorted(needs))} is installed")
    doc = _Document(document, body, sibling)
    missing: list[str] = []
    images = []
    for image in document.get("images", []):
        uri = image.get("uri")
        if uri is None:
            images.append(Texture(doc.view(image["bufferView"])[0] if "bufferView" in image else None, image.get("mimeType"), None))
        else:
            embedded = uri.startswith("data:")
            found = _resource(uri, sibling)
            if found is None:
                missing.append(uri)
            kind = image.get("mimeType") or (uri[5:].partition(";")[0] if embedded else {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}.get(uri.rpartition(".")[2].lower()))
            images.append(Texture(found, kind, None if embedded else uri))
    textures = [images[t["source"]] if t.get("source") is not None else Texture(None, None, None) for t in document.get("textures", [])]
    nodes, meshes, materials = (document.get(k, []) for k in ("nodes", "meshes", "materials"))
    scene = Scene(form, units="meters", up_axis="Y", mesh_count=len(meshes), node_count=len(nodes), textures=textures, missing=missing)
    scene.materials = list(dict.fromkeys(m.get("name") or f"material {i}" for i, m in enumerate(materials)))
    scene.extensions = document.get("extensionsUsed", [])
    generator = document.get("asset", {}).get("generator")
    scene.generator = generator if isinstance(generator, str) else None

    def primitive(p: dict, world: np.ndarray) -> None:
        attributes = p.get("attributes", {})
        scene.has_morph_targets |= bool(p.get("targets"))
        if "POSITION" not in attributes:
            return
        local = doc.accessor(attributes["POSITION"]).astype(np.float64)
        scene.vertex_count += len(local)
        mode = p.get("mode", TRIANGLES)
        if mode not in (TRIANGLES, STRIP, FAN):
            return
        index = doc.accessor(p["indices"])[:, 0].astype(np.int64) if "indices" in p else np.arange(len(local))
        out = Primitive((local @ world[:3, :3].T + world[:3, 3]).astype(np.float32), triangles(mode, index))
        scene.triangle_count += len(out.indices)
        if "TEXCOORD_0" in attributes:
            out.uvs = doc.accessor(attributes["TEXCOORD_0"]).astype(np.float32)
        if "COLOR_0" in attributes:
            scene.has_vertex_colors = True
            out.colors = doc.accessor(attributes["COLOR_0"])[:, :3].astype(np.float32)
        if p.get("material") is not None:
            m = materials[p["material"]]
            surface = m.get("pbrMetallicRoughness", {})
            out.base = tuple(surface.get("baseColorFactor", (1.0, 1.0, 1.0, 1.0)))
            out.material = m.get("name")
            if "baseColorTexture" in surface:
                out.texture = textures[surface["baseColorTexture"]["index"]]
        scene.primitives.append(out)

    children = {c for n in nodes for c in n.get("children", [])}
    scenes = document.get("scenes", [])
    roots = scenes[document.get("scene", 0)].get("nodes", []) if scenes else [i for i in range(len(nodes)) if i not in children]
    waiting = [(i, np.eye(4)) for i in reversed(roots)]
    while waiting:
        i, above = waiting.pop()
        node = nodes[i]
        world = above @ _local(node)
        if "mesh" in node:
            for p in meshes[node["mesh"]].get("primitives", []):
                primitive(p, world)
        waiting += [(c, world) for c in reversed(node.get("children", []))]

    for i, a in enumerate(document.get("animations", [])):
        ends = []
        for s in a.get("samplers", []):
            times = document["accessors"][s["input"]]
            ends.append(times["max"][0] if times.get("max") else float(doc.accessor(s["input"]).max(initial=0)))
        scene.animations.append((a.get("name") or f"animation {i}", max(ends, default=0.0)))
    skins = document.get("skins", [])
    scene.skin_count = len(skins)
    scene.joint_count = len({j for s in skins for j in s.get("joints", [])})
    return scene
