"""FBX, binary and ASCII, from version 6.1."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from .scene import Primitive, Scene, Sibling, Texture, media_type

_BINARY = b"Kaydara FBX Binary"
OLDEST = 6100
#: Units of time in a second of animation.
_TICKS = 46186158000


@dataclass
class Node:
    name: str
    values: list = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def all(self, name: str) -> list[Node]:
        return [c for c in self.children if c.name == name]

    def get(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    def value(self, name: str, default=None):
        found = self.get(name)
        return found.values[0] if found and found.values else default

    def array(self, name: str) -> np.ndarray | None:
        """Numbers under a name: a binary array, a block with an ``a`` line, or a plain list."""
        found = self.get(name)
        if found is None:
            return None
        inner = found.get("a")
        values = (inner or found).values
        if len(values) == 1 and isinstance(values[0], np.ndarray):
            return values[0]
        return np.array([v for v in values if isinstance(v, int | float)], np.float64)

    def property(self, name: str) -> list | None:
        """Values of an entry of Properties70 (or 60)."""
        for block, skip in (("Properties70", 4), ("Properties60", 3)):
            for p in (self.get(block) or Node("")).children:
                if p.values and p.values[0] == name:
                    return p.values[skip:]
        return None


def version_of(data: bytes) -> int | None:
    """7400 for 7.4, from the binary header or the first comment."""
    if data.startswith(_BINARY):
        return struct.unpack("<I", data[23:27])[0]
    said = re.search(rb"FBX (\d)\.(\d)\.(\d)", data[:200])
    return int(b"".join(said.groups())) * 10 if said else None


# Binary files.

_ARRAYS = {b"f": "<f4", b"d": "<f8", b"l": "<i8", b"i": "<i4", b"b": "<u1"}
_NUMBERS = {b"Y": "<h", b"C": "<B", b"I": "<i", b"F": "<f", b"D": "<d", b"L": "<q"}


def _parse_binary(data: bytes, version: int) -> Node:
    head = "<QQQB" if version >= 7500 else "<IIIB"
    size = struct.calcsize(head)

    def read(at: int) -> tuple[Node | None, int]:
        end, count, _, length = struct.unpack_from(head, data, at)
        if end == 0:
            return None, at + size
        at += size
        node = Node(data[at : at + length].decode("utf-8", "replace"))
        at += length
        for _ in range(count):
            kind, at = data[at : at + 1], at + 1
            if kind in _NUMBERS:
                node.values.append(struct.unpack_from(_NUMBERS[kind], data, at)[0])
                at += struct.calcsize(_NUMBERS[kind])
            elif kind in _ARRAYS:
                n, packed, stored = struct.unpack_from("<III", data, at)
                raw = data[at + 12 : at + 12 + stored]
                node.values.append(np.frombuffer(zlib.decompress(raw) if packed else raw, _ARRAYS[kind], n))
                at += 12 + stored
            elif kind in (b"S", b"R"):
                n = struct.unpack_from("<I", data, at)[0]
                raw = data[at + 4 : at + 4 + n]
                node.values.append(raw.decode("utf-8", "replace") if kind == b"S" else raw)
                at += 4 + n
            else:
                raise ValueError(f"Unknown FBX value type {kind!r}")
        while at < end:
            child, at = read(at)
            if child is None:
                break
            node.children.append(child)
        return node, end

    root, at = Node(""), 27
    while at + size <= len(data):
        node, at = read(at)
        if node is None:
            break
        root.children.append(node)
    return root


# ASCII files: braces alone give the structure, so indentation doesn't matter, and an array may end
# in a comma before its block closes.

_TOKEN = re.compile(r';[^\n]*|"([^"]*)"|([{}])|([A-Za-z_][\w|]*)\s*:|(,)|([^\s,{}";]+)')


def _parse_ascii(text: str) -> Node:
    root = Node("")
    open_, node, continues = [root], None, False
    for m in _TOKEN.finditer(text):
        quoted, brace, name, comma, bare = m.groups()
        if brace == "{":
            open_.append(node or root)
        elif brace == "}":
            if len(open_) > 1:
                open_.pop()
        elif name is not None and not continues:
            node = Node(name)
            open_[-1].children.append(node)
        elif comma:
            continues = True
            continue
        elif node is not None and (quoted is not None or bare is not None or name is not None):
            node.values.append(quoted if quoted is not None else name if name is not None else _plain(bare))
        else:
            continue
        continues = False
        if brace == "}":
            node = None
    return root


def _plain(text: str):
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


# Scene.


def _name(value: object) -> str:
    text = str(value)
    return text.split("\0", 1)[0] if "\0" in text else text.rpartition("::")[2]


def _turn(degrees) -> np.ndarray:
    """Rotation about x, then y, then z."""
    x, y, z = np.radians(np.asarray(degrees, np.float64))
    rx = np.array([[1, 0, 0], [0, np.cos(x), -np.sin(x)], [0, np.sin(x), np.cos(x)]])
    ry = np.array([[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]])
    rz = np.array([[np.cos(z), -np.sin(z), 0], [np.sin(z), np.cos(z), 0], [0, 0, 1]])
    return rz @ ry @ rx


def _matrix(move, turn: np.ndarray, scale) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = turn * np.asarray(scale, np.float64)
    out[:3, 3] = move
    return out


def _local(model: Node) -> np.ndarray:
    def p(name: str, default: float = 0.0) -> list[float]:
        return [float(x) for x in (model.property(name) or [default] * 3)[-3:]]

    turn = _turn(p("PreRotation")) @ _turn(p("Lcl Rotation")) @ _turn(p("PostRotation")).T
    return _matrix(p("Lcl Translation"), turn, p("Lcl Scaling", 1.0))


def _geometric(model: Node) -> np.ndarray:
    def p(name: str, default: float = 0.0) -> list[float]:
        return [float(x) for x in (model.property(name) or [default] * 3)[-3:]]

    return _matrix(p("GeometricTranslation"), _turn(p("GeometricRotation")), p("GeometricScaling", 1.0))


def _layer(layer: Node | None, values: str, indices: str, width: int, corner: np.ndarray, point: np.ndarray, polygon: np.ndarray) -> np.ndarray | None:
    """A layer's rows for each corner, by how the layer maps and refers."""
    if layer is None or (rows := layer.array(values)) is None or not len(rows):
        return None
    rows = np.asarray(rows, np.float64).reshape(-1, width)
    mapping = layer.value("MappingInformationType")
    at = {"ByPolygonVertex": corner, "ByPolygon": polygon, "AllSame": np.zeros_like(corner)}.get(mapping, point)
    if layer.value("ReferenceInformationType") == "IndexToDirect" and (index := layer.array(indices)) is not None and len(index):
        at = np.asarray(index, np.int64)[np.minimum(at, len(index) - 1)]
    return rows[np.clip(at, 0, len(rows) - 1)]


def texture_candidates(reference: str) -> list[str]:
    """Where a texture may lie: as written if relative, else by name beside the model or in usual folders."""
    unified = reference.replace("\\", "/")
    base = unified.rpartition("/")[2]
    written = [] if unified.startswith("/") or re.match("[A-Za-z]:/", unified) else [unified]
    return [*written, base, *(f"{folder}/{base}" for folder in ("Textures", "textures", "../Textures", "../textures"))]


def load(data: bytes, sibling: Sibling) -> Scene:
    """Polygons become fans, in metres and with y up."""
    version = version_of(data)
    if version is not None and version < OLDEST:
        raise ValueError(f"FBX {version / 1000:g} is too old (6.1 or newer is supported)")
    root = _parse_binary(data, version or 7400) if data.startswith(_BINARY) else _parse_ascii(data.decode("utf-8", "replace"))
    objects = root.get("Objects")
    if objects is None:
        raise ValueError("Not an FBX file")
    settings = root.get("GlobalSettings") or Node("")
    unit_scale = float((settings.property("UnitScaleFactor") or [1])[-1])
    z_up = int((settings.property("UpAxis") or [1])[-1]) == 2
    by_id = {o.values[0]: o for o in objects.children if o.values}
    above: dict = {}
    below: dict = {}
    for c in (root.get("Connections") or Node("")).children:
        if len(c.values) >= 3:
            child, parent = c.values[1], c.values[2]
            above.setdefault(child, []).append(parent)
            below.setdefault(parent, []).append((child, c.values[3] if len(c.values) > 3 else None))

    def of(parent, kind: str) -> list[tuple]:
        return [(i, by_id[i], how) for i, how in below.get(parent, []) if i in by_id and by_id[i].name == kind]

    worlds: dict = {}

    def world(i) -> np.ndarray:
        if i not in worlds:
            worlds[i] = np.eye(4)  # a cycle ends here
            parent = next((p for p in above.get(i, []) if p in by_id and by_id[p].name == "Model"), None)
            worlds[i] = (world(parent) if parent is not None else np.eye(4)) @ _local(by_id[i])
        return worlds[i]

    models = [(i, o) for i, o in by_id.items() if o.name == "Model"]
    scene = Scene("fbx", units="meters", up_axis="Y", unit_scale=unit_scale, node_count=1 + len(models))
    if version is not None:
        scene.version = f"{version // 1000}.{version % 1000 // 100}"
    textures: dict[str, Texture] = {}
    to_metres = unit_scale / 100

    def texture_of(material_id) -> Texture | None:
        for i, t, how in of(material_id, "Texture"):
            if how not in ("DiffuseColor", "Maya|TEX_color_map", None):
                continue
            for _, video, _ in of(i, "Video"):
                body = video.value("Content")
                if isinstance(body, bytes) and body:
                    uri = f"embedded:{i}"
                    return textures.setdefault(uri, Texture(body, media_type(str(video.value("RelativeFilename", ""))), None))
            uri = str(t.value("RelativeFilename") or t.value("FileName") or "")
            if not uri:
                continue
            if uri not in textures:
                found = next((b for c in texture_candidates(uri) if (b := sibling(c)) is not None), None)
                textures[uri] = Texture(found, media_type(uri), uri)
                if found is None:
                    scene.missing.append(uri)
            return textures[uri]
        return None

    names: dict[str, None] = {}
    for i, model in models:
        attached = of(i, "Geometry") or ([(i, model, None)] if model.get("Vertices") else [])
        for geometry_id, geometry, _ in attached:
            points, stream = geometry.array("Vertices"), geometry.array("PolygonVertexIndex")
            if points is None or stream is None or not len(stream):
                continue
            scene.mesh_count += 1
            stream = np.asarray(stream, np.int64)
            ends = np.flatnonzero(stream < 0)
            point = np.where(stream < 0, ~stream, stream)
            starts = np.r_[0, ends[:-1] + 1]
            polygon = np.repeat(np.arange(len(ends)), ends - starts + 1)
            fans = [np.c_[np.full(e - s - 1, s), np.arange(s + 1, e), np.arange(s + 2, e + 1)] for s, e in zip(starts, ends, strict=True) if e - s >= 2]
            corner = np.concatenate(fans).reshape(-1) if fans else np.empty(0, np.int64)
            matrix = world(i) @ _geometric(model)
            xyz = np.asarray(points, np.float64).reshape(-1, 3)[point[corner]] @ matrix[:3, :3].T + matrix[:3, 3]
            if z_up:
                xyz = np.c_[xyz[:, 0], xyz[:, 2], -xyz[:, 1]]
            positions = (xyz * to_metres).astype(np.float32)
            scene.vertex_count += len(corner)
            uv = _layer(geometry.get("LayerElementUV"), "UV", "UVIndex", 2, corner, point[corner], polygon[corner])
            rgba = _layer(geometry.get("LayerElementColor"), "Colors", "ColorIndex", 4, corner, point[corner], polygon[corner])
            scene.has_vertex_colors |= rgba is not None
            skins = [d for _, d, _ in of(geometry_id, "Deformer")]
            for deformer_id, deformer, _ in of(geometry_id, "Deformer"):
                if deformer.values[-1] == "Skin":
                    scene.skin_count += 1
                    scene.joint_count += len({b for c, _, _ in of(deformer_id, "Deformer") for b, _, _ in of(c, "Model")})
            scene.has_morph_targets |= any(d.values[-1] == "BlendShape" for d in skins) or bool(of(geometry_id, "Geometry"))
            used = _layer(geometry.get("LayerElementMaterial"), "Materials", "Materials", 1, corner, point[corner], polygon[corner]) if geometry.get("LayerElementMaterial") and geometry.get("LayerElementMaterial").value("MappingInformationType") != "AllSame" else None
            which = used[:, 0].astype(int).reshape(-1, 3)[:, 0] if used is not None else np.zeros(len(corner) // 3, int)
            materials = of(i, "Material")
            for m in dict.fromkeys(which.tolist()):
                faces = np.flatnonzero(which == m)
                primitive = Primitive(positions, np.arange(len(corner)).reshape(-1, 3)[faces])
                if uv is not None:
                    primitive.uvs = np.c_[uv[:, 0], 1 - uv[:, 1]].astype(np.float32)
                if rgba is not None:
                    primitive.colors = rgba[:, :3].astype(np.float32)
                if 0 <= m < len(materials):
                    material_id, material, _ = materials[m]
                    primitive.material = _name(material.values[1] if len(material.values) > 1 else material.values[0])
                    names[primitive.material] = None
                    color = material.property("DiffuseColor") or material.property("Diffuse") or [1.0, 1.0, 1.0]
                    opacity = material.property("Opacity") or [1.0]
                    primitive.base = (*(float(x) for x in color[-3:]), float(opacity[-1]))
                    primitive.texture = texture_of(material_id)
                scene.triangle_count += len(faces)
                scene.primitives.append(primitive)
    scene.materials = list(names)
    scene.textures = list(textures.values())
    scene.missing = list(dict.fromkeys(scene.missing))
    for i, o in by_id.items():
        if o.name == "AnimationStack":
            stop = float((o.property("LocalStop") or [0])[-1]) / _TICKS
            scene.animations.append((_name(o.values[1]) or f"animation {len(scene.animations)}", max(0.0, stop)))
    return scene
