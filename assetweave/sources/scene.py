"""A 3D scene that all readers produce, and its description."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions.numbers import round_up_of

EXTENSIONS = ("glb", "gltf", "obj", "fbx")
#: Lists in a description stop here.
MOST_LISTED = 50
# Media types by extension of a texture.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "tga": "image/x-tga", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}

#: Reads a file beside the model by relative path; None where there is none.
Sibling = Callable[[str], bytes | None]


@dataclass
class Texture:
    data: bytes | None
    media_type: str | None
    uri: str | None


@dataclass
class Primitive:
    positions: np.ndarray  # n x 3, in world space
    indices: np.ndarray  # triangles x 3
    uvs: np.ndarray | None = None
    colors: np.ndarray | None = None
    base: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)
    texture: Texture | None = None
    material: str | None = None


@dataclass
class Scene:
    format: str
    primitives: list[Primitive] = field(default_factory=list)
    mesh_count: int = 0
    node_count: int = 0
    materials: list[str] = field(default_factory=list)
    textures: list[Texture] = field(default_factory=list)
    animations: list[tuple[str, float]] = field(default_factory=list)
    joint_count: int = 0
    skin_count: int = 0
    has_morph_targets: bool = False
    has_vertex_colors: bool = False
    vertex_count: int = 0
    triangle_count: int = 0
    generator: str | None = None
    extensions: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    units: str | None = None
    up_axis: str | None = None
    version: str | None = None
    unit_scale: float | None = None


def bounding_box(scene: Scene) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest coordinate by axis over finite numbers; none where there are none."""
    if not scene.primitives:
        return None
    points = np.concatenate([p.positions for p in scene.primitives]).astype(np.float64)
    finite = np.isfinite(points)
    if not finite.any():
        return None
    return np.where(finite, points, np.inf).min(axis=0), np.where(finite, points, -np.inf).max(axis=0)


def describe(scene: Scene) -> dict:
    box = bounding_box(scene)
    rounded = lambda xs: [round_up_of(float(x)) for x in xs]
    out = {
        "format": scene.format,
        "vertexCount": scene.vertex_count,
        "triangleCount": scene.triangle_count,
        "meshCount": scene.mesh_count,
        "nodeCount": scene.node_count,
        "materialCount": len(scene.materials),
        "materials": scene.materials[:MOST_LISTED],
        "textureCount": len(scene.textures),
        "textures": [{"uri": t.uri, "mimeType": t.media_type, "embedded": t.uri is None, "missing": t.uri is not None and t.data is None} for t in scene.textures[:MOST_LISTED]],
        "boundingBox": {"min": rounded(box[0]), "max": rounded(box[1])} if box else None,
        "dimensions": rounded(box[1] - box[0]) if box else None,
        "hasAnimations": bool(scene.animations),
        "animations": [{"name": n, "durationSeconds": round_up_of(d)} for n, d in scene.animations[:MOST_LISTED]],
        "hasSkeleton": scene.skin_count > 0,
        "jointCount": scene.joint_count,
        "hasMorphTargets": scene.has_morph_targets,
        "hasVertexColors": scene.has_vertex_colors,
        "units": scene.units,
        "upAxis": scene.up_axis,
        "generator": scene.generator,
        "extensionsUsed": scene.extensions,
        "missingResources": scene.missing[:MOST_LISTED],
    }
    if scene.version is not None:
        out["sourceVersion"] = scene.version
    if scene.unit_scale is not None:
        out["sourceUnitScale"] = scene.unit_scale
    return out


def media_type(path: str) -> str | None:
    return MEDIA_TYPES.get(path.rpartition(".")[2].lower())


def load(extension: str, data: bytes, sibling: Sibling) -> Scene:
    from . import fbx, gltf, obj

    return {"obj": obj.load, "fbx": fbx.load}.get(extension, gltf.load)(data, sibling)
