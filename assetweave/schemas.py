"""Schemas of the stored tables and of per-kind metadata."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

SCHEMA_VERSION = 1
KINDS = ("image", "audio", "model3d", "video", "text", "other")
CHANNELS = ("visual", "audio", "text", "geometry")
STATES = ("indexed", "failed")

_TYPES = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "boolean": BooleanType(), "binary": BinaryType(), "timestamp": TimestampType(), "array<string>": ArrayType(StringType()), "array<float>": ArrayType(FloatType())}


def schema(columns: str) -> StructType:
    """A schema from "name type, ...", without needing a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: ``metadata`` is open JSON; ``path_tokens`` is derived once, when a row is written.
ASSETS = schema(
    "path string, match_key string, kind string, extension string, size bigint, mtime_ms bigint, content_hash string, "
    "metadata string, description string, tags array<string>, processor_id string, processor_version string, state string, "
    "error string, indexed_at bigint, path_tokens array<string>"
)
EMBEDDINGS = schema("content_hash string, input_version string, dims int, vector array<float>, created_at bigint, space_id string")
QUERY_CACHE = schema("space_id string, text string, vector array<float>, used_at bigint")
ROOTS = schema("path string, added_at bigint, last_indexed_at bigint")
META = schema("key string, value string")
LISTING = schema("path string, native_path string, extension string, size bigint, mtime_ms bigint")
ISSUES = schema("path string, error string, missing boolean")

TABLES = {"assets": ASSETS, "embeddings": EMBEDDINGS, "query_cache": QUERY_CACHE, "roots": ROOTS, "meta": META}
#: What identifies a row of each table.
KEYS = {"assets": ["path"], "embeddings": ["content_hash", "space_id"], "query_cache": ["space_id", "text"], "roots": ["path"], "meta": ["key"]}

METADATA = {
    "image": "width int, height int, aspectRatio double, aspect string, format string, hasAlphaChannel boolean, hasTransparency boolean, "
    "dominantColor string, channels int, colorSpace string, frames int, animated boolean, density int",
    "audio": "durationSeconds double, channels int, sampleRate int, format string, bitrateKbps int, peakDb double, rmsDb double",
    "model3d": "format string, vertexCount bigint, triangleCount bigint, meshCount bigint, nodeCount bigint, materialCount bigint, materials array<string>, "
    "textureCount bigint, textures array<struct<uri:string,mimeType:string,embedded:boolean,missing:boolean>>, "
    "boundingBox struct<min:array<double>,max:array<double>>, dimensions array<double>, hasAnimations boolean, "
    "animations array<struct<name:string,durationSeconds:double>>, hasSkeleton boolean, jointCount bigint, hasMorphTargets boolean, hasVertexColors boolean, "
    "units string, upAxis string, generator string, extensionsUsed array<string>, missingResources array<string>, sourceVersion string, sourceUnitScale double",
}
