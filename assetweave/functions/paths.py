"""Logical paths: as column expressions over tables, and as functions of one path on the driver."""

from __future__ import annotations

import ntpath
import posixpath
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAILING_EXTENSION = r"\.[^./]+$"
CAMEL = r"([a-z0-9])([A-Z])"
NOT_WORD = r"[^\p{L}\p{N}]+"


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last segment; dotfiles and plain names have none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]*)$", 1))


def extension_of(path: str) -> str:
    stem, dot, end = path.rpartition("/")[2].rpartition(".")
    return end.lower() if dot and stem else ""


def is_within(root: Column | str, path: Column) -> Column:
    """Equal to the root or below it; the empty root holds everything. With a plain string the
    condition reaches the scan."""
    if isinstance(root, str):
        return F.lit(True) if not root else (path == root) | path.startswith(root + "/")
    return (root == "") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def is_within_path(root: str, path: str) -> bool:
    return not root or path == root or path.startswith(f"{root}/")


def within_any(path: Column, roots: list[str]) -> Column:
    """Below one of a list of roots (a driver-side list, folded so that none lies below another)."""
    return F.exists(F.array(*[F.lit(r) for r in roots]), lambda r: is_within(r, path)) if roots else F.lit(False)


def match_key(path: Column) -> Column:
    """Case-folded key for tolerant lookups. Composed and decomposed spellings meet under the
    UNICODE_CI collation; see same_path."""
    return F.lower(path)


def same_path(a: Column, b: Column | str) -> Column:
    """Equal up to case and Unicode composition."""
    return F.collate(a, "UNICODE_CI") == (F.lit(b) if isinstance(b, str) else b)


def match_key_of(path: str) -> str:
    return unicodedata.normalize("NFC", path).lower()


def tokens(path: Column) -> Column:
    """Lower-case words of a path without its last extension; camelCase is split."""
    spaced = F.regexp_replace(F.regexp_replace(path, TRAILING_EXTENSION, ""), CAMEL, "$1 $2")
    return F.filter(F.split(F.lower(spaced), NOT_WORD), lambda t: t != "")


_WORD = re.compile(r"[^\W_]+")


def tokens_of(path: str) -> list[str]:
    spaced = re.sub(CAMEL, r"\1 \2", re.sub(TRAILING_EXTENSION, "", path)).lower()
    return _WORD.findall(spaced)


def normalize_input(text: str) -> str | None:
    """A typed path in logical form, or None for one that is absolute or leaves the project."""
    unified = text.replace("\\", "/")
    if unified.startswith("/") or re.match(r"[A-Za-z]:", unified):
        return None
    normal = posixpath.normpath(unified) if unified else "."
    if normal == ".." or normal.startswith("../"):
        return None
    return "" if normal == "." else normal


def to_logical(project: str, native: str, windows: bool = False) -> str | None:
    """Path below the project with forward slashes ("" for the project itself), or None outside it."""
    api = ntpath if windows else posixpath
    try:
        relative = api.relpath(native, project)
    except ValueError:  # another drive
        return None
    if relative == ".":
        return ""
    parts = relative.split(api.sep)
    return None if parts[0] == ".." else "/".join(parts)


def to_native(project: str, logical: str, windows: bool = False) -> str:
    return (ntpath if windows else posixpath).join(project, *logical.split("/")) if logical else project


def fold_roots(roots: list[str]) -> list[str]:
    """Without roots that lie below others, in order of first mention."""
    distinct = list(dict.fromkeys(roots))
    return [r for r in distinct if not any(o != r and is_within_path(o, r) for o in distinct)]


def channel_of_space(space: Column) -> Column:
    """The channel that the family before the first colon belongs to."""
    return F.when(F.substring_index(space, ":", 1).isin("clap", "test-audio"), "audio").otherwise("visual")
