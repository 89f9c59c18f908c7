"""What each command's document must hold. Later releases may add fields, never drop them."""

from __future__ import annotations

from ..errors import AssetError
from ..schemas import SCHEMA_VERSION

_NUMBER, _TEXT, _MAYBE = (int, float), str, (str, type(None))
RESULT = {"rank": int, "path": _TEXT, "kind": _TEXT, "score": _NUMBER, "evidence": dict, "contentHash": _TEXT, "metadata": dict}
_SEARCH = {"command": _TEXT, "ranking": _TEXT, "candidates": int, "models": list, "queryCached": bool, "elapsedMs": int, "results": list}
DOCUMENTS = {
    "search": _SEARCH,
    "similar": _SEARCH | {"reference": _TEXT},
    "index": {"roots": list, "discovered": int, "supported": int, "indexed": int, "unchanged": int, "removed": int, "failed": int, "reusedEmbeddings": int, "interrupted": bool, "failures": list, "elapsedMs": int},
    "inspect": {"path": _TEXT, "state": _TEXT, "kind": _MAYBE, "metadata": dict, "embeddings": list, "previews": list, "error": _MAYBE, "contentHash": _MAYBE, "indexedAt": _MAYBE},
    "status": {"project": _TEXT, "roots": list, "assets": int, "types": dict, "states": dict, "missingEmbeddings": int, "failed": list, "lastIndexedAt": _MAYBE},
    "contact-sheet": {"output": _TEXT, "items": list, "width": int, "height": int, "columns": int, "rows": int, "errors": dict},
    "models": {"models": list},
    "error": {"error": dict},
}


def check(command: str, document: dict) -> dict:
    """The document, if it keeps its contract."""
    wrong = [k for k, kind in DOCUMENTS[command].items() if not isinstance(document.get(k, ...), kind)]
    if document.get("schemaVersion") != SCHEMA_VERSION:
        wrong.append("schemaVersion")
    for r in document.get("results", []) if command in ("search", "similar") else []:
        wrong += [f"results.{k}" for k, kind in RESULT.items() if not isinstance(r.get(k, ...), kind)]
    if wrong:
        raise AssetError("INTERNAL_ERROR", f"The {command} document breaks its contract: {', '.join(dict.fromkeys(wrong))}")
    return document
