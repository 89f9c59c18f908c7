"""Errors with stable codes and exit codes."""

from __future__ import annotations

#: Exit codes that callers rely on.
EXIT_CODES = {
    "OK": 0,
    "INTERNAL_ERROR": 1,
    "USAGE_ERROR": 2,
    "INDEX_NOT_FOUND": 3,
    "PATH_NOT_FOUND": 4,
    "NOT_INDEXED": 5,
    "MODEL_UNAVAILABLE": 6,
    "PARTIAL_FAILURE": 7,
    "INDEX_BUSY": 8,
    "INDEX_INCOMPATIBLE": 9,
    "INTERRUPTED": 130,
}


class AssetError(Exception):
    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code = code
        self.details = details

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.code]

    def document(self) -> dict:
        """What a command prints instead of its result."""
        return {"schemaVersion": 1, "error": {"code": self.code, "exitCode": self.exit_code, "message": str(self)} | ({"details": self.details} if self.details else {})}
