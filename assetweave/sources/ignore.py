"""Ignore rules in gitignore syntax, without regard to case, as regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import INDEX_DIR, Config

IGNORE_FILE = ".assetignore"
# Fixed values.
MANDATORY = (f"{INDEX_DIR}/",)
DEFAULTS = (".git/", ".hg/", ".svn/", "node_modules/", ".godot/", ".import/")


def pattern(line: str) -> tuple[bool, str] | None:
    """(negated, regular expression over "path" for files and "path/" for folders), or None.

    The expression matches what the rule names and all below it.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\") if negated or line[0] == "\\" and line[1:2] in "#!" else line
    folders_only = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = [], 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif line.startswith("**", i) and i + 2 == len(line) and line[i - 1 : i] == "/":
            out.append(".+")
            i += 2
        elif line[i] == "*":
            out.append("[^/]*")
            i += 1
        elif line[i] == "?":
            out.append("[^/]")
            i += 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out.append(re.escape(line[i]))
            i += 1
    start = "^" if anchored else "^(?:.*/)?"
    return negated, start + "".join(out) + ("/" if folders_only else "(?:/|$)")


class IgnoreRules:
    """Rules in order; of those that match a path the last decides, but nothing below an ignored
    folder comes back."""

    def __init__(self, lines: Iterable[str], sources: Iterable[str] = ()):
        self.rules = [(n, re.compile(x, re.IGNORECASE | re.DOTALL)) for line in lines if (p := pattern(line)) for n, x in [p]]
        self.sources = list(sources)

    @classmethod
    def of(cls, project: str | Path, config: Config) -> IgnoreRules:
        """Mandatory rules, defaults, the ignore file, the root's .gitignore if asked for, and the configuration."""
        lines, sources = list(MANDATORY), []
        if config.default_ignores:
            lines += DEFAULTS
            sources.append("defaults")
        for name, wanted in ((IGNORE_FILE, True), (".gitignore", config.respect_gitignore)):
            file = Path(project) / name
            if wanted and file.is_file():
                lines += re.split(r"\r?\n", file.read_text("utf-8-sig", "replace"))
                sources.append(name)
        if config.ignore:
            lines += config.ignore
            sources.append("config")
        return cls(lines, sources)

    def _decides(self, path: str) -> bool:
        out = False
        for negated, rule in self.rules:
            if rule.search(path):
                out = not negated
        return out

    def ignores(self, path: str, folder: bool) -> bool:
        if not path:
            return False
        parts = path.split("/")
        above = ("/".join(parts[:i]) + "/" for i in range(1, len(parts)))
        return any(map(self._decides, above)) or self._decides(path + "/" * folder)

    def column(self, path: Column) -> Column:
        """The same for a column of file paths: the last matching rule decides, for the path and
        for each folder above it."""

        def decides(p: Column) -> Column:
            out = F.lit(False)
            for negated, rule in self.rules:
                out = F.when(p.rlike("(?is)" + rule.pattern), F.lit(not negated)).otherwise(out)
            return out

        parts = F.split(path, "/")
        above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
        return F.exists(above, decides) | decides(path)
