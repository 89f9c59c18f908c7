"""File discovery: a listing as a DataFrame, with issues beside it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import ISSUES, LISTING
from .ignore import IgnoreRules


@dataclass
class Discovery:
    files: DataFrame
    issues: DataFrame
    seen: int


def walk(project: str, roots: Iterable[str], rules: IgnoreRules, accept: Callable[[str], bool]) -> tuple[list[tuple], list[tuple], int]:
    """(files, issues, seen). Folders that are ignored, or links, are not entered; links to files
    count as files; what cannot be read becomes an issue and stops nothing."""
    files, issues, seen = [], [], 0
    waiting, visited = list(roots), set()
    while waiting:
        folder = waiting.pop()
        if folder in visited:
            continue
        visited.add(folder)
        try:
            with os.scandir(paths.to_native(project, folder)) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            issues.append((folder or ".", str(e), isinstance(e, FileNotFoundError | NotADirectoryError)))
            continue
        for entry in entries:
            logical = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                if not rules.ignores(logical, True):
                    waiting.append(logical)
            elif not rules.ignores(logical, False) and entry.is_file():
                seen += 1
                if accept(logical):
                    try:
                        stat = entry.stat()
                        files.append((logical, entry.path, paths.extension_of(logical), stat.st_size, stat.st_mtime_ns // 1_000_000))
                    except OSError as e:
                        issues.append((logical, str(e), False))
    return sorted(files), issues, seen


def discover(spark: SparkSession, project: str, roots: Iterable[str], rules: IgnoreRules, accept: Callable[[str], bool] = lambda _: True) -> Discovery:
    """Discovery of a project on the driver's file system."""
    files, issues, seen = walk(project, roots, rules, accept)
    return Discovery(spark.createDataFrame(files, LISTING), spark.createDataFrame(issues, ISSUES), seen)


def discover_store(spark: SparkSession, base: str, rules: IgnoreRules, extensions: Iterable[str]) -> DataFrame:
    """The same listing of any store that Spark reads, without reading contents; rules and
    extensions are filters on the listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).drop("content")
    logical = F.element_at(F.split(F.col("path"), F.lit(r"\Q" + base.rstrip("/").split(":", 1)[-1].lstrip("/") + r"/\E"), 2), -1)
    listed = found.select(logical.alias("path"), F.col("path").alias("native_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    listed = listed.withColumn("extension", paths.extension(F.col("path")))
    return listed.filter(F.col("extension").isin(*extensions) & ~rules.column(F.col("path"))).select("path", "native_path", "extension", "size", "mtime_ms")
