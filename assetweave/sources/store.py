"""The store: versioned Parquet snapshots named by one manifest.

A write makes new snapshot folders and then replaces the manifest, so readers see all tables of a
commit or none of it, and a run that dies leaves the last commit in place.
"""

from __future__ import annotations

import json
import os
import shutil
import socket
import threading
import time
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AssetError
from ..functions import paths
from ..schemas import KEYS, SCHEMA_VERSION, TABLES

#: Entries that the query cache keeps.
CACHE_SIZE = 1000


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def touch(old: DataFrame, stats: DataFrame) -> DataFrame:
    """Old rows with size and mtime_ms of ``stats`` (path, size, mtime_ms) where it has the path."""
    new = stats.select("path", F.col("size").alias("aw_size"), F.col("mtime_ms").alias("aw_mtime"))
    return old.join(new, "path", "left").withColumns({"size": F.coalesce("aw_size", "size"), "mtime_ms": F.coalesce("aw_mtime", "mtime_ms")}).drop("aw_size", "aw_mtime")


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def prune(embeddings: DataFrame, assets: DataFrame) -> DataFrame:
    """Without vectors whose content no asset has."""
    return embeddings.join(assets.select("content_hash").distinct(), "content_hash", "left_semi").select(*embeddings.columns)


def replace_file(path: Path, data: bytes) -> None:
    """Write beside, then put in place at once."""
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    beside.write_bytes(data)
    os.replace(beside, path)


class Store:
    """Tables under one folder of a file system that the driver and all executors share; the manifest
    and the lock are small files beside the snapshots. Addresses of other stores are refused."""

    def __init__(self, spark: SparkSession, root: str | Path):
        if "://" in str(root):
            raise AssetError("USAGE_ERROR", f"The index must lie in a shared folder, not at {root}")
        self.spark, self.root = spark, Path(root)

    @property
    def manifest_file(self) -> Path:
        return self.root / "manifest.json"

    @classmethod
    def create(cls, spark: SparkSession, root: str | Path) -> Store:
        store = cls(spark, root)
        store.root.mkdir(parents=True, exist_ok=True)
        (store.root / ".gitignore").write_text("*\n")
        if not store.manifest_file.exists():
            store._put({"schema_version": SCHEMA_VERSION, "commit": 0, "tables": {}})
        return store.open_checked()

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path) -> Store:
        store = cls(spark, root)
        if not store.manifest_file.exists():
            raise AssetError("INDEX_NOT_FOUND", "There is no index here")
        return store.open_checked()

    def open_checked(self) -> Store:
        version = self.manifest()["schema_version"]
        if version > SCHEMA_VERSION:
            raise AssetError("INDEX_INCOMPATIBLE", f"The index has schema version {version}; this release knows {SCHEMA_VERSION}")
        if version < SCHEMA_VERSION:
            self._put(self.manifest() | {"schema_version": SCHEMA_VERSION})
        return self

    def manifest(self) -> dict:
        return json.loads(self.manifest_file.read_text())

    def _put(self, manifest: dict) -> None:
        replace_file(self.manifest_file, json.dumps(manifest, indent=1).encode())

    def table(self, name: str) -> DataFrame:
        """A table as of the last commit; vectors are partitioned by space, so a search reads one."""
        at = self.manifest()["tables"].get(name)
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(self.root / at))

    def commit(self, **tables: DataFrame) -> int:
        """Replace the named tables together."""
        manifest = self.manifest()
        number = manifest["commit"] + 1
        for name, df in tables.items():
            at = f"{name}/{number:06d}-{uuid.uuid4().hex[:8]}"
            shaped = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
            writer = shaped.write.mode("error")
            if name == "embeddings":
                writer = writer.partitionBy("space_id")
            writer.parquet(str(self.root / at))
            manifest["tables"][name] = at
        self._put(manifest | {"commit": number})
        return number

    def vacuum(self) -> int:
        """Drop snapshots that the manifest no longer names."""
        live = set(self.manifest()["tables"].values())
        stale = [p for name in TABLES for p in (self.root / name).glob("*") if f"{name}/{p.name}" not in live]
        for p in stale:
            shutil.rmtree(p)
        return len(stale)

    # Small tables.

    def get_meta(self, key: str) -> str | None:
        row = self.table("meta").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def set_meta(self, **values: str) -> None:
        new = self.spark.createDataFrame(list(values.items()), TABLES["meta"])
        self.commit(meta=upsert(self.table("meta"), new, KEYS["meta"]))

    def roots(self) -> list[str]:
        return [r["path"] for r in self.table("roots").orderBy("path").collect()]

    def add_roots(self, roots: Iterable[str], now_ms: int) -> list[str]:
        """Record scanned folders; those below others are folded into them."""
        known = {r["path"]: r for r in self.table("roots").collect()}
        kept = paths.fold_roots([*known, *roots])
        rows = [(r, known[r]["added_at"] if r in known else now_ms, known[r]["last_indexed_at"] if r in known else None) for r in kept]
        self.commit(roots=self.spark.createDataFrame(rows, TABLES["roots"]))
        return sorted(kept)

    def cached_query(self, space_id: str, text: str, now_ms: int) -> list[float] | None:
        """A query's vector; finding it makes it the most recently used."""
        row = self.table("query_cache").filter((F.col("space_id") == space_id) & (F.col("text") == text)).first()
        if row is None:
            return None
        self.cache_query(space_id, text, row["vector"], now_ms)
        return list(row["vector"])

    def cache_query(self, space_id: str, text: str, vector: list[float], now_ms: int) -> None:
        new = self.spark.createDataFrame([(space_id, text, [float(x) for x in vector], now_ms)], TABLES["query_cache"])
        both = upsert(self.table("query_cache"), new, KEYS["query_cache"])
        self.commit(query_cache=both.orderBy(F.col("used_at").desc(), "space_id", "text").limit(CACHE_SIZE))

    def prune_previews(self) -> int:
        """Drop preview folders of contents that no asset has; only folder names reach the driver."""
        folder = self.root / "previews"
        if not folder.is_dir():
            return 0
        names = self.spark.createDataFrame([(p.name,) for p in folder.iterdir()], "content_hash string")
        gone = names.join(self.table("assets").select("content_hash"), "content_hash", "left_anti").collect()
        for row in gone:
            shutil.rmtree(folder / row["content_hash"], ignore_errors=True)
        return len(gone)


class WriterLock:
    """One writer at a time. A lock left by a dead process of this host, or one that says nothing, is
    taken over; one from another host is respected. A lock appears with its owner already in it."""

    def __init__(self, root: str | Path):
        self.file = Path(root) / "writer.lock"

    def __enter__(self) -> WriterLock:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        mine = json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "since": time.time()})
        draft = self.file.with_name(f"{self.file.name}.{socket.gethostname()}.{os.getpid()}.{threading.get_ident()}")
        draft.write_text(mine)
        try:
            for _ in range(2):
                try:
                    os.link(draft, self.file)
                    return self
                except FileExistsError:
                    if not self._abandoned():
                        break
                    self.file.unlink(missing_ok=True)
        finally:
            draft.unlink(missing_ok=True)
        raise AssetError("INDEX_BUSY", "Another process is writing to this index")

    def __exit__(self, *_: object) -> None:
        self.file.unlink(missing_ok=True)

    def _abandoned(self) -> bool:
        try:
            owner = json.loads(self.file.read_text())
        except OSError:
            return False
        except ValueError:
            return True
        if not isinstance(owner, dict) or "pid" not in owner:
            return True
        if owner.get("host") != socket.gethostname():
            return False
        try:
            os.kill(int(owner["pid"]), 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False
