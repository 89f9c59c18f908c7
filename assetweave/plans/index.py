"""Incremental indexing: plan by joins, read and embed in Python workers, commit batch by batch."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AssetError
from ..functions import paths
from ..functions.models import ModelSpec
from ..functions.providers import embed_grouped, provider_for
from ..operators import changes
from ..schemas import ASSETS, EMBEDDINGS, KEYS
from ..sources import images
from ..sources.discovery import Discovery, discover
from ..sources.ignore import IgnoreRules
from ..sources.processors import JVM_IMAGES, ImageProcessor, Registry
from ..sources.store import Store, WriterLock, delete, prune, replace_file, touch, upsert

_RESULT = (
    "path string, native_path string, kind string, extension string, size long, mtime_ms long, content_hash string, metadata string, description string, "
    "tags array<string>, processor_id string, processor_version string, outcome string, error string, "
    "vectors array<struct<channel:string,vector:array<float>>>, previews map<string,binary>"
)


@dataclass
class RunStats:
    roots: list[str]
    discovered: int = 0
    supported: int = 0
    indexed: int = 0
    unchanged: int = 0
    removed: int = 0
    failed: int = 0
    reused_embeddings: int = 0
    interrupted: bool = False
    failures: list[dict] = field(default_factory=list)
    issues: list[dict] = field(default_factory=list)
    elapsed_ms: int = 0

    def document(self) -> dict:
        names = {"reused_embeddings": "reusedEmbeddings", "elapsed_ms": "elapsedMs", "issues": "discoveryIssues"}
        return {"schemaVersion": 1} | {names.get(k, k): v for k, v in asdict(self).items()}


def _sibling(native: str) -> Callable[[str], bytes | None]:
    folder = posixpath.dirname(native)

    def read(relative: str) -> bytes | None:
        try:
            return Path(folder, *relative.split("/")).read_bytes()
        except OSError:
            return None

    return read


def process_files(work: DataFrame, registry: Registry, models: dict[str, ModelSpec], max_bytes: int) -> DataFrame:
    """One result a file of ``work`` (path, native_path, extension, size, mtime_ms, known_hash,
    known_current, hash, reuse).

    A file's hash and everything else come from the same bytes. A failure stays with its file. The
    vectors of a batch are made in one call, and file by file if that fails. Content that is
    unchanged since the last run is only touched; content with a vector, if its hash is still the
    one looked up, gives metadata only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {c: provider_for(s) for c, s in models.items()}
        for batch in batches:
            out = [one(row, ready) for row in batch.itertuples(index=False)]
            embed(out, ready)
            for r in out:
                r.pop("inputs")
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _columns])

    _columns = ["path", "native_path", "kind", "extension", "size", "mtime_ms", "content_hash", "metadata", "description", "tags", "processor_id", "processor_version", "outcome", "error", "vectors", "previews"]

    def one(row, ready) -> dict:
        processor = registry.for_extension(row.extension)
        r = dict.fromkeys(_columns) | {"path": row.path, "native_path": row.native_path, "kind": processor.kind, "extension": row.extension, "size": int(row.size), "mtime_ms": int(row.mtime_ms), "content_hash": "", "metadata": "{}", "processor_id": processor.id, "processor_version": processor.version, "outcome": "failed", "vectors": [], "previews": {}, "inputs": {}}
        if row.size > max_bytes:
            return r | {"error": f"File is larger than the {round(max_bytes / 1048576)} MB limit"}
        try:
            data = Path(row.native_path).read_bytes()
        except FileNotFoundError:
            return r | {"outcome": "vanished"}
        except OSError as e:
            return r | {"error": f"Cannot read file: {e}"}
        r |= {"size": len(data), "content_hash": hashlib.sha256(data).hexdigest()}
        try:
            sibling = _sibling(row.native_path)
            if r["content_hash"] == row.known_hash and row.known_current:
                return r | {"outcome": "touched"}
            if row.reuse and r["content_hash"] == row.hash:
                return r | {"outcome": "reused", "metadata": json.dumps(processor.metadata(row.extension, data, sibling))}
            pixels = getattr(row, "pixels", None)
            if pixels is not None and images.format_of(data) not in images.DECODERS:
                name = {"jpg": "jpeg", "tif": "tiff"}.get(row.extension, row.extension)
                done = ImageProcessor.of(images.from_spark(int(row.pixel_rows), int(row.pixel_columns), int(row.pixel_channels), pixels, name))
            else:
                done = processor.process(row.extension, data, sibling)
            if missing := [c for c in done.inputs if c not in ready]:
                raise ValueError(f'No embedding provider configured for channel "{missing[0]}"')
            return r | {"outcome": "indexed", "metadata": json.dumps(done.metadata), "description": done.description, "tags": done.tags, "previews": done.previews, "inputs": done.inputs}
        except Exception as e:  # noqa: BLE001  any failure stays with its file
            return r | {"error": f"Processing failed: {e}"}

    def unavailable(e: Exception) -> bool:
        """A model that can't be loaded is no fault of a file: the run ends."""
        return isinstance(e, AssetError) and e.code == "MODEL_UNAVAILABLE"

    def embed(rows: list[dict], ready) -> None:
        for channel, provider in ready.items():
            asked = [r for r in rows if r["outcome"] == "indexed" and channel in r["inputs"]]
            distinct = {r["content_hash"]: r for r in asked}  # equal contents are embedded once
            try:
                made = dict(zip(distinct, embed_grouped(provider, [r["inputs"][channel] for r in distinct.values()]), strict=True)) if distinct else {}
            except Exception as e:  # noqa: BLE001  find out which file it was
                if unavailable(e):
                    raise
                made = {}
                for h, r in distinct.items():
                    try:
                        made[h] = embed_grouped(provider, [r["inputs"][channel]])[0]
                    except Exception as e:  # noqa: BLE001
                        if unavailable(e):
                            raise
                        made[h] = e
            for r in asked:
                v = made[r["content_hash"]]
                if isinstance(v, Exception):
                    r |= {"outcome": "failed", "error": f"Embedding failed: {v}", "metadata": "{}"}
                else:
                    r["vectors"] = [*r["vectors"], {"channel": channel, "vector": v.tolist()}]

    return work.mapInPandas(run, _RESULT)


def hashes(work: DataFrame, max_bytes: int) -> DataFrame:
    """path, hash of each file that can be read and isn't too large: a pass that only reads, so that
    equal contents are decoded and embedded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, native, size in zip(batch["path"], batch["native_path"], batch["size"], strict=True):
                try:
                    out.append((path, hashlib.sha256(Path(native).read_bytes()).hexdigest() if size <= max_bytes else None))
                except OSError:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "hash"])

    return work.select("path", "native_path", "size").mapInPandas(run, "path string, hash string")


def with_pixels(work: DataFrame, project: str) -> DataFrame:
    """Adds pixels of images that the JVM decodes, joined by path; other files have none."""
    glob = "*.{" + ",".join(c for e in JVM_IMAGES for c in (e, e.upper())) + "}"
    found = work.sparkSession.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("dropInvalid", True).load(project)
    # Paths come as encoded addresses, in which a plus sign stands for itself.
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    shown = found.select(
        F.regexp_replace(origin, "^file:/*", "/").alias("native_path"),
        F.col("image.height").alias("pixel_rows"),
        F.col("image.width").alias("pixel_columns"),
        F.col("image.nChannels").alias("pixel_channels"),
        F.col("image.data").alias("pixels"),
    )
    return work.join(shown, "native_path", "left")


def with_reuse(work: DataFrame, hashed: DataFrame, store: Store, registry: Registry, models: dict[str, ModelSpec]) -> DataFrame:
    """Adds hash and reuse: a current vector for the content is stored, or another path of this
    batch, the first of them, makes it. (If that one fails, the next run finds the others incomplete.)"""
    channels = {p.id: list(p.channels) for p in registry.processors}
    known = work.join(hashed, "path", "left")
    first = known.filter("hash IS NOT NULL").groupBy("hash", "processor_id").agg(F.min("path").alias("first_path"))
    ready = changes.complete(known.withColumn("content_hash", F.col("hash")), store.table("embeddings"), {c: m.space_id for c, m in models.items()}, channels)
    joined = known.join(first, ["hash", "processor_id"], "left").join(ready.filter("complete").select("path", F.lit(True).alias("ready")), "path", "left")
    return joined.withColumn("reuse", F.col("ready").isNotNull() | F.coalesce(F.col("path") != F.col("first_path"), F.lit(False))).drop("ready", "first_path")


def plan(found: Discovery, store: Store, registry: Registry, models: dict[str, ModelSpec], *, retry_failed: bool = False) -> DataFrame:
    """The listing with processor, what is stored, and plan: unchanged or work."""
    spark = store.spark
    handled = F.broadcast(spark.createDataFrame(registry.rows(), "extension string, processor_id string, processor_version string, kind string"))  # one row an extension
    listing = found.files.join(handled, "extension")
    stored = store.table("assets")
    channels = {p.id: list(p.channels) for p in registry.processors}
    spaces = {c: s.space_id for c, s in models.items()}
    ready = changes.complete(stored.join(F.broadcast(handled.select("processor_id").distinct()), "processor_id", "left_semi"), store.table("embeddings"), spaces, channels)
    planned = changes.outcomes(listing, stored, ready, retry_failed=retry_failed)
    current = (F.col("state") == "indexed") & (F.col("processor_id") == F.col("p_id")) & (F.col("processor_version") == F.col("p_version")) & F.coalesce("complete", F.lit(False))
    return planned.withColumn("known_hash", F.coalesce("content_hash", F.lit(""))).withColumn("known_current", F.coalesce(current, F.lit(False)))


def _assets(results: DataFrame, now_ms: int) -> DataFrame:
    failed = F.col("outcome") == "failed"
    return results.filter(F.col("outcome").isin("indexed", "reused", "failed")).select(
        "path",
        paths.match_key(F.col("path")).alias("match_key"),
        "kind",
        "extension",
        "size",
        "mtime_ms",
        "content_hash",
        "metadata",
        "description",
        "tags",
        "processor_id",
        "processor_version",
        F.when(failed, "failed").otherwise("indexed").alias("state"),
        F.when(failed, F.col("error")).alias("error"),
        F.lit(now_ms).alias("indexed_at"),
        paths.tokens(F.col("path")).alias("path_tokens"),
    )


def _embeddings(results: DataFrame, models: dict[str, ModelSpec], now_ms: int) -> DataFrame:
    spaces = F.create_map(*[F.lit(x) for c, s in models.items() for x in (c, s.space_id)])
    each = results.filter(F.col("outcome") == "indexed").select("content_hash", F.concat_ws("@", "processor_id", "processor_version").alias("input_version"), F.explode("vectors").alias("v"))
    return each.select(
        "content_hash", "input_version", F.size("v.vector").alias("dims"), "v.vector", F.lit(now_ms).alias("created_at"), spaces[F.col("v.channel")].alias("space_id")
    ).dropDuplicates(["content_hash", "space_id"])


def run_index(
    spark: SparkSession,
    project: str | Path,
    store: Store,
    registry: Registry,
    models: dict[str, ModelSpec],
    rules: IgnoreRules,
    *,
    roots: list[str],
    max_bytes: int = 256 << 20,
    batch_size: int = 100_000,
    retry_failed: bool = False,
    should_stop: Callable[[int], bool] = lambda done: False,
) -> RunStats:
    """Bring the store up to date with the files below the roots.

    The plan compares stats, then hashes; unchanged files aren't read. Work is dealt into batches by
    hash of the path; each batch commits assets and vectors together, so a run that ends early
    keeps its finished batches and the next one resumes. Removal, pruning of vectors and previews
    and the time of the last run wait for a complete run.
    """
    started, now_ms = time.time(), int(time.time() * 1000)
    stats = RunStats([r or "." for r in roots])
    with WriterLock(store.root):
        found = discover(spark, str(project), roots, rules, lambda p: registry.may_handle(paths.extension_of(p)))
        stats.discovered = found.seen
        stats.issues = [r.asDict() for r in found.issues.collect()]
        store.add_roots(roots, now_ms)
        planned = plan(found, store, registry, models, retry_failed=retry_failed).checkpoint() if _can_checkpoint(spark) else plan(found, store, registry, models, retry_failed=retry_failed)
        counts = {r["plan"]: r["n"] for r in planned.groupBy("plan").agg(F.count("*").alias("n")).collect()}
        stats.supported, stats.unchanged = sum(counts.values()), counts.get("unchanged", 0)
        unreadable = [("" if i["path"] == "." else i["path"]) for i in stats.issues if not i["missing"]]
        gone = changes.removed(found.files, store.table("assets"), roots, unreadable)
        batches = max(1, -(-counts.get("work", 0) // batch_size)) if counts.get("work") else 0
        work = planned.filter(F.col("plan") == "work").select("path", "native_path", "extension", "size", "mtime_ms", "processor_id", "processor_version", "known_hash", "known_current")
        for k in range(batches):
            if should_stop(k):
                stats.interrupted = True
                break
            part = work.filter(F.pmod(F.xxhash64("path"), F.lit(batches)) == k) if batches > 1 else work
            tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, counts["work"] // batches + 1))
            at = store.root / "results" / f"{now_ms}-{k}"
            part = part.repartition(tasks, "path")
            hashes(part, max_bytes).write.parquet(str(at) + "-hashes")
            part = with_reuse(part, spark.read.parquet(str(at) + "-hashes"), store, registry, models)
            if not part.filter(F.col("extension").isin(*JVM_IMAGES)).isEmpty():
                part = with_pixels(part, str(project))
            process_files(part.repartition(tasks, "path"), registry, models, max_bytes).write.parquet(str(at))
            results = spark.read.parquet(str(at))
            _commit(store, results, models, now_ms)
            told = {r["outcome"]: r["n"] for r in results.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
            stats.indexed += told.get("indexed", 0) + told.get("reused", 0)
            stats.reused_embeddings += told.get("reused", 0)
            stats.unchanged += told.get("touched", 0)
            stats.failed += told.get("failed", 0)
            stats.removed += told.get("vanished", 0)
            stats.failures += [r.asDict() for r in results.filter("outcome = 'failed'").select("path", "error").orderBy("path").limit(50).collect()]
            write_previews(results, str(store.root / "previews"))
        if not stats.interrupted:
            rest = delete(store.table("assets"), gone, KEYS["assets"])
            stats.removed += store.table("assets").count() - rest.count()
            store.commit(assets=rest, embeddings=prune(store.table("embeddings"), rest))
            store.prune_previews()
            store.set_meta(lastIndexedAt=str(now_ms), **{f"space:{c}": s.space_id for c, s in models.items()})
            _drop(store.root / "results")
            store.vacuum()
    stats.elapsed_ms = int((time.time() - started) * 1000)
    return stats


def _can_checkpoint(spark: SparkSession) -> bool:
    return spark.sparkContext.getCheckpointDir() is not None


def _commit(store: Store, results: DataFrame, models: dict[str, ModelSpec], now_ms: int) -> None:
    assets = upsert(store.table("assets"), _assets(results, now_ms), KEYS["assets"])
    assets = touch(assets, results.filter("outcome = 'touched'").select("path", "size", "mtime_ms"))
    assets = delete(assets, results.filter("outcome = 'vanished'"), KEYS["assets"])
    vectors = upsert(store.table("embeddings"), _embeddings(results, models, now_ms), KEYS["embeddings"])
    store.commit(assets=assets.select(*ASSETS.names), embeddings=vectors.select(*EMBEDDINGS.names))


def write_previews(results: DataFrame, folder: str) -> None:
    """Previews as files under their content's hash, written by the tasks that hold them."""

    def write(rows) -> None:
        for row in rows:
            for name, png in row["previews"].items():
                target = Path(folder, row["content_hash"])
                target.mkdir(parents=True, exist_ok=True)
                replace_file(target / f"{name}.png", bytes(png))

    results.filter((F.col("outcome") == "indexed") & (F.size("previews") > 0)).select("content_hash", "previews").foreachPartition(write)


def _drop(folder: Path) -> None:
    import shutil

    if os.path.isdir(folder):
        shutil.rmtree(folder)
