"""Indexing as a stream of files: what is new since the last run is taken up once, then the run ends."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.models import ModelSpec
from ..plans.index import _commit, process_files, with_reuse, write_previews
from ..schemas import schema
from ..sources.processors import Registry
from ..sources.store import Store, WriterLock

_FILES = schema("path string, modificationTime timestamp, length bigint, content binary")


def index_new_files(spark: SparkSession, base: str, store: Store, registry: Registry, models: dict[str, ModelSpec], checkpoint: str, *, max_bytes: int = 256 << 20) -> int:
    """Take up files that the stream's checkpoint hasn't seen; returns how many.

    The content column isn't read by the stream, so a batch is a listing. Deletions never show in a
    file stream: they are left to the next full index run.
    """
    handled = spark.createDataFrame(registry.rows(), "extension string, processor_id string, processor_version string, kind string")
    taken = [0]
    prefix = f"{Path(base).resolve()}/"

    def batch(files: DataFrame, epoch: int) -> None:
        native = F.regexp_replace("path", "^file:/*", "/")
        listing = files.select(native.alias("native_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
        listing = listing.withColumn("path", F.substring(F.col("native_path"), F.lit(len(prefix) + 1), F.length("native_path")))
        listing = listing.withColumn("extension", paths.extension(F.col("path"))).join(F.broadcast(handled), "extension")  # one row an extension
        work = listing.withColumn("known_hash", F.lit("")).withColumn("known_current", F.lit(False))
        from ..plans.index import hashes

        work = with_reuse(work, hashes(work, max_bytes), store, registry, models)
        at = f"{store.root}/results/stream-{epoch}"
        process_files(work, registry, models, max_bytes).write.mode("overwrite").parquet(at)
        results = spark.read.parquet(at)
        with WriterLock(store.root):
            import time

            _commit(store, results, models, int(time.time() * 1000))
        write_previews(results, str(store.root / "previews"))
        taken[0] += results.count()

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).load(base)
    started = stream.drop("content").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return taken[0]
