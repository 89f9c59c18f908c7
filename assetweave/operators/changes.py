"""Change detection: what a listing says against what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def in_roots(path: Column, roots: Sequence[str]) -> Column:
    return paths.within_any(path, list(roots))


def diff(listing: DataFrame, stored: DataFrame, roots: Sequence[str] = ("",), unreadable: Sequence[str] = ()) -> DataFrame:
    """path, change: added, modified, unchanged, or removed, by one full outer join on the path.

    Stored rows outside the roots, or below a directory that exists but could not be read, are
    left alone (change is kept); rows of a directory that is gone are removed.
    """
    there = listing.select("path", F.col("size").alias("l_size"), F.col("mtime_ms").alias("l_mtime"), F.lit(True).alias("listed"))
    known = stored.select("path", F.col("size").alias("s_size"), F.col("mtime_ms").alias("s_mtime"), F.lit(True).alias("known"))
    both = there.join(known, "path", "full_outer")
    exempt = ~in_roots(F.col("path"), roots) | in_roots(F.col("path"), unreadable)
    change = (
        F.when(F.col("listed") & F.col("known").isNull(), "added")
        .when(F.col("listed").isNull(), F.when(exempt, "kept").otherwise("removed"))
        .when((F.col("l_size") == F.col("s_size")) & (F.col("l_mtime") == F.col("s_mtime")), "unchanged")
        .otherwise("modified")
    )
    return both.select("path", change.alias("change"))


def staleness(listing: DataFrame, stored: DataFrame, roots: Sequence[str] = ("",)) -> DataFrame:
    """One row: added, modified, removed, unchanged. Unlike an index run, status doesn't exempt
    unreadable directories."""
    changes = diff(listing, stored, roots)
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "removed", "unchanged")])


def removed(listing: DataFrame, stored: DataFrame, roots: Sequence[str] = ("",), unreadable: Sequence[str] = ()) -> DataFrame:
    gone = stored.select("path").join(listing.select("path"), "path", "left_anti")
    return gone.filter(in_roots(F.col("path"), roots) & ~in_roots(F.col("path"), unreadable))


def added(listing: DataFrame, stored: DataFrame) -> DataFrame:
    return listing.select("path").join(stored.select("path"), "path", "left_anti")


def complete(assets: DataFrame, embeddings: DataFrame, spaces: dict[str, str], channels: dict[str, Sequence[str]]) -> DataFrame:
    """path, complete: every channel of the asset's processor has a vector of the current input
    version (processor id @ version). Processors without channels are complete."""
    of = F.create_map(*[x for p, cs in channels.items() for x in (F.lit(p), F.array(*[F.lit(c) for c in cs]) if cs else F.array().cast("array<string>"))])
    space = F.create_map(*[F.lit(x) for pair in spaces.items() for x in pair])
    version = F.concat("processor_id", F.lit("@"), "processor_version")
    asked = assets.select("path", "content_hash", version.alias("input_version"), F.explode_outer(of[F.col("processor_id")]).alias("channel")).withColumn("space_id", space[F.col("channel")])
    have = embeddings.select("content_hash", "space_id", "input_version", F.lit(True).alias("have"))
    met = asked.join(have, ["content_hash", "space_id", "input_version"], "left")
    return met.groupBy("path").agg(F.bool_and(F.col("channel").isNull() | F.col("have").isNotNull()).alias("complete"))


def outcomes(listing: DataFrame, stored: DataFrame, completeness: DataFrame, *, retry_failed: bool = False) -> DataFrame:
    """What the plan of an index run says of each listed file before it is read: unchanged or work.

    ``listing`` has the processor that would handle a file (processor_id, processor_version).
    """
    prev = stored.select("path", F.col("size").alias("p_size"), F.col("mtime_ms").alias("p_mtime"), F.col("processor_id").alias("p_id"), F.col("processor_version").alias("p_version"), "state", "content_hash")
    joined = listing.join(prev, "path", "left").join(completeness, "path", "left")
    same = (F.col("size") == F.col("p_size")) & (F.col("mtime_ms") == F.col("p_mtime")) & (F.col("processor_id") == F.col("p_id")) & (F.col("processor_version") == F.col("p_version"))
    settled = F.when(F.col("state") == "failed", F.lit(not retry_failed)).otherwise((F.col("state") == "indexed") & F.coalesce("complete", F.lit(False)))
    return joined.withColumn("plan", F.when(F.coalesce(same & settled, F.lit(False)), "unchanged").otherwise("work"))


def run_stats(results: DataFrame) -> DataFrame:
    """One row of counts from (path, outcome): indexed, reused, unchanged, touched, failed, removed."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return results.agg(
        F.count_if(F.col("outcome") != "removed").alias("supported"),
        is_("indexed", "reused").alias("indexed"),
        is_("unchanged", "touched").alias("unchanged"),
        is_("removed").alias("removed"),
        is_("failed").alias("failed"),
        is_("reused").alias("reused_embeddings"),
    )


def reuse(new: DataFrame, embeddings: DataFrame, space_id: str) -> DataFrame:
    """path, reused: content that has a vector already, and all but the first path of equal new content."""
    have = embeddings.filter(F.col("space_id") == space_id).select("content_hash", F.lit(True).alias("have"))
    first = new.groupBy("content_hash").agg(F.min("path").alias("first_path"))
    joined = new.select("path", "content_hash").join(first, "content_hash").join(have, "content_hash", "left")
    return joined.select("path", (F.col("have").isNotNull() | (F.col("path") != F.col("first_path"))).alias("reused"))


def inspect_state(known: DataFrame) -> DataFrame:
    """Adds state of a path: missing > failed > stale (stat or version changed) > not-indexed or
    stale (no current vector) > indexed; unsupported or not-indexed where nothing is stored.

    ``known`` has exists, supported, stored, failed, stat_same, version_same, has_vector.
    """
    state = (
        F.when(~F.col("stored") & ~F.col("exists"), "missing")
        .when(~F.col("stored"), F.when(F.col("supported"), "not-indexed").otherwise("unsupported"))
        .when(~F.col("exists"), "missing")
        .when(F.col("failed"), "failed")
        .when(~F.col("stat_same") | ~F.col("version_same") | ~F.col("has_vector"), "stale")
        .otherwise("indexed")
    )
    return known.withColumn("state", state)
