"""Catalog queries over assets and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def count_by_kind(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("state") == "indexed").groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def counts_record(counts: DataFrame) -> DataFrame:
    """kind -> n as one map."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("types"))


def count_by_state(assets: DataFrame) -> DataFrame:
    return assets.groupBy("state").agg(F.count("*").alias("n")).orderBy("state")


def processor_versions(assets: DataFrame) -> DataFrame:
    return assets.groupBy("processor_id", "processor_version").agg(F.count("*").alias("n")).orderBy("processor_id", "processor_version")


def embedding_spaces(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("space_id", "dims").agg(F.count("*").alias("n")).orderBy("space_id", "dims")


def total_assets(assets: DataFrame) -> DataFrame:
    return count_by_kind(assets).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def missing_embeddings(assets: DataFrame, embeddings: DataFrame, spaces: dict[str, str]) -> DataFrame:
    """kind, n: indexed assets without a vector in the space of their kind. Presence is all that counts."""
    space = F.create_map(*[F.lit(x) for pair in spaces.items() for x in pair])
    wanted = assets.filter((F.col("state") == "indexed") & F.col("kind").isin(*spaces)).select("kind", "content_hash", space[F.col("kind")].alias("space_id"))
    return wanted.join(embeddings.select("content_hash", "space_id"), ["content_hash", "space_id"], "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def total_missing(assets: DataFrame, embeddings: DataFrame, spaces: dict[str, str]) -> DataFrame:
    return missing_embeddings(assets, embeddings, spaces).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def orphan_embeddings(embeddings: DataFrame, assets: DataFrame) -> DataFrame:
    """Vectors whose content no asset has. An anti join, as NOT IN would force a nested loop."""
    return embeddings.join(assets.select("content_hash"), "content_hash", "left_anti")


def failed_assets(assets: DataFrame, limit: int = 50) -> DataFrame:
    return assets.filter(F.col("state") == "failed").select("path", "error").orderBy("path").limit(limit)


def distinct_hashes(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("content_hash") != "").select("content_hash").distinct()


def duplicates(assets: DataFrame) -> DataFrame:
    """Assets whose content another path has too, with the size of the group: a count by hash,
    aggregated before it moves, then a join, so that one hash's rows never sit in one window."""
    known = assets.filter(F.col("content_hash") != "")
    groups = known.groupBy("content_hash").agg(F.count("*").alias("copies")).filter("copies > 1")
    return known.select("path", "content_hash").join(groups, "content_hash")


def flag_duplicates(hits: DataFrame, reference_hash: str) -> DataFrame:
    return hits.withColumn("duplicate", F.col("content_hash") == reference_hash)


def by_path(assets: DataFrame, path: str) -> DataFrame:
    return assets.filter(F.col("path") == path)


def by_match_key(assets: DataFrame, path: str) -> DataFrame:
    return assets.filter(F.col("match_key") == paths.match_key_of(path))


def stats_for_changes(assets: DataFrame) -> DataFrame:
    return assets.select("path", "size", "mtime_ms", "content_hash", "processor_id", "processor_version", "state")


def embeddings_of(embeddings: DataFrame, content_hash: str, space_id: str | None = None) -> DataFrame:
    found = embeddings.filter(F.col("content_hash") == content_hash)
    return found if space_id is None else found.filter(F.col("space_id") == space_id)


def latest_queries(used: DataFrame, keep: int = 1000) -> DataFrame:
    """The query cache after eviction: the most recently used entries of all."""
    last = used.groupBy("space_id", "text").agg(F.max("used_at").alias("used_at"))
    return last.orderBy(F.col("used_at").desc(), "space_id", "text").limit(keep)


def fold_roots(roots: DataFrame) -> DataFrame:
    """Roots that lie below no other root. A root's ancestors are few, so each is looked up by an
    equal key instead of comparing all pairs."""
    distinct = roots.select("path").distinct()
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    # The empty root lies above all others.
    asked = distinct.select("path", F.explode(F.concat(above, F.when(F.col("path") != "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))).alias("above"))
    covered = asked.join(distinct.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return distinct.join(covered, "path", "left_anti")


def metadata_field(table: DataFrame, column: str, field: str, kind: str) -> DataFrame:
    """A field of JSON metadata; rows that are not JSON, or lack it, have none."""
    return table.withColumn(field, F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{field}", kind))


def summary(assets: DataFrame) -> DataFrame:
    """A line for people about an asset, from its metadata."""
    m = F.try_parse_json("metadata")
    get = lambda field, kind: F.try_variant_get(m, f"$.{field}", kind)
    image = F.concat_ws(" ", F.format_string("%dx%d", get("width", "int"), get("height", "int")), F.when(get("hasTransparency", "boolean"), F.lit("transparent")), F.when(get("animated", "boolean"), F.lit("animated")))
    audio = F.concat_ws(" ", F.format_string("%.1fs", get("durationSeconds", "double")), F.when(get("channels", "int") == 1, "mono").when(get("channels", "int") == 2, "stereo"))
    model = F.concat_ws(" ", F.format_string("%d triangles", get("triangleCount", "long")), F.when(get("hasAnimations", "boolean"), F.lit("animated")), F.when(get("hasSkeleton", "boolean"), F.lit("rigged")))
    return assets.withColumn("summary", F.when(F.col("kind") == "image", image).when(F.col("kind") == "audio", audio).when(F.col("kind") == "model3d", model).otherwise(F.lit("")))


def blind_names(files: DataFrame) -> DataFrame:
    """content_hash, name, labels: files of a labelled corpus under names that say nothing; equal
    contents are one file that keeps all labels."""
    groups = files.groupBy("content_hash", "extension").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return groups.select("content_hash", F.concat(F.substring("content_hash", 1, 16), F.lit("."), "extension").alias("name"), "labels")


def one_space_each(models: DataFrame) -> DataFrame:
    """One row a space, the last of equal ones at the place of the first."""
    first = models.groupBy("space").agg(F.min("at").alias("first"), F.max_by(F.struct(*[c for c in models.columns if c not in ("space", "at")]), "at").alias("x"))
    return first.orderBy("first").select("space", "x.*")


def largest_per_kind(scored: DataFrame, k: int) -> DataFrame:
    """Per-kind top k by score then path, of which only k rows a kind and task are shuffled."""
    w = Window.partitionBy("kind").orderBy(F.col("score").desc(), "path")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
