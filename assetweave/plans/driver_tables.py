"""The engine's tables, derived from the driver's, in DataFrame operations and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

#: Spaces of the derived tables, by kind of asset.
SPACES = {"image": "visual", "audio": "audio", "model3d": "visual"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _kind(number):
    return F.element_at(F.array(F.lit("image"), F.lit("audio"), F.lit("model3d")), (number % 3 + 1).cast("int"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset a document; toxic ones count as failed."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    kind = _kind(F.col("doc_id"))
    path = F.concat_ws("/", F.lit("docs"), "lang", "source", F.concat(F.lit("Doc_"), "doc_id", F.lit(".txt")))
    failed = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        path.alias("path"),
        kind.alias("kind"),
        F.lit("txt").alias("extension"),
        F.col("n_chars").alias("size"),
        (F.col("doc_id") * 1000).alias("mtime_ms"),
        F.sha2("text", 256).alias("content_hash"),
        kind.alias("processor_id"),
        F.concat(F.col("doc_id") % 2 + 1, F.lit("")).alias("processor_version"),
        F.when(failed, "failed").otherwise("indexed").alias("state"),
        F.when(failed, F.lit("Processing failed: toxic")).alias("error"),
        paths.tokens(path).alias("path_tokens"),
    )


ASSETS_SQL = r"""
assets AS (
  SELECT d.doc_id, 'docs/' || lang || '/' || source || '/Doc_' || d.doc_id || '.txt' AS path,
         ['image', 'audio', 'model3d'][(d.doc_id % 3 + 1)::INT] AS kind, 'txt' AS extension, n_chars AS size, d.doc_id * 1000 AS mtime_ms,
         sha256(text) AS content_hash, ['image', 'audio', 'model3d'][(d.doc_id % 3 + 1)::INT] AS processor_id, (d.doc_id % 2 + 1)::VARCHAR AS processor_version,
         CASE WHEN toxic = 1 THEN 'failed' ELSE 'indexed' END AS state,
         CASE WHEN toxic = 1 THEN 'Processing failed: toxic' END AS error
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector a content hash: that of the least vec_id among the documents that share it."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.sha2("text", 256).alias("content_hash"))
    joined = docs.join(read(spark, sf_dir, "embeddings"), "vec_id")
    one = joined.groupBy("content_hash").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("vec_id"))
    return one.select(
        "content_hash",
        F.when(F.col("vec_id") % 3 == 1, "audio").otherwise("visual").alias("space_id"),
        F.concat(_kind(F.col("vec_id")), F.lit("@"), F.col("vec_id") % 2 + 1).alias("input_version"),
        F.size("vector").alias("dims"),
        "vector",
    )


EMBEDDINGS_SQL = r"""
emb AS (
  SELECT content_hash, CASE WHEN vec_id % 3 = 1 THEN 'audio' ELSE 'visual' END AS space_id,
         ['image', 'audio', 'model3d'][(vec_id % 3 + 1)::INT] || '@' || (vec_id % 2 + 1) AS input_version, len(vector) AS dims, vector
  FROM (SELECT sha256(text) AS content_hash, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS vector
        FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1))"""


def vectors_with_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings alone as assets with vectors: kind by label, and a path."""
    kind = F.when(F.col("label") <= 3, "image").when(F.col("label") <= 6, "audio").otherwise("model3d")
    path = F.concat(F.lit("label"), "label", F.lit("/vec"), "vec_id")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", kind.alias("kind"), path.alias("path"), F.col("embedding").alias("vector"))


VECTORS_SQL = r"""
vec AS (
  SELECT vec_id, label, CASE WHEN label <= 3 THEN 'image' WHEN label <= 6 THEN 'audio' ELSE 'model3d' END AS kind,
         'label' || label || '/vec' || vec_id AS path, embedding AS vector FROM embeddings)"""


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """A query vector: one row's."""
    return list(read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets as a later listing finds them: some gone, some changed, some new."""
    a = assets(spark, sf_dir).select("doc_id", "path", "size", "mtime_ms", "processor_id", "processor_version")
    there = a.filter(F.col("doc_id") % 17 != 0).withColumn("size", F.col("size") + (F.col("doc_id") % 13 == 0).cast("int"))
    new = a.filter(F.col("doc_id") % 11 == 0).withColumn("path", F.concat(F.lit("new/"), "path"))
    return there.unionByName(new).drop("doc_id")


LISTING_SQL = r"""
listing AS (
  SELECT path, size + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, mtime_ms, processor_id, processor_version FROM assets WHERE doc_id % 17 <> 0
  UNION ALL SELECT 'new/' || path, size, mtime_ms, processor_id, processor_version FROM assets WHERE doc_id % 11 = 0)"""


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of parts, and addresses of pages, as a list of names."""
    part = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit(".png")).alias("path"))
    return part.unionByName(read(spark, sf_dir, "pages").select(F.col("url").alias("path")))


PATHS_SQL = "paths AS (SELECT p_brand || '/' || p_type || '/' || p_name || '.png' AS path FROM part UNION ALL SELECT url FROM pages)"
