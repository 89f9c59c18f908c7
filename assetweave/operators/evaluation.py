"""Retrieval quality: first relevant rank, Hit@k and MRR@10."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_up


def mark_relevant(hits: DataFrame, labels: str = "labels", pattern: str = "pattern") -> DataFrame:
    """Adds relevant: the query's pattern, without regard to case, is found in one of the hit's labels."""
    return hits.withColumn("relevant", F.exists(labels, lambda x: F.regexp_like(x, F.concat(F.lit("(?i)"), F.col(pattern)))))


def first_relevant(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, first_rank (null without a relevant hit), n_relevant; queries without hits too."""
    found = hits.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.count_if("relevant").alias("n_relevant"))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))


def hit_at_k(first: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    return first.agg(*[F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks])


def mrr_at_10(first: DataFrame) -> DataFrame:
    """Mean of 1 / rank of the first relevant hit within 10, to three decimals."""
    return first.agg(round_up(F.avg(F.when(F.col("first_rank") <= 10, 1.0 / F.col("first_rank")).otherwise(0.0)), 3).alias("mrr_at_10"))
