"""Retrieval evaluation: labelled queries against an indexed project."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F

from ..operators import evaluation
from .commands import Project

DEPTH = 10


def evaluate(project: Project, queries: Sequence[tuple[str, str]], labels: Mapping[str, Sequence[str]], *, kind: str) -> dict:
    """Hit@1, 5 and 10 and MRR@10 of (text, pattern) queries.

    ``labels`` maps an indexed path to the names that patterns are matched against, without regard
    to case (files may be indexed under blind names). A query that no label matches counts as missed.
    """
    spark = project.spark
    asked = spark.createDataFrame([(i, text, pattern) for i, (text, pattern) in enumerate(queries)], "query_id int, text string, pattern string")
    found = [(i, r["path"], r["rank"]) for i, (text, _) in enumerate(queries) for r in project.search(text, kind=kind, limit=DEPTH)["results"]]
    hits = spark.createDataFrame(found, "query_id int, path string, rank long")
    named = spark.createDataFrame([(p, list(names)) for p, names in labels.items()], "path string, labels array<string>")
    told = hits.join(named, "path", "left").withColumn("labels", F.coalesce("labels", F.array("path"))).join(asked, "query_id")
    first = evaluation.first_relevant(evaluation.mark_relevant(told), asked)
    return evaluation.hit_at_k(first).first().asDict() | evaluation.mrr_at_10(first).first().asDict() | {"queries": len(queries)}
