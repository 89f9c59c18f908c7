"""Search: one Catalyst plan from the stored tables to ranked hits.

A search reads only path, kind, state, content_hash, tokens and vectors; directory filters act after
scores and statistics; the metadata join comes after the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AssetError
from ..functions import paths, vectors
from ..functions.numbers import round_up
from . import ranking

#: Vectors longer than this are scored in Arrow batches rather than by expressions.
LONG = 256
#: Queries that are scored together.
QUERIES = 2048


def candidates(assets: DataFrame, embeddings: DataFrame, space_id: str, kinds: Sequence[str]) -> DataFrame:
    """Indexed assets of the kinds with their vectors in one space; files of equal content share one.

    Filters on kind, state and space reach the scans. Rows whose vector is of another length than
    that of the first path are left out.
    """
    a = assets.filter((F.col("state") == "indexed") & F.col("kind").isin(*kinds)).select("path", "kind", "content_hash", "path_tokens")
    e = embeddings.filter(F.col("space_id") == space_id).select("content_hash", "vector")
    return a.join(e, "content_hash")


def same_dims(found: DataFrame, dims: int) -> DataFrame:
    return found.filter(F.size("vector") == dims)


def first_dims(found: DataFrame) -> int | None:
    """Vector length of the first path; a top-1, not a sort."""
    row = found.orderBy("path").select(F.size("vector").alias("n")).first()
    return row["n"] if row else None


def _semantic(vector: Sequence[float]) -> Column:
    return vectors.dot_batch(vector)(F.col("vector")) if len(vector) > LONG else vectors.dot(F.col("vector"), vectors.literal(vector))


def score_kind(found: DataFrame, query: str | None, vector: Sequence[float]) -> DataFrame:
    """Adds semantic and lexical (zero without a query text)."""
    tokens = ranking.query_tokens(query) if query else []
    return found.withColumn("semantic", _semantic(vector)).withColumn("lexical", ranking.lexical(tokens, F.col("path_tokens")))


def _check(found: DataFrame, embeddings: DataFrame, space_id: str, vector: Sequence[float]) -> DataFrame:
    """Candidates of the query's length; an error if the first has another. Where the space has one
    length, and that is right, the number stored with each vector tells, and no join is needed."""
    known = [r["dims"] for r in embeddings.filter(F.col("space_id") == space_id).select("dims").distinct().limit(2).collect()]
    if known == [len(vector)]:
        return found
    dims = first_dims(found) if known else None
    if dims is not None and dims != len(vector):
        raise AssetError("INDEX_INCOMPATIBLE", f"The query vector has {len(vector)} dimensions and the index {dims}")
    return same_dims(found, len(vector))


def top(scored: DataFrame, limit: int, within: str = "", exclude: str | None = None) -> DataFrame:
    """The best by score, then path; the filters come after all scores."""
    kept = scored.filter(paths.is_within(within, F.col("path")))
    if exclude is not None:
        kept = kept.filter(F.col("path") != exclude)
    return kept.orderBy(F.col("score").desc(), F.col("path")).limit(limit)


def ranked(hits: DataFrame) -> DataFrame:
    """Adds rank from 1; the window sees no more than the limit's rows."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("path"))).cast("long"))


def with_assets(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """Late materialisation: the remaining columns of a few hits. They are few (a limit of 1,000 at
    most), so they are what is broadcast; hits whose asset is gone drop out."""
    rest = assets.select("path", *[c for c in assets.columns if c not in hits.columns])
    return rest.join(F.broadcast(hits), "path")


def search_by_text(assets: DataFrame, embeddings: DataFrame, query: str, vector: Sequence[float], *, kind: str, space_id: str, limit: int = 10, within: str = "", check: bool = True) -> DataFrame:
    found = candidates(assets, embeddings, space_id, [kind])
    found = _check(found, embeddings, space_id, vector) if check else found
    scored = score_kind(found, query, vector).withColumn("score", ranking.single_score(F.col("semantic"), F.col("lexical")))
    return ranked(top(scored, limit, within))


def search_across_kinds(assets: DataFrame, embeddings: DataFrame, query: str, sources: Sequence[tuple[str, str, Sequence[float]]], *, limit: int = 10, within: str = "") -> DataFrame:
    """Fused ranking. ``sources`` are (kind, space, query vector); kinds of one space and vector share a scan.

    Semantic scores are standardised within each kind over all its candidates, so scores of
    different models are never compared; then kinds are ranked together. Vectors of another length
    than the query's are an error or left out, as in a search of one kind.
    """
    wanted = ranking.intent_kind(query)
    groups: dict[tuple, list[str]] = {}
    for kind, space_id, vector in sources:
        groups.setdefault((space_id, tuple(vector)), []).append(kind)
    found = [(_check(candidates(assets, embeddings, space_id, kinds), embeddings, space_id, vector), vector) for (space_id, vector), kinds in groups.items()]
    parts = [score_kind(part, query, vector) for part, vector in found]
    pool = parts[0]
    for part in parts[1:]:
        pool = pool.unionByName(part)
    pool = ranking.with_z(pool, "semantic", ["kind"])
    intent = (F.col("kind") == wanted).cast("int") if wanted else F.lit(0)
    pool = pool.withColumn("intent", intent).withColumn("score", ranking.fused_score(F.col("z"), F.col("lexical"), F.col("intent")))
    return ranked(top(pool, limit, within))


def search_by_vector(assets: DataFrame, embeddings: DataFrame, vector: Sequence[float], *, kind: str, space_id: str, limit: int = 10, within: str = "", exclude: str | None = None, check: bool = True) -> DataFrame:
    """By example: no lexical part. The example itself can be left out before the limit."""
    found = candidates(assets, embeddings, space_id, [kind])
    found = _check(found, embeddings, space_id, vector) if check else found
    scored = score_kind(found, None, vector).withColumn("score", F.col("semantic"))
    return ranked(top(scored, limit, within, exclude))


def evidence(hits: DataFrame, channel: Column | str) -> DataFrame:
    """Output columns: rounded scores, and what they consist of."""
    channel = F.lit(channel) if isinstance(channel, str) else channel
    cosine = round_up(F.col("semantic"))
    out = {"score": round_up(F.col("score")), "visual": F.when(channel == "visual", cosine), "audio": F.when(channel == "audio", cosine), "lexical": round_up(F.col("lexical"))}
    if "z" in hits.columns:
        out |= {"z": round_up(F.col("z")), "intent": F.col("intent").cast("int")}
    return hits.withColumns(out).drop("semantic", "vector", "path_tokens")


def batch_top_k(queries: DataFrame, vectors_: DataFrame, k: int) -> DataFrame:
    """The k best of ``vectors_`` (id, vector) for each row of ``queries`` (query_id, query_vector).

    A stated query set against all rows, in blocks of QUERIES: the query vectors of a block go as one
    array to every batch of rows, each task keeps its k best a query, and a window finishes. A task
    holds one block, however many queries there are; each block is one pass over the rows.
    """
    asked = queries.select("query_id", "query_vector")
    blocks = max(1, -(-asked.count() // QUERIES))
    parts = [_block_top_k(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), vectors_, k) for b in range(blocks)]
    best = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _block_top_k(queries: DataFrame, vectors_: DataFrame, k: int) -> DataFrame:
    """query_id, id and score: at least the k best of each query of a block."""
    import numpy as np
    import pandas as pd

    rows = queries.orderBy("query_id").collect()
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    matrix = np.array([r["query_vector"] for r in rows], dtype=np.float64)

    def block(batches):
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            scores = (np.vstack(batch["vector"].to_numpy()).astype(np.float64) @ matrix.T).astype(np.float32)
            most = min(k, len(batch))
            own = batch["id"].to_numpy()
            for q in range(len(ids)):
                order = np.lexsort((own, -scores[:, q]))[:most]
                yield pd.DataFrame({"query_id": ids[q], "id": own[order], "score": scores[order, q]})

    return vectors_.select("id", "vector").mapInPandas(block, "query_id long, id long, score float")
