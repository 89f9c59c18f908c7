"""The registered queries of the engine over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, vectors
from ..functions.numbers import average_kbps, decibels, hex_color, human_size, iso_time, round_up
from ..operators import catalog, changes, evaluation, ranking, search
from . import driver_tables as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL pieces that mirror the column functions.
def _tokens_sql(path: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({path}, '\.[^./]+$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _lexical_sql(words: str, tokens: list[str]) -> str:
    if not tokens:
        return "0::FLOAT"
    met = [f"(CASE WHEN len(list_filter({words}, lambda w: w = '{q}' OR (least(length(w), {len(q)}) >= 3 AND (starts_with(w, '{q}') OR starts_with('{q}', w))))) > 0 THEN 1 ELSE 0 END)" for q in tokens]
    return f"(({' + '.join(met)})::DOUBLE / {len(tokens)})::FLOAT"


_DOT = "list_dot_product(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {0}))::FLOAT"
_R4 = "floor(({0})::DOUBLE * 10000 + 0.5) / 10000"

QUERY = "green doc src10 for the sword icons"
TOKENS = ranking.query_tokens(QUERY)


@query(
    f"""WITH {t.VECTORS_SQL}, s AS (SELECT path, kind, {_DOT.format(0)} AS sc FROM vec WHERE vec_id <> 0),
    top AS (SELECT * FROM s ORDER BY sc DESC, path LIMIT 10)
    SELECT path, kind, {_R4.format("sc")} AS score, row_number() OVER (ORDER BY sc DESC, path) AS rank FROM top"""
)
def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like that of vec_id 0, itself left out."""
    v = t.vector_of(spark, sf_dir, 0)
    found = t.vectors_with_kind(spark, sf_dir).filter("vec_id <> 0")
    scored = found.select("path", "kind", vectors.dot(F.col("vector"), vectors.literal(v)).alias("score"))
    return search.ranked(search.top(scored, 10)).withColumn("score", round_up(F.col("score")))


_CAND = f"""{t.ASSETS_SQL}, {t.EMBEDDINGS_SQL},
cand AS (SELECT path, kind, size, {_DOT.format(0)} AS semantic, {_lexical_sql(_tokens_sql("path"), TOKENS)} AS lexical
         FROM assets JOIN emb USING (content_hash) WHERE state = 'indexed' AND space_id = 'visual' AND kind = 'image')"""
_SINGLE = (
    "WITH "
    + _CAND
    + f""", s AS (SELECT *, (semantic::DOUBLE + 0.05::DOUBLE * lexical::DOUBLE)::FLOAT AS sc FROM cand), top AS (SELECT * FROM s <where> ORDER BY sc DESC, path LIMIT 10)
    SELECT path, size, {_R4.format("semantic")} AS visual, {_R4.format("lexical")} AS lexical, {_R4.format("sc")} AS score,
    row_number() OVER (ORDER BY sc DESC, path) AS rank FROM top"""
)


def _single(spark: SparkSession, sf_dir: str, within: str) -> DataFrame:
    a, e = t.assets(spark, sf_dir), t.embeddings(spark, sf_dir)
    hits = search.search_by_text(a, e, QUERY, t.vector_of(spark, sf_dir, 0), kind="image", space_id="visual", within=within)
    return search.with_assets(search.evidence(hits, "visual"), a.select("path", "size")).select("path", "size", "visual", "lexical", "score", "rank")


@query(_SINGLE.replace("<where>", ""))
def search_single_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, "")


@query(_SINGLE.replace("<where>", "WHERE path = 'docs/en' OR starts_with(path, 'docs/en/')"))
def search_within_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, "docs/en")


def _fused_sql(text: str) -> str:
    wanted = ranking.intent_kind(text)
    lex = _lexical_sql(_tokens_sql("path"), ranking.query_tokens(text))
    return f"""WITH {t.ASSETS_SQL}, {t.EMBEDDINGS_SQL},
    cand AS (SELECT path, kind, CASE WHEN kind = 'audio' THEN {_DOT.format(1)} ELSE {_DOT.format(0)} END AS semantic, {lex} AS lexical
             FROM assets JOIN emb USING (content_hash) WHERE state = 'indexed' AND space_id = CASE WHEN kind = 'audio' THEN 'audio' ELSE 'visual' END),
    st AS (SELECT *, count(*) OVER w AS n, avg(semantic::DOUBLE) OVER w AS mu, stddev_pop(semantic::DOUBLE) OVER w AS sd FROM cand WINDOW w AS (PARTITION BY kind)),
    zs AS (SELECT *, (CASE WHEN n < 2 OR sd < 1e-9 THEN 0 ELSE (semantic::DOUBLE - mu) / sd * (n::DOUBLE / (n + 10)) END)::FLOAT AS z, {f"CASE WHEN kind = '{wanted}' THEN 1 ELSE 0 END" if wanted else "0"} AS intent FROM st),
    sc AS (SELECT *, (z::DOUBLE + lexical::DOUBLE + 4 * intent)::FLOAT AS sc FROM zs),
    top AS (SELECT * FROM sc ORDER BY sc DESC, path LIMIT 10)
    SELECT path, kind, {_R4.format("z")} AS z, {_R4.format("lexical")} AS lexical, intent::INT AS intent, {_R4.format("sc")} AS score,
    row_number() OVER (ORDER BY sc DESC, path) AS rank FROM top"""


def _fused(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    a, e = t.assets(spark, sf_dir), t.embeddings(spark, sf_dir)
    visual, audio = t.vector_of(spark, sf_dir, 0), t.vector_of(spark, sf_dir, 1)
    hits = search.search_across_kinds(a, e, text, [("image", "visual", visual), ("audio", "audio", audio), ("model3d", "visual", visual)])
    return search.evidence(hits, F.when(F.col("kind") == "audio", "audio").otherwise("visual")).select("path", "kind", "z", "lexical", "intent", "score", "rank")


@query(_fused_sql("docs en src10"))
def search_fused_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "docs en src10")


@query(_fused_sql("sound of src3"))
def search_fused_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "sound of src3")


@query(
    f"""WITH {t.ASSETS_SQL}, {t.EMBEDDINGS_SQL}, ref AS (SELECT path, content_hash FROM assets WHERE doc_id = 0),
    s AS (SELECT path, content_hash, {_DOT.format(0)} AS sc FROM assets JOIN emb USING (content_hash)
          WHERE state = 'indexed' AND space_id = 'visual' AND kind = 'model3d' AND path <> (SELECT path FROM ref)),
    top AS (SELECT * FROM s ORDER BY sc DESC, path LIMIT 10)
    SELECT path, {_R4.format("sc")} AS score, content_hash = (SELECT content_hash FROM ref) AS duplicate, row_number() OVER (ORDER BY sc DESC, path) AS rank FROM top"""
)
def cross_kind_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models like an image, by the image's stored vector, with duplicates flagged."""
    a, e = t.assets(spark, sf_dir), t.embeddings(spark, sf_dir)
    ref = a.filter("doc_id = 0").select("path", "content_hash").first()
    hits = search.search_by_vector(a, e, t.vector_of(spark, sf_dir, 0), kind="model3d", space_id="visual", exclude=ref["path"])
    return catalog.flag_duplicates(hits, ref["content_hash"]).select("path", round_up(F.col("score")).alias("score"), "duplicate", "rank")


LEXICAL_QUERY = "large brushed Steel pages for utm"


@query(f"WITH {t.PATHS_SQL} SELECT path, {_R4.format(_lexical_sql(_tokens_sql('path'), ranking.query_tokens(LEXICAL_QUERY)))} AS lexical FROM paths")
def lexical_score_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.image_paths(spark, sf_dir).select("path", round_up(ranking.lexical(ranking.query_tokens(LEXICAL_QUERY), paths.tokens(F.col("path")))).alias("lexical"))


@query(f"WITH {t.PATHS_SQL} SELECT path, array_to_string({_tokens_sql('path')}, ' ') AS tokens FROM paths")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.image_paths(spark, sf_dir).select("path", F.array_join(paths.tokens(F.col("path")), " ").alias("tokens"))


@query(rf"WITH {t.PATHS_SQL} SELECT path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) AS extension FROM paths")
def path_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.image_paths(spark, sf_dir).select("path", paths.extension(F.col("path")).alias("extension"))


@query(f"WITH {t.ASSETS_SQL} SELECT path FROM assets WHERE path = 'docs/en/src1' OR starts_with(path, 'docs/en/src1/')")
def path_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.assets(spark, sf_dir).filter(paths.is_within("docs/en/src1", F.col("path"))).select("path")


@query(f"WITH {t.ASSETS_SQL} SELECT kind, count(*) AS n FROM assets WHERE state = 'indexed' GROUP BY kind")
def count_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_by_kind(t.assets(spark, sf_dir))


@query(f"WITH {t.ASSETS_SQL} SELECT state, count(*) AS n FROM assets GROUP BY state")
def count_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_by_state(t.assets(spark, sf_dir))


@query(f"WITH {t.ASSETS_SQL} SELECT count(*) AS n FROM assets WHERE state = 'indexed'")
def total_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.total_assets(t.assets(spark, sf_dir))


@query(f"WITH {t.ASSETS_SQL} SELECT processor_id, processor_version, count(*) AS n FROM assets GROUP BY ALL")
def processor_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.processor_versions(t.assets(spark, sf_dir))


@query(f"WITH {t.EMBEDDINGS_SQL} SELECT space_id, dims::INT AS dims, count(*) AS n FROM emb GROUP BY ALL")
def embedding_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.embedding_spaces(t.embeddings(spark, sf_dir))


_MISSING = f"""WITH {t.ASSETS_SQL}, {t.EMBEDDINGS_SQL},
m AS (SELECT kind, count(*) AS n FROM assets a WHERE state = 'indexed' AND NOT EXISTS (
  SELECT 1 FROM emb e WHERE e.content_hash = a.content_hash AND e.space_id = CASE WHEN a.kind = 'audio' THEN 'audio' ELSE 'visual' END) GROUP BY kind) """


@query(_MISSING + "SELECT kind, n FROM m")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing_embeddings(t.assets(spark, sf_dir), t.embeddings(spark, sf_dir), t.SPACES)


@query(_MISSING + "SELECT coalesce(sum(n), 0)::BIGINT AS n FROM m")
def total_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.total_missing(t.assets(spark, sf_dir), t.embeddings(spark, sf_dir), t.SPACES)


@query(f"""WITH {t.ASSETS_SQL}, {t.EMBEDDINGS_SQL} SELECT content_hash, space_id FROM emb e WHERE NOT EXISTS
(SELECT 1 FROM assets a WHERE a.content_hash = e.content_hash AND a.doc_id % 17 <> 0)""")
def orphan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that nothing uses once the removed assets are gone."""
    left = t.assets(spark, sf_dir).filter("doc_id % 17 <> 0")
    return catalog.orphan_embeddings(t.embeddings(spark, sf_dir), left).select("content_hash", "space_id")


@query(f"WITH {t.ASSETS_SQL} SELECT path, error FROM assets WHERE state = 'failed' ORDER BY path LIMIT 50")
def failed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.failed_assets(t.assets(spark, sf_dir))


@query(f"WITH {t.ASSETS_SQL} SELECT path, content_hash, copies FROM (SELECT *, count(*) OVER (PARTITION BY content_hash) AS copies FROM assets) WHERE copies > 1")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates(t.assets(spark, sf_dir)).select("path", "content_hash", "copies")


@query(f"WITH {t.ASSETS_SQL} SELECT DISTINCT content_hash FROM assets WHERE content_hash <> ''")
def distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_hashes(t.assets(spark, sf_dir))


_ROOTS = ("docs/en", "docs/fr", "new")
_UNREADABLE = ("docs/en/src3",)
_IN_ROOTS = "(" + " OR ".join(f"starts_with(path, '{r}/')" for r in _ROOTS) + ")"
_DIFF = f"""WITH {t.ASSETS_SQL}, {t.LISTING_SQL},
d AS (SELECT coalesce(l.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added'
  WHEN l.path IS NULL THEN CASE WHEN NOT {_IN_ROOTS.replace("path", "a.path")} <unreadable> THEN 'kept' ELSE 'removed' END
  WHEN l.size = a.size AND l.mtime_ms = a.mtime_ms THEN 'unchanged' ELSE 'modified' END AS change
  FROM listing l FULL OUTER JOIN assets a ON a.path = l.path) """


@query(_DIFF.replace("<unreadable>", "OR starts_with(a.path, 'docs/en/src3/')") + "SELECT path, change FROM d")
def change_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(t.listing(spark, sf_dir), t.assets(spark, sf_dir), _ROOTS, _UNREADABLE)


@query(
    _DIFF.replace("<unreadable>", "")
    + """SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified,
    count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM d"""
)
def staleness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.staleness(t.listing(spark, sf_dir), t.assets(spark, sf_dir), _ROOTS)


@query(f"""WITH {t.ASSETS_SQL}, {t.LISTING_SQL} SELECT path FROM assets WHERE path NOT IN (SELECT path FROM listing) AND {_IN_ROOTS} AND NOT starts_with(path, 'docs/en/src3/')""")
def removed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.removed(t.listing(spark, sf_dir), t.assets(spark, sf_dir), _ROOTS, _UNREADABLE)


@query(f"WITH {t.ASSETS_SQL}, {t.LISTING_SQL} SELECT path FROM listing WHERE path NOT IN (SELECT path FROM assets)")
def added_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.added(t.listing(spark, sf_dir), t.assets(spark, sf_dir))


_CHANNELS = {"image": ["visual"], "audio": ["audio"], "model3d": ["visual"]}
_CHANNEL_SPACES = {"visual": "visual", "audio": "audio"}
_COMPLETE = f"""WITH {t.ASSETS_SQL}, {t.EMBEDDINGS_SQL}, {t.LISTING_SQL},
comp AS (SELECT path, EXISTS (SELECT 1 FROM emb e WHERE e.content_hash = a.content_hash AND e.space_id = CASE WHEN a.kind = 'audio' THEN 'audio' ELSE 'visual' END
  AND e.input_version = a.processor_id || '@' || a.processor_version) AS complete FROM assets a),
plan AS (SELECT l.path, CASE WHEN l.size = a.size AND l.mtime_ms = a.mtime_ms AND l.processor_id = a.processor_id AND l.processor_version = a.processor_version
  AND (a.state = 'failed' OR c.complete) THEN 'unchanged' ELSE 'work' END AS plan
  FROM listing l LEFT JOIN assets a ON a.path = l.path LEFT JOIN comp c ON c.path = l.path) """


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.assets(spark, sf_dir)
    ready = changes.complete(a, t.embeddings(spark, sf_dir), _CHANNEL_SPACES, _CHANNELS)
    return changes.outcomes(t.listing(spark, sf_dir), a, ready)


@query(_COMPLETE + "SELECT path, complete FROM comp")
def embedding_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.complete(t.assets(spark, sf_dir), t.embeddings(spark, sf_dir), _CHANNEL_SPACES, _CHANNELS)


@query(_COMPLETE + "SELECT path, plan FROM plan")
def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("path", "plan")


@query(
    _COMPLETE
    + """, r AS (SELECT plan AS outcome FROM plan UNION ALL SELECT 'removed' FROM assets WHERE path NOT IN (SELECT path FROM listing))
    SELECT count(*) FILTER (outcome <> 'removed') AS supported, count(*) FILTER (outcome = 'work') AS indexed, count(*) FILTER (outcome = 'unchanged') AS unchanged,
    count(*) FILTER (outcome = 'removed') AS removed, 0::BIGINT AS failed, 0::BIGINT AS reused_embeddings FROM r"""
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _plan(spark, sf_dir).select("path", F.when(F.col("plan") == "work", "indexed").otherwise("unchanged").alias("outcome"))
    gone = changes.removed(t.listing(spark, sf_dir), t.assets(spark, sf_dir)).select("path", F.lit("removed").alias("outcome"))
    return changes.run_stats(done.unionByName(gone))


@query(f"""WITH {t.ASSETS_SQL}, {t.EMBEDDINGS_SQL} SELECT path, path <> min(path) OVER (PARTITION BY content_hash)
  OR EXISTS (SELECT 1 FROM emb e WHERE e.content_hash = a.content_hash AND space_id = 'visual') AS reused FROM assets a WHERE kind <> 'audio'""")
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.reuse(t.assets(spark, sf_dir).filter("kind <> 'audio'"), t.embeddings(spark, sf_dir), "visual")


@query("""SELECT space_id, text, used_at FROM (SELECT event_type AS space_id, user_id::VARCHAR AS text, max(epoch_us(ts) // 1000) AS used_at FROM events GROUP BY ALL)
  ORDER BY used_at DESC, space_id, text LIMIT 1000""")
def query_cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = t.read(spark, sf_dir, "events").select(F.col("event_type").alias("space_id"), F.col("user_id").cast("string").alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("used_at"))
    return catalog.latest_queries(used, 1000)


@query(r"""WITH r AS (SELECT DISTINCT unnest([regexp_extract(url, '://([^?#]*[^/?#])', 1), regexp_extract(url, '://([^?#]*)/', 1)]) AS path FROM pages)
  SELECT path FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.path <> r.path AND (o.path = '' OR starts_with(r.path, o.path || '/')))""")
def roots_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.read(spark, sf_dir, "pages")
    both = F.array(F.regexp_extract("url", r"://([^?#]*[^/?#])", 1), F.regexp_extract("url", "://([^?#]*)/", 1))
    return catalog.fold_roots(pages.select(F.explode(both).alias("path")))


@query(
    """WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) * count(*) AS s FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i),
    n AS (SELECT label, sqrt(sum(s * s)) AS n FROM e GROUP BY label) SELECT label, i::INT AS d, floor(s / n * 10000 + 0.5) / 10000 AS x FROM e JOIN n USING (label)"""
)
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.mean_vector(t.vectors_with_kind(spark, sf_dir), ["label"])
    return means.select("label", F.posexplode("vector").alias("d", "x")).select("label", (F.col("d") + 1).alias("d"), round_up(F.col("x")).alias("x"))


@query(
    """SELECT vec_id, floor(sqrt(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) ** 2))) * 10000 + 0.5) / 10000 AS norm,
    floor(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2))) * 10000 + 0.5) / 10000 AS first FROM embeddings"""
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = t.vectors_with_kind(spark, sf_dir).select("vec_id", F.transform("vector", lambda x: (x.cast("double") * 3)).alias("vector"))
    return longer.select("vec_id", round_up(vectors.norm(F.col("vector"))).alias("norm"), round_up(F.get(vectors.l2_normalize(F.col("vector")), 0)).alias("first"))


_HITS = """WITH q AS (SELECT vec_id AS query_id, label AS ql, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, ql, e.label, list_dot_product(embedding::DOUBLE[], qv)::FLOAT AS sc, vec_id FROM q JOIN embeddings e ON e.vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, vec_id) AS rank FROM s),
f AS (SELECT query_id, min(rank) FILTER (label = ql AND rank <= 10) AS first_rank FROM r GROUP BY query_id) """


def _first_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.vectors_with_kind(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "vector")
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("asked"), F.col("vector").alias("query_vector"))
    hits = search.batch_top_k(q.select("query_id", "query_vector"), v, 11).filter("query_id <> id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 10")
    told = hits.join(v.select("id", "label"), "id").join(q.select("query_id", "asked"), "query_id")
    return evaluation.first_relevant(told.withColumn("relevant", F.col("label") == F.col("asked")), q)


@query(_HITS + "SELECT avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0 END) AS hit_at_1, avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0 END) AS hit_at_5, avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0 END) AS hit_at_10 FROM f")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_at_k(_first_relevant(spark, sf_dir))


@query(_HITS + "SELECT floor(avg(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END) * 1000 + 0.5) / 1000 AS mrr_at_10 FROM f")
def mrr_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mrr_at_10(_first_relevant(spark, sf_dir))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def metadata_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.metadata_field(t.read(spark, sf_dir, "events").select("event_id", "props"), "props", "k", "bigint").select("event_id", "k")


@query(
    _COMPLETE
    + """, both_ AS (SELECT coalesce(l.path, a.path) AS path, l.path IS NOT NULL AS ex, a.path IS NOT NULL AS st, a.state, l.size = a.size AND l.mtime_ms = a.mtime_ms AS same,
    coalesce(c.complete, false) AS vec FROM listing l FULL OUTER JOIN assets a ON a.path = l.path LEFT JOIN comp c ON c.path = a.path)
    SELECT path, CASE WHEN NOT st THEN 'not-indexed' WHEN NOT ex THEN 'missing' WHEN state = 'failed' THEN 'failed' WHEN NOT same OR NOT vec THEN 'stale' ELSE 'indexed' END AS state FROM both_"""
)
def inspect_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.assets(spark, sf_dir)
    there = t.listing(spark, sf_dir).select("path", F.col("size").alias("l_size"), F.col("mtime_ms").alias("l_mtime"), F.lit(True).alias("l"))
    known = a.select("path", "size", "mtime_ms", F.col("state").alias("s_state"), F.lit(True).alias("s"))
    ready = changes.complete(a, t.embeddings(spark, sf_dir), _CHANNEL_SPACES, _CHANNELS)
    both = there.join(known, "path", "full_outer").join(ready, "path", "left")
    return changes.inspect_state(
        both.select(
            "path",
            F.col("l").isNotNull().alias("exists"),
            F.lit(True).alias("supported"),
            F.col("s").isNotNull().alias("stored"),
            F.coalesce(F.col("s_state") == "failed", F.lit(False)).alias("failed"),
            F.coalesce((F.col("l_size") == F.col("size")) & (F.col("l_mtime") == F.col("mtime_ms")), F.lit(False)).alias("stat_same"),
            F.lit(True).alias("version_same"),
            F.coalesce("complete", F.lit(False)).alias("has_vector"),
        )
    ).select("path", "state")


@query(f"""WITH {t.ASSETS_SQL}, {t.LISTING_SQL} SELECT path, size, mtime_ms FROM listing UNION ALL SELECT path, size, mtime_ms FROM assets WHERE path NOT IN (SELECT path FROM listing)""")
def upsert_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import upsert

    columns = ["path", "size", "mtime_ms"]
    return upsert(t.assets(spark, sf_dir).select(*columns), t.listing(spark, sf_dir).select(*columns), ["path"])


@query(f"""WITH {t.ASSETS_SQL}, {t.LISTING_SQL} SELECT a.path, coalesce(l.size, a.size) AS size, coalesce(l.mtime_ms, a.mtime_ms) AS mtime_ms, a.content_hash FROM assets a LEFT JOIN listing l ON l.path = a.path""")
def touch_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import touch

    return touch(t.assets(spark, sf_dir).select("path", "size", "mtime_ms", "content_hash"), t.listing(spark, sf_dir).select("path", "size", "mtime_ms"))


@query(f"WITH {t.ASSETS_SQL} SELECT path, strftime(make_timestamp(mtime_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS modified FROM assets")
def modified_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.assets(spark, sf_dir).select("path", iso_time(F.col("mtime_ms")).alias("modified"))


@query("SELECT event_id, CASE WHEN value > 0 THEN floor(20 * log10(value) * 10 + 0.5) / 10 END AS db FROM events")
def level_decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "events").select("event_id", decibels(F.col("value")).alias("db"))


@query(f"""WITH {t.ASSETS_SQL} SELECT DISTINCT content_hash, substr(content_hash, 1, 16) || '.txt' AS name, labels FROM (
  SELECT content_hash, array_to_string(list_sort(list(DISTINCT path)), ' ') AS labels FROM assets GROUP BY content_hash)""")
def blind_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.assets(spark, sf_dir).select("content_hash", "extension", F.col("path").alias("label"))
    return catalog.blind_names(files).withColumn("labels", F.array_join("labels", " "))


@query(f"""WITH {t.VECTORS_SQL}, s AS (SELECT kind, path, {_DOT.format(0)} AS sc FROM vec), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sc DESC, path) AS rank FROM s)
  SELECT kind, path, {_R4.format("sc")} AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def top_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.vector_of(spark, sf_dir, 0)
    scored = t.vectors_with_kind(spark, sf_dir).select("kind", "path", vectors.dot(F.col("vector"), vectors.literal(v)).alias("score"))
    return catalog.largest_per_kind(scored, 5).withColumn("score", round_up(F.col("score")))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_dot_product(embedding::DOUBLE[], qv)::FLOAT AS sc FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM s)
SELECT query_id, id, floor(sc::DOUBLE * 10000 + 0.5) / 10000 AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query against all."""
    v = t.vectors_with_kind(spark, sf_dir).select(F.col("vec_id").alias("id"), "vector")
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.batch_top_k(q, v, 10).withColumn("score", round_up(F.col("score")))


_BYTES_SQL = "(n_chars * (doc_id + 1))"


@query(f"""SELECT doc_id, CASE WHEN {_BYTES_SQL} < 1024 THEN {_BYTES_SQL} || ' B' WHEN {_BYTES_SQL} < 1048576 THEN printf('%.1f', floor({_BYTES_SQL} / 1024 * 10 + 0.5) / 10) || ' KB'
  ELSE printf('%.1f', floor({_BYTES_SQL} / 1048576 * 10 + 0.5) / 10) || ' MB' END AS size FROM documents""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = F.col("n_chars") * (F.col("doc_id") + 1)
    return t.read(spark, sf_dir, "documents").select("doc_id", human_size(n_bytes).alias("size"))


@query("SELECT c_custkey, printf('#%02x%02x%02x', (c_custkey % 256)::INT, (c_custkey * 7 % 256)::INT, (c_custkey * 31 % 256)::INT) AS color FROM customer")
def hex_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda by: (F.col("c_custkey") * by % 256).cast("int")
    return t.read(spark, sf_dir, "customer").select("c_custkey", hex_color(part(1), part(7), part(31)).alias("color"))


@query("SELECT o_orderkey, floor(floor(o_totalprice) * 8 / (o_orderkey % 300 + 1) / 1000 + 0.5)::INT AS kbps FROM orders")
def audio_bitrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "orders").select("o_orderkey", average_kbps(F.floor("o_totalprice").cast("double"), F.col("o_orderkey") % 300 + 1).alias("kbps"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 3) THEN 'audio' ELSE 'visual' END AS channel FROM events""")
def space_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = F.array(*[F.lit(x) for x in ("clap", "siglip", "clip", "test-audio", "test-hash")])
    space = F.concat_ws(":", F.element_at(families, (F.col("event_id") % 5 + 1).cast("int")), "event_type", F.lit("r1"))
    return t.read(spark, sf_dir, "events").select("event_id", paths.channel_of_space(space).alias("channel"))


@query(f"WITH {t.ASSETS_SQL}, c AS (SELECT kind, count(*) AS n FROM assets WHERE state = 'indexed' GROUP BY kind) SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) AS types FROM c")
def kind_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = catalog.counts_record(catalog.count_by_kind(t.assets(spark, sf_dir)))
    entries = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return record.select(F.array_join(entries, ",").alias("types"))


@query(f"""WITH {t.ASSETS_SQL} SELECT path, CASE kind
  WHEN 'image' THEN size || 'x' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' transparent' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' animated' ELSE '' END
  WHEN 'audio' THEN printf('%.1f', size / 10) || 's' || CASE doc_id % 4 WHEN 1 THEN ' mono' WHEN 2 THEN ' stereo' ELSE '' END
  ELSE size || ' triangles' || CASE WHEN doc_id % 5 = 0 THEN ' animated' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' rigged' ELSE '' END END AS summary FROM assets""")
def asset_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("size")
    fields = {"width": n, "height": i, "hasTransparency": i % 2 == 0, "animated": i % 5 == 0, "durationSeconds": n / 10, "channels": i % 4, "triangleCount": n, "hasAnimations": i % 5 == 0, "hasSkeleton": i % 2 == 0}
    metadata = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    return catalog.summary(t.assets(spark, sf_dir).withColumn("metadata", metadata)).select("path", "summary")


def _path_of(assets: DataFrame, doc_id: int) -> str:
    """The path to look up."""
    return assets.filter(F.col("doc_id") == doc_id).select("path").first()[0]


@query(f"WITH {t.ASSETS_SQL} SELECT doc_id, path, size, state FROM assets WHERE path = (SELECT path FROM assets WHERE doc_id = 5)")
def asset_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.assets(spark, sf_dir)
    return catalog.by_path(a, _path_of(a, 5)).select("doc_id", "path", "size", "state")


@query(f"WITH {t.ASSETS_SQL} SELECT doc_id, path FROM assets WHERE lower(nfc_normalize(path)) = (SELECT lower(nfc_normalize(path)) FROM assets WHERE doc_id = 5)")
def asset_by_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path typed in capitals finds the asset."""
    a = t.assets(spark, sf_dir)
    return catalog.by_match_key(a.withColumn("match_key", paths.match_key(F.col("path"))), _path_of(a, 5).upper()).select("doc_id", "path")


@query(f"WITH {t.ASSETS_SQL} SELECT path, size, mtime_ms, content_hash, processor_id, processor_version, state FROM assets")
def change_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stats_for_changes(t.assets(spark, sf_dir))


@query(f"WITH {t.EMBEDDINGS_SQL} SELECT content_hash, space_id, input_version, dims FROM emb WHERE content_hash = (SELECT sha256(text) FROM documents WHERE doc_id = 6) AND space_id = 'visual'")
def embeddings_of_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    content_hash = t.read(spark, sf_dir, "documents").filter("doc_id = 6").select(F.sha2("text", 256)).first()[0]
    return catalog.embeddings_of(t.embeddings(spark, sf_dir), content_hash, "visual").drop("vector")


@query("SELECT event_type AS space, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def models_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.one_space_each(t.read(spark, sf_dir, "events").select(F.col("event_type").alias("space"), F.col("event_id").alias("at"), "user_id"))


@query(f"""WITH {t.VECTORS_SQL}, m AS (SELECT path, CASE WHEN vec_id % 7 = 3 THEN 32 ELSE len(vector) END AS dims FROM vec)
  SELECT path, dims::INT AS dims FROM m WHERE dims = (SELECT dims FROM m ORDER BY path LIMIT 1)""")
def mixed_dims_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of vectors of two lengths those of the first path's stay."""
    whole = t.vectors_with_kind(spark, sf_dir)
    mixed = whole.withColumn("vector", F.when(F.col("vec_id") % 7 == 3, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    return search.same_dims(mixed, search.first_dims(mixed)).select("path", F.size("vector").alias("dims"))


@query(f"WITH {t.ASSETS_SQL} SELECT path, CASE WHEN kind = 'audio' THEN 'audio+lexical/v1' ELSE 'visual+lexical/v1' END AS ranking FROM assets")
def ranking_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("kind") == "audio", ranking.single_ranking("audio")).otherwise(ranking.single_ranking("visual"))
    return t.assets(spark, sf_dir).select("path", named.alias("ranking"))
