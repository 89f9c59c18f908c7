"""Ranking: lexical scores, z-scores per kind, fusion and intent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Fixed values of the ranking.
LEXICAL_WEIGHT = 0.05
FUSED_LEXICAL_WEIGHT = 1
INTENT_WEIGHT = 4
SHRINK = 10
FLAT = 1e-9
STOPWORDS = ("a", "an", "the", "of", "for", "and", "or", "with", "to", "in", "on", "that", "this", "is", "are", "looks", "like", "some", "any", "find", "image", "picture", "asset", "assets", "file", "sound", "audio")
INTENT_WORDS = {
    "audio": ("sound", "sounds", "sfx", "audio", "music", "song", "track", "ambience", "ambient", "noise", "voice", "jingle"),
    "image": ("icon", "icons", "sprite", "sprites", "image", "images", "picture", "texture", "textures", "tile", "tiles", "illustration", "portrait"),
    "model3d": ("3d", "model", "models", "mesh", "meshes", "glb", "gltf", "obj", "fbx", "prop", "props"),
}
FUSED_RANKING = "zscore-fusion/v2"


def single_ranking(channel: str) -> str:
    return f"{channel}+lexical/v1"


def query_tokens(query: str) -> list[str]:
    """Words of a query that count: two characters or more, no stopwords, each once. Queries go
    through the path rules, so text after a last dot is lost and 3D falls into 3 and d."""
    return list(dict.fromkeys(t for t in paths.tokens_of(query) if len(t) >= 2 and t not in STOPWORDS))


def query_tokens_column(query: Column) -> Column:
    words = F.filter(paths.tokens(query), lambda t: F.length(t) >= 2)
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def intent_kind(query: str) -> str | None:
    """The kind that the words of a query ask for, if they ask for exactly one."""
    said = set(paths.tokens_of(query))
    asked = [kind for kind, words in INTENT_WORDS.items() if said.intersection(words)]
    return asked[0] if len(asked) == 1 else None


def lexical(query: Sequence[str] | Column, words: Column) -> Column:
    """Share of query tokens that equal a word of the path, or start it, or are started by it
    (three characters at least on both sides). Zero for no tokens."""
    if not isinstance(query, Column):
        query = F.array(*[F.lit(t) for t in query]) if query else F.array().cast("array<string>")

    def met(token: Column) -> Column:
        def by(word: Column) -> Column:
            long_enough = F.least(F.length(token), F.length(word)) >= 3
            return (word == token) | (long_enough & (F.startswith(word, token) | F.startswith(token, word)))

        return F.exists(words, by)

    n = F.size(query)
    return F.when(n > 0, F.size(F.filter(query, met)) / n).otherwise(F.lit(0.0)).cast("float")


def with_z(pool: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """Add z: the standard score among the rows of equal keys, shrunk by n / (n + 10), as small
    populations say little. Zero for fewer than two rows or no spread. The deviation is that of the
    population.

    The statistics are aggregated where the rows lie and come back as one row for each of the keys,
    of which a search has as many as kinds, so they are broadcast and no row of the pool moves.
    """
    x = F.col(score).cast("double")
    told = pool.groupBy(*keys).agg(F.count(x).alias("aw_n"), F.avg(x).alias("aw_mean"), F.stddev_pop(x).alias("aw_sd"))
    n, mean, sd = F.col("aw_n"), F.col("aw_mean"), F.col("aw_sd")
    z = F.when((n < 2) | (sd < FLAT), F.lit(0.0)).otherwise((x - mean) / sd * (n / (n + SHRINK))).cast("float")
    return pool.join(F.broadcast(told), list(keys)).withColumn("z", z).drop("aw_n", "aw_mean", "aw_sd")


def single_score(semantic: Column, lexical_: Column) -> Column:
    return (semantic.cast("double") + LEXICAL_WEIGHT * lexical_.cast("double")).cast("float")


def fused_score(z: Column, lexical_: Column, intent: Column) -> Column:
    return (z.cast("double") + FUSED_LEXICAL_WEIGHT * lexical_.cast("double") + INTENT_WEIGHT * intent.cast("double")).cast("float")
