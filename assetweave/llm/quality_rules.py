"""Quality rules with thresholds that adapt per language and source, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, durable, null_key, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Counts of a text that the base rules and the adaptive rules go by.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: So many repeated words count for nothing: a short header or footer that stands twice.
ALLOWED_REPEATS = 32
#: Rules: name, value on an integer grid, highest grid cell, slack in cells added to the fence, whether low values fail too.
RULES = (
    ("symbols", "1000 * n_symbols div nullif(word_chars, 0)", 1000, 50, False),
    ("dup_lines", "1000 * n_dup_lines div nullif(n_words, 0)", 1000, 50, False),
    ("repeats", f"1000 * greatest(n_repeat_words - {ALLOWED_REPEATS}, 0) div nullif(n_words, 0)", 1000, 50, False),
    ("word_length", "100 * word_chars div nullif(n_words, 0)", 10000, 100, True),
)
#: A group's fences count as its number of documents, against its language's as so many; a language's likewise against those of all documents.
PRIOR = 100
#: Fences lie so many interquartile ranges beyond the quartiles.
FENCE = 6


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The five counts of each whole text; null text has no words.

    Words that stand in a window of eight words found twice or more: each window is one hash of its
    words' 64-bit hashes. Only where two are equal, (hash, place) pairs are sorted, places whose
    hash also stands beside them are kept, and the union of their windows is measured in order.
    """
    text = text_or_empty()
    lines = F.filter(F.split("aw_text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    base = docs.select(*keep, text.alias("aw_text"))
    parts = base.select(
        *keep,
        F.length(F.translate("aw_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("aw_text") - F.length(F.translate("aw_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("aw_lines"),
        F.transform(F.filter(F.split("aw_text", GAP), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("aw_words"),
    )
    n = F.size("aw_words")
    parts = parts.select(
        *keep,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("aw_lines") - F.size(F.array_distinct("aw_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("aw_words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("aw_windows"),
    )
    again = F.size(F.array_distinct("aw_windows")) < F.size("aw_windows")
    sorted_ = F.array_sort(F.transform("aw_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    parts = parts.withColumn("aw_sorted", F.when(again, sorted_)).drop("aw_windows")

    def twice(_: Column, j: Column) -> Column:
        pair = F.get("aw_sorted", j)
        return F.when(F.get("aw_sorted", j - 1)["h"].eqNullSafe(pair["h"]) | F.get("aw_sorted", j + 1)["h"].eqNullSafe(pair["h"]), pair["i"])

    parts = parts.withColumn("aw_places", F.array_sort(F.filter(F.transform("aw_sorted", twice), lambda p: p.isNotNull()))).drop("aw_sorted")
    gained = F.transform("aw_places", lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("aw_places", k - 1))))
    covered = F.aggregate(gained, F.lit(0).cast("long"), lambda total, x: total + x)
    return parts.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def sketches(counts: DataFrame) -> DataFrame:
    """Quantile sketches per language and source: how many documents lie in each cell of a fixed grid.

    Two sketches merge by adding counts, in any order, so they are the same at every rerun and
    partitioning, and a quantile is off by at most one cell. Aggregation is partial before the
    shuffle; a group has at most 1,001 (word length: 10,001) cells a rule, whatever its size.
    """
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.least(F.expr(value), F.lit(top).cast("long")).alias("cell"))
            for name, value, top, _, _ in RULES
        ]
    )
    told = counts.filter("n_words > 0").select("lang_key", "source_key", F.explode(cells).alias("x"))
    return told.groupBy("lang_key", "source_key", F.col("x.rule").alias("rule"), F.col("x.cell").alias("cell")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merged to ``keys``: a row per group with its number of documents and a low and a high fence a rule."""
    merged = sketch.groupBy(*keys, "rule", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule").orderBy("cell")
    merged = merged.withColumn("cum", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "rule")))
    quartiles = merged.groupBy(*keys, "rule").agg(
        F.max("all").alias("n_docs"),
        F.min(F.when(F.col("cum") * 4 >= F.col("all"), F.col("cell"))).alias("q1"),
        F.min(F.when(F.col("cum") * 4 >= F.col("all") * 3, F.col("cell"))).alias("q3"),
    )
    is_rule = {name: F.col("rule") == name for name, *_ in RULES}
    out = [F.max("n_docs").alias("n_docs")]
    for name, _, _, slack, low in RULES:
        spread = FENCE * (F.col("q3") - F.col("q1")) + slack
        out.append(F.max(F.when(is_rule[name], F.col("q3") + spread)).alias(f"{name}_high"))
        if low:
            out.append(F.max(F.when(is_rule[name], F.col("q1") - spread)).alias(f"{name}_low"))
    return quartiles.groupBy(*keys).agg(*out)


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """A row per language and source: its fences, drawn towards its language's, and those towards
    the fences of all documents, by numbers of documents against ``prior``."""
    names = [f"{name}_{end}" for name, _, _, _, low in RULES for end in (("high", "low") if low else ("high",))]

    def level(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[c for c in ("lang_key", "source_key") if c in df.columns], *[F.col(c).cast("double").alias(f"{tag}_{c}") for c in ("n_docs", *names)], F.lit(1).alias("aw_one"))

    def drawn(n: str, own: str, to: Column) -> Column:
        return (F.col(n) * F.col(own) + F.lit(float(prior)) * to) / (F.col(n) + F.lit(float(prior)))

    whole = sketch.withColumn("aw_all", F.lit(1))
    top = level(fences(whole, ["aw_all"]), "t")
    joined = level(fences(sketch, ["lang_key", "source_key"]), "s").join(level(fences(sketch, ["lang_key"]), "l").drop("aw_one"), "lang_key").join(top, "aw_one")
    return joined.select("lang_key", "source_key", *[drawn("s_n_docs", f"s_{c}", drawn("l_n_docs", f"l_{c}", F.col(f"t_{c}"))).alias(c) for c in names])


def judge(docs: DataFrame, *, prior: int = PRIOR) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for every document.

    A document fails the base rules with fewer than 20 words, or where over 30 % of its words stand
    in repeated windows. Of the others, those beyond a fence of their language and source go:
    share of symbols, of repeated lines and of repeated words beyond a few, and word length on both
    sides. The counts are checkpointed once; sketches and verdicts read them from there.

    Null or empty text has no words and fails the base rules; null languages and sources are groups
    of their own; repeated rows are judged alike; an empty table gives no rows.
    """
    counts = durable(text_counts(docs)).withColumns({"lang_key": null_key("lang"), "source_key": null_key("source")})
    limits = thresholds(sketches(counts), prior)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    beyond = F.lit(False)
    for name, value, _, _, low in RULES:
        beyond = beyond | F.coalesce(F.expr(value) > F.col(f"{name}_high"), F.lit(False))
        if low:
            beyond = beyond | F.coalesce(F.expr(value) < F.col(f"{name}_low"), F.lit(False))
    judged = counts.join(limits, ["lang_key", "source_key"], "left")
    return judged.select("doc_id", *COUNTS, base_failed.alias("base_failed"), (~base_failed & ~beyond).alias("kept"))


_RULE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, l, s, '{name}' AS rule, least({value.replace(' div ', ' // ')}, {top}) AS cell, {value.replace(' div ', ' // ')} AS raw FROM counts WHERE n_words > 0"
    for name, value, top, _, _ in RULES
)
_SLACK_SQL = "CASE rule " + " ".join(f"WHEN '{name}' THEN {slack}" for name, _, _, slack, _ in RULES) + " END"

ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '~') AS l, coalesce('=' || source, '~') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS words FROM docs),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY rid),
counts AS (
  SELECT w.rid, doc_id, l, s, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
cells AS ({_RULE_SQL.replace("SELECT doc_id", "SELECT rid, doc_id")}),
lev AS (
  SELECT l, s, rule, cell FROM cells UNION ALL SELECT l, NULL, rule, cell FROM cells UNION ALL SELECT NULL, NULL, rule, cell FROM cells),
q AS (
  SELECT l, s, rule, count(*) AS n_docs,
         quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM lev GROUP BY l, s, rule),
f AS (SELECT l, s, rule, n_docs::DOUBLE AS n, (q3 + {FENCE} * (q3 - q1) + {_SLACK_SQL})::DOUBLE AS hi, (q1 - {FENCE} * (q3 - q1) - {_SLACK_SQL})::DOUBLE AS lo FROM q),
out_ AS (
  SELECT rid, bool_or(raw > (a.n * a.hi + {PRIOR}::DOUBLE * ((b.n * b.hi + {PRIOR}::DOUBLE * c.hi) / (b.n + {PRIOR}::DOUBLE))) / (a.n + {PRIOR}::DOUBLE)
         OR (cells.rule = 'word_length' AND raw < (a.n * a.lo + {PRIOR}::DOUBLE * ((b.n * b.lo + {PRIOR}::DOUBLE * c.lo) / (b.n + {PRIOR}::DOUBLE))) / (a.n + {PRIOR}::DOUBLE))) AS beyond
  FROM cells JOIN f a ON a.l = cells.l AND a.s = cells.s AND a.rule = cells.rule
  JOIN f b ON b.l = cells.l AND b.s IS NULL AND b.rule = cells.rule
  JOIN f c ON c.l IS NULL AND c.s IS NULL AND c.rule = cells.rule GROUP BY rid),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM base LEFT JOIN out_ USING (rid)
"""
