"""I-Match fingerprints with several randomised lexicons, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, durable, text_or_empty

#: A term's document frequency, as a share of all documents, lies in this band (and is 2 at least).
LOW, HIGH = 0.002, 0.1
#: Lexicons of a level; one of level k keeps a term with probability 2 ** -k.
LEXICONS = 16
#: Hashes of a text: those of its own level's lexicons and of the next.
PLACES = 2 * LEXICONS
#: Added to the highest level of a term above the band.
ABOVE = 16
#: A text is poor in band terms where it has over so many times as many terms above the band.
POOR = 4
#: Cells of the table by which terms are looked up.
TABLE = 1 << 15
#: Documents that are put in order together, and most ranges of doc_id.
PER_RANGE, MOST_RANGES = 1000, 1 << 16


def terms(text: Column) -> Column:
    """Distinct terms: words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), GAP), lambda t: t != ""))


def lexicon(docs: DataFrame, n_docs: int, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term, levels, top: the terms of the band and above, counted over all documents, and the lexicons they are in.

    Documents hold ``low`` * n_docs times such a term at least, so there are at most
    (mean distinct terms of a document) / ``low`` of them, however many documents there are. For
    each of 16 lexicons ``levels`` has four bits, the highest level at which it keeps the term
    (leading zeros of 16 random bits); ``top`` is the highest of them, and ABOVE more for a term
    above the band.
    """
    # The outer form, as for the inner one Spark would add a filter that finds the terms twice more.
    counted = docs.select(F.explode_outer(terms(text_or_empty())).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    band = counted.filter(F.col("df") >= max(2.0, low * n_docs))
    above = F.when(F.col("df") > max(2.0, high * n_docs), F.lit(ABOVE)).otherwise(F.lit(0))
    level = [16 - F.length(F.bin(F.conv(F.substring(F.sha2("term", 256), 4 * i + 1, 4), 16, 10).cast("long"))) for i in range(LEXICONS)]
    levels = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(x.cast("long"), 4 * i) for i, x in enumerate(level)])
    # No filter on these here: they depend on the term alone, so it would move below the count.
    return band.select("term", levels.alias("levels"), (F.greatest(*level) + above).alias("top"))


def lookup_table(lex: DataFrame) -> DataFrame:
    """One row: an array of cells, each an array of (hash of a term, levels, top). Its size is that of the band."""
    cells = lex.withColumn("h", F.xxhash64("term")).groupBy(F.pmod("h", F.lit(TABLE)).alias("cell")).agg(F.collect_list(F.struct("h", "levels", "top")).alias("held"))
    every = lex.sparkSession.range(TABLE).withColumnRenamed("id", "cell").join(cells, "cell", "left")
    every = every.select("cell", F.coalesce("held", F.array().cast("array<struct<h:bigint,levels:bigint,top:int>>")).alias("held"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "held"))), lambda x: x["held"]).alias("aw_table"))


def with_kept(df: DataFrame, text: str, table: DataFrame) -> DataFrame:
    """Add aw_kept, the text's terms (with levels and top) that the table holds.

    The table is an uncorrelated scalar subquery that appears once in the expression, so each
    executor holds it once and no row carries it.
    """

    def known(held: Column):
        def one(term: Column) -> Column:
            h = F.xxhash64(term)
            found = F.get(F.filter(F.get(held, F.pmod(h, F.lit(TABLE)).cast("int")), lambda e: e["h"] == h), 0)
            return F.struct(term.alias("term"), found["levels"].alias("levels"), found["top"].alias("top"))

        return one

    columns = df.columns
    kept = df.select(*columns, terms(F.col(text)).alias("aw_terms"), table.scalar().alias("aw_table"))
    return kept.select(
        *columns,
        F.get(F.transform(F.array("aw_table"), lambda held: F.filter(F.transform("aw_terms", known(held)), lambda x: x["top"].isNotNull())), F.lit(0)).alias("aw_kept"),
    )


def poor() -> Column:
    """Whether aw_kept has few terms of the band for its terms above the band."""
    n_above = F.size(F.filter("aw_kept", lambda x: x["top"] >= ABOVE))
    return n_above > POOR * (F.size("aw_kept") - n_above)


def with_fingerprint(df: DataFrame, text: str, out: str, table: DataFrame, wide: Column) -> DataFrame:
    """Add ``out``, an array of PLACES hashes ("" where the text has no term of that lexicon), and aw_wide.

    Where ``wide`` (of columns of df and aw_kept) is true, the lexicons hold the terms above the
    band too. A text of n known terms has level log2(n), rounded down, so a lexicon of its level keeps
    one or two of its terms; the hashes of even levels come first, so that texts of neighbouring
    levels have one level in common. A text without a term in any of its lexicons has its own hash
    in the last place, so that only equal texts of that sort agree.
    """
    columns = [c for c in df.columns if c != "aw_wide"]
    kept = with_kept(df, text, table).select(*df.columns, "aw_kept", wide.alias("aw_is_wide"))
    kept = kept.select(*columns, F.col("aw_is_wide").alias("aw_wide"), F.filter("aw_kept", lambda x: F.col("aw_is_wide") | (x["top"] < ABOVE)).alias("aw_kept"))
    level = F.length(F.bin(F.size("aw_kept").cast("long"))) - 1
    few = F.array_sort(F.filter("aw_kept", lambda x: x["top"] % ABOVE >= F.col("aw_level")))
    kept = kept.select(*columns, "aw_wide", "aw_kept", level.alias("aw_level")).select(*columns, "aw_wide", "aw_level", few.alias("aw_few"))

    def hashed(up: int) -> Column:
        at = F.col("aw_level") + up

        def one(i: int) -> Column:
            mine = F.filter("aw_few", lambda x: F.shiftright(x["levels"], 4 * i).bitwiseAND(15) >= at)
            joined = F.array_join(F.transform(mine, lambda x: x["term"]), " ")
            return F.when(joined != "", F.substring(F.md5(F.concat(at.cast("string"), F.lit(" "), joined)), 1, 16)).otherwise(F.lit(""))

        return F.array(*[one(i) for i in range(LEXICONS)])

    kept = kept.select(*columns, "aw_wide", "aw_level", hashed(0).alias("aw_here"), hashed(1).alias("aw_next_level"))
    marks = F.when(F.col("aw_level") % 2 == 0, F.concat("aw_here", "aw_next_level")).otherwise(F.concat("aw_next_level", "aw_here"))
    alone = F.concat(F.array_repeat(F.lit(""), PLACES - 1), F.array(F.substring(F.md5(F.col(text)), 1, 16)))
    return kept.select(*columns, "aw_wide", marks.alias("aw_marks"), alone.alias("aw_alone")).select(*columns, "aw_wide", F.when(F.array_max("aw_marks") != "", F.col("aw_marks")).otherwise(F.col("aw_alone")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Of the lexicons that either text has terms of, the share in which the hashes agree."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") | (y != "")), lambda t: t))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") & (x == y)), lambda t: t))
    return F.when(either > 0, same / either).otherwise(F.lit(0.0))


def _ranges(docs: DataFrame) -> tuple[int, list[int]]:
    """The number of documents and the first ids of ranges of about PER_RANGE documents.

    Ranges only deal the work; percentile_approx gives ids that exist, so each range has its first.
    """
    n = docs.count()
    parts = min(MOST_RANGES, max(1, n // PER_RANGE))
    got = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], max(20000, 10 * parts)).alias("at")).first()
    return n, sorted({got["low"], *(got["at"] or ())} - {None}) if got["low"] is not None else []


def with_next(df: DataFrame, starts: list[int], carried: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: that of the next row by (doc_id, text), after the last the first.

    Rows are dealt by range of doc_id; the rows that begin a range are copied to the end of the
    range before it, and those that begin the first to the end of the last. Null ids come last.
    """
    columns = df.columns
    if starts:
        bounds = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
        last = len(starts) - 1
        index = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at)) - 1
        place = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.greatest(index, F.lit(0)))
        df = df.withColumn("aw_at", place)
        begins = F.get(bounds, F.col("aw_at")) == F.col("doc_id")
        before = F.when(F.col("aw_at") > 0, F.col("aw_at") - 1).otherwise(F.lit(last))
        own = F.struct(F.col("aw_at").alias("at"), F.lit(0).alias("copy"))
        copy = F.struct(before.alias("at"), F.lit(1).alias("copy"))
        df = df.withColumn("aw_to", F.explode(F.when(begins, F.array(own, copy)).otherwise(F.array(own)))).select(*columns, "aw_to.at", "aw_to.copy")
    else:
        df = df.select(*columns, F.lit(0).alias("at"), F.lit(0).alias("copy"))
    w = Window.partitionBy("at").orderBy("copy", F.col("doc_id").asc_nulls_last(), "text")
    return df.select(*columns, "copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter("copy = 0").drop("copy")


def fingerprints(docs: DataFrame, *, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose end is the next document's begin.

    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (the hashes of a text's
    lexicons, comma-joined), near_edited and near_next.

    Terms in more than ``high`` of the documents are in no lexicon, but for texts that are poor in
    band terms, as all are in one group of near copies that is larger than that: the lexicons of a
    poor text, and of its edited text, hold the terms above the band too. Null texts are empty.
    Rows of one id are in order of text; rows without an id come last; where no row has one, the
    last has an empty next document. One document alone is its own next. An empty table gives no rows.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    n, starts = _ranges(docs)
    table = lookup_table(durable(lexicon(docs, n, low, high)))
    own = with_fingerprint(docs, "text", "aw_own", table, poor())
    paired = with_next(own, starts, ["text", "aw_own"])
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    paired = paired.select("doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("aw_edited"), "aw_own", "aw_wide", F.coalesce("next_aw_own", F.array_repeat(F.lit(""), PLACES)).alias("aw_next"))
    both = with_fingerprint(paired, "aw_edited", "aw_new", table, F.col("aw_wide"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("aw_edited", 256).alias("edited_sha256"),
        F.array_join("aw_own", ",").alias("fingerprint"),
        F.array_join("aw_new", ",").alias("edited_fingerprint"),
        likeness(F.col("aw_own"), F.col("aw_new")).alias("near_edited"),
        likeness(F.col("aw_own"), F.col("aw_next")).alias("near_next"),
    )


_LEVELS_SQL = "[" + ", ".join(f"16 - length(bin(('0x' || substr(sha256(term), {4 * i + 1}, 4))::INT))" for i in range(LEXICONS)) + "]"
_FP_SQL = "[" + ", ".join(f"coalesce(max(h) FILTER (place = {k}), '')" for k in range(PLACES)) + "]"

ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(text, '') AS t FROM documents),
near AS (
  SELECT a.r, a.doc_id, a.t, b.t AS nt, b.r AS nr, length(a.t) AS n,
         substring(a.t, 1, length(a.t) - length(a.t) // 2) || substring(b.t, 1, length(a.t) // 2) AS e
  FROM docs a JOIN docs b ON b.r = a.r % (SELECT count(*) FROM docs) + 1),
all_texts AS (SELECT r, 0 AS kind, t FROM near UNION ALL SELECT r, 1, e FROM near),
tt AS (SELECT DISTINCT r, kind, unnest(string_split_regex(lower(t), '{GAP}')) AS term FROM all_texts),
lex AS (
  SELECT term, {_LEVELS_SQL} AS z, df > greatest(2, {HIGH} * (SELECT count(*) FROM docs)) AS above
  FROM (SELECT term, count(*) AS df FROM tt WHERE kind = 0 AND term <> '' GROUP BY term) WHERE df >= greatest(2, {LOW} * (SELECT count(*) FROM docs))),
known AS (SELECT r, kind, term, z, above FROM tt JOIN lex USING (term)),
wide AS (SELECT r, count(*) FILTER (above) > {POOR} * count(*) FILTER (NOT above) AS wide FROM known WHERE kind = 0 GROUP BY r),
kept AS (SELECT r, kind, term, z, length(bin(count(*) OVER (PARTITION BY r, kind))) - 1 AS lvl FROM known LEFT JOIN wide USING (r) WHERE NOT above OR coalesce(wide, false)),
marks AS (
  SELECT r, kind, ((lvl + up) % 2) * {LEXICONS} + i - 1 AS place, substr(md5((lvl + up)::VARCHAR || ' ' || string_agg(term, ' ' ORDER BY term)), 1, 16) AS h
  FROM kept, (SELECT unnest([0, 1]) AS up), (SELECT unnest(range(1, {LEXICONS + 1})) AS i) WHERE z[i] >= lvl + up GROUP BY r, kind, lvl, up, i),
f0 AS (SELECT r, kind, {_FP_SQL} AS f FROM marks GROUP BY r, kind),
fp AS (
  SELECT x.r, x.kind, coalesce(f, list_concat([{", ".join(["''"] * (PLACES - 1))}], [substr(md5(t), 1, 16)])) AS f
  FROM all_texts x LEFT JOIN f0 ON f0.r = x.r AND f0.kind = x.kind),
j AS (
  SELECT near.*, a.f AS f, b.f AS ef, c.f AS nf FROM near
  JOIN fp a ON a.r = near.r AND a.kind = 0 JOIN fp b ON b.r = near.r AND b.kind = 1 JOIN fp c ON c.r = near.nr AND c.kind = 0)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, array_to_string(f, ',') AS fingerprint, array_to_string(ef, ',') AS edited_fingerprint,
       len(list_filter(range(1, {PLACES + 1}), lambda i: f[i] <> '' AND f[i] = ef[i]))::DOUBLE / len(list_filter(range(1, {PLACES + 1}), lambda i: f[i] <> '' OR ef[i] <> '')) AS near_edited,
       len(list_filter(range(1, {PLACES + 1}), lambda i: f[i] <> '' AND f[i] = nf[i]))::DOUBLE / len(list_filter(range(1, {PLACES + 1}), lambda i: f[i] <> '' OR nf[i] <> '')) AS near_next
FROM j
"""
