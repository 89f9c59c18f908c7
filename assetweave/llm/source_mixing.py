"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, null_key, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Ranks within a cell are counted apart, so that a hot source spreads over many tasks.
SALTS = 64


def with_sizes(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source and the number of words (null text: 0), with any columns to carry along.

    ``mix_tie`` orders equal sizes and deals rows to salts; it depends on the row's id and text,
    so that equal rows, which cannot be told apart, are the only ties that remain.
    """
    keep = list(dict.fromkeys(["doc_id", "source", *carry]))
    text = text_or_empty()
    return docs.select(
        *keep,
        n_words(text).alias("size"),
        F.md5(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)).alias("mix_tie"),
    ).withColumn("mix_key", null_key("source"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: mix_key, source_size and target.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words.
    A target stops at ``most`` times its source's size and the excess is shared again by weight:
    in order of limit by weight, the sources that stop come first, and the level of the others
    is what the limits leave, by the weight that remains. One row per source is small, whatever
    the corpus; the two windows without a partition see only those rows.
    """
    per = sized.groupBy("mix_key").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy("mix_key")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "mix_key")
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "left_words": F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    per = per.withColumn("level", F.col("left_words") / F.col("left_weight"))
    per = per.withColumn("stops", F.col("limit") <= F.col("level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), F.col("mix_key"), F.col("level")))).over(all_rows)["level"]
    return per.withColumn("open_level", open_level).select(
        "mix_key",
        "source_size",
        F.when(F.col("stops") | F.col("open_level").isNull(), F.col("limit").cast("double")).otherwise(F.col("open_level") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: str = "mix-1",
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document.

    Within a source every document is expected target / source_size times. Documents lie in order
    of size, the expected copies are summed along that order, one offset per source (from ``seed``
    and the source) is added, and a document is emitted once for each integer that its step
    crosses: as the order follows size, the words taken stay within a few documents of the target.
    The prefix sum has two levels: counts of (source, first bits of size, salt) cells, summed in
    order, and ranks within a cell; a cell holds at most 1 / 64 of a hot source, or of one group of
    different rows of one size. Only rows equal in id and text share a cell without end, and those
    are interchangeable.

    Returns doc_id, source, carried columns, size, source_size, target, copies and taken
    (copies * size). Null text has size 0; sources null and "" differ; repeated rows are separate
    documents; an empty table gives no rows; where all texts are empty, targets and copies are 0.
    """
    sized = with_sizes(docs, carry)
    targets = source_targets(sized.select("mix_key", "size"), weights, share, most)
    # A cell has sizes of one length in bits and the same first five bits, and one salt.
    bits = F.length(F.bin("size"))
    sized = sized.withColumn("mix_length", bits).withColumns(
        {
            "mix_bits": F.col("mix_length") * 32 + F.expr("shiftright(size, greatest(mix_length - 5, 0))"),
            "mix_salt": F.conv(F.substring("mix_tie", 1, 4), 16, 10).cast("int") % SALTS,
        }
    )
    cell = ["mix_key", "mix_bits", "mix_salt"]
    along = Window.partitionBy("mix_key").orderBy("mix_bits", "mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("mix_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    cells = (
        sized.groupBy(*cell)
        .agg(F.count("*").alias("mix_n"))
        .join(targets, "mix_key")
        .withColumn("mix_before", F.coalesce(F.sum("mix_n").over(along), F.lit(0)))
        .withColumn("mix_offset", offset)
        .drop("mix_n")
    )
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "mix_tie"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = F.col("mix_before") + F.col("mix_rank")
    copies = (F.floor(step * F.col("mix_each") + F.col("mix_offset")) - F.floor((step - 1) * F.col("mix_each") + F.col("mix_offset"))).cast("long")
    out = sized.withColumn("mix_rank", rank).join(cells, cell).withColumn("mix_each", each).withColumn("copies", copies)
    keep = list(dict.fromkeys(["doc_id", "source", *carry]))
    return out.select(*[c for c in keep if c not in ("size", "source_size", "target", "copies", "taken")], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of ``docs``, a row for each copy."""
    taken = mix(docs.withColumn("mix_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), carry=["mix_row"], **options)
    repeated = taken.filter("copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("mix_row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '~') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(text, '')) AS tie
  FROM documents),
per AS (
  SELECT k, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY k),
lev AS (
  SELECT *, 2 * source_size AS lim,
         ((SELECT sum(source_size) FROM per)::DOUBLE * 1.5
          - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / ((SELECT sum(weight) FROM per)
          - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl
  FROM per),
op AS (SELECT *, lim <= lvl * weight AS stops FROM lev),
tgt AS (
  SELECT k, source_size,
         CASE WHEN stops OR (SELECT count(*) FROM op WHERE NOT stops) = 0 THEN lim::DOUBLE
              ELSE (SELECT arg_min(lvl, lim / weight) FROM op WHERE NOT stops) * weight END AS target
  FROM op),
ranked AS (
  SELECT s.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY s.k ORDER BY length(bin(s.size)) * 32 + (s.size >> greatest(length(bin(s.size)) - 5, 0)::INT), ('0x' || substr(tie, 1, 4))::INT % 64, s.size, tie) AS r,
         ('0x' || substr(md5('mix-1:' || s.k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0::DOUBLE END AS c
  FROM sized s JOIN tgt t USING (k))
SELECT doc_id, size, source_size, target,
       ((floor(r * c + off) - floor((r - 1) * c + off))::BIGINT * size)::BIGINT AS taken
FROM ranked
"""
