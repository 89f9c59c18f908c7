"""Quotation linking: conversations in reply order without quotes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, null_key, text_or_empty

#: Turns that are searched, or numbered, together.
BLOCK = 256
_MARKS = r"^((?:[ \t]*>)+)"
_QUOTES = r"(?m)^[ \t]*>"
_ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|.{1,80}\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
#: The place of messages without a turn: after all others.
NO_TURN = 1 << 61


def normal(text: Column) -> Column:
    """What quoting keeps: letters and digits in lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """Messages with ``reply`` (text outside quotes) and ``quotes``: (level, key) of each quoted
    passage, a run of lines of one level, and of each of its lines where it has several.

    The level is the number of > marks before a line. A line that only announces a quote ("On ...
    wrote:") and stands right before one is dropped. Null text is empty. Messages without a mark,
    usually nearly all, are not taken apart: all of them is the reply.
    """
    lines = F.transform(
        F.split(text_or_empty(), r"\r?\n"),
        lambda x: F.struct(
            F.length(F.translate(F.regexp_extract(x, _MARKS, 1), " \t", "")).alias("level"),
            F.regexp_replace(x, _MARKS, "").alias("body"),
        ),
    )
    marked = messages.withColumn("aw_lines", F.when(text_or_empty().rlike(_QUOTES), lines))
    level = lambda i: F.get("aw_lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("aw_lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    marked = marked.withColumn("aw_starts", starts)

    def run(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("aw_starts", k + 1), F.size("aw_lines"))
        return F.struct(level(i).alias("level"), F.transform(F.slice("aw_lines", i + 1, end - i), lambda x: x["body"]).alias("bodies"))

    marked = marked.withColumn("aw_runs", F.transform("aw_starts", run))

    def own(r: Column, k: Column) -> Column:
        announces = (F.get("aw_runs", k + 1)["level"] > 0) & F.element_at(r["bodies"], -1).rlike(_ATTRIBUTION)
        kept = F.when(announces, F.slice(r["bodies"], F.lit(1), F.size(r["bodies"]) - 1)).otherwise(r["bodies"])
        return F.when(r["level"] == 0, F.array_join(kept, "\n"))

    parts = F.array_join(F.filter(F.transform("aw_runs", own), lambda x: x.isNotNull()), "\n")
    reply = F.btrim(F.coalesce(parts, F.replace(text_or_empty(), F.lit("\r\n"), F.lit("\n"))), F.lit(" \t\n\x0b\f\r"))
    quoted = F.filter("aw_runs", lambda r: r["level"] > 0)
    whole = F.transform(quoted, lambda r: F.struct(r["level"].alias("level"), normal(F.array_join(r["bodies"], "\n")).alias("key")))
    single = F.flatten(F.transform(F.filter(quoted, lambda r: F.size(r["bodies"]) > 1), lambda r: F.transform(r["bodies"], lambda b: F.struct(r["level"].alias("level"), normal(b).alias("key")))))
    quotes = F.array_distinct(F.filter(F.concat(whole, single), lambda q: q["key"] != ""))
    out = marked.withColumn("reply", reply).withColumn("n_quotes", F.coalesce(F.size(quoted), F.lit(0)).cast("long")).withColumn("quotes", F.transform(quotes, lambda q: F.struct(q["level"].alias("level"), F.xxhash64(q["key"]).alias("key"))))
    return out.drop("aw_lines", "aw_starts", "aw_runs")


def _latest_before(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """quotes (conv_key, place, level, key) with ``origin``: the last place before, in the same
    conversation, whose message has the passage.

    An as-of search on (conversation, passage) in blocks of places: a running maximum inside a
    block, and over the blocks before one row each; so a passage that a long conversation repeats
    without end is dealt to as many tasks as it has blocks, and pairs are never formed.
    """
    key = ["conv_key", "key"]
    asked = quotes.select(*key, "place", "level", F.lit(None).cast("long").alias("has"))
    only = originals.join(quotes.select(*key).distinct(), key, "left_semi")
    both = asked.unionByName(only.select(*key, "place", F.lit(0).alias("level"), F.col("place").alias("has"))).withColumn("block", F.floor(F.col("place") / BLOCK))
    inside = Window.partitionBy(*key, "block").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*key, "block").agg(F.max("has").alias("top"))
    blocks = blocks.withColumn("before", F.max("top").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    found = both.withColumn("near", F.max("has").over(inside)).filter("level > 0").join(blocks, [*key, "block"])
    return found.select("conv_key", "place", "level", "key", F.coalesce("near", "before").alias("origin"))


def _roots(links: DataFrame) -> DataFrame:
    """conv_key, place, root, depth from links (conv_key, place, parent), by doubling the reach each round."""
    now = durable(links.select("conv_key", "place", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_key", F.col("place").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        new = durable(now.join(up, ["conv_key", "root"], "left").select("conv_key", "place", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")))
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now


def _numbered(df: DataFrame) -> DataFrame:
    """Add ``position``: from 0, by (root, place) within a conversation, from counts on three levels.

    A conversation is cut into runs of roots and those into runs of places, so that no window holds
    more than a block of messages or one row a block.
    """
    df = df.withColumns({"aw_r": F.floor(F.col("root") / BLOCK), "aw_p": F.floor(F.col("place") / BLOCK)})
    cells = df.groupBy("conv_key", "aw_r", "root", "aw_p").agg(F.count("*").alias("n"))
    runs = cells.groupBy("conv_key", "aw_r").agg(F.sum("n").alias("n"))
    runs = runs.withColumn("a", F.coalesce(F.sum("n").over(Window.partitionBy("conv_key").orderBy("aw_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = Window.partitionBy("conv_key", "aw_r").orderBy("root", "aw_p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("b", F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("n").join(runs, ["conv_key", "aw_r"])
    at = F.row_number().over(Window.partitionBy("conv_key", "aw_r", "root", "aw_p").orderBy("place", "reply"))
    return df.withColumn("aw_at", at).join(cells, ["conv_key", "aw_r", "root", "aw_p"]).withColumn("position", F.col("a") + F.col("b") + F.col("aw_at") - 1).drop("aw_r", "aw_p", "aw_at", "a", "b")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Every message (conv_id, turn, role, text) without its quotes, in reply order.

    Returns conv_id, turn, role, reply, n_quotes, n_linked (quoted passages or lines whose original
    was found), reply_to (the turn answered: the latest original of a first-level quote), thread
    (the turn that the chain of replies starts from), depth and position. A conversation sorted by
    position has each thread whole and every reply after what it answers.

    A quoted passage matches an earlier message of the same conversation that has, outside quotes,
    the same letters and digits as its whole reply, a paragraph or a line. Messages that quote
    nothing start threads. Null text is empty; null turns come last and are no originals; null
    conversations form one; repeated turns are searched and threaded together; extra columns are
    left out. An empty table gives no rows.
    """
    place = F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    base = messages.select("conv_id", "turn", "role", "text", null_key("conv_id").alias("conv_key"), place.alias("place"))
    parsed = passages(base).drop("text")
    quotes = durable(parsed.select("conv_key", "place", F.explode("quotes").alias("q")).select("conv_key", "place", "q.level", "q.key").distinct())
    # Only conversations in which something is quoted are searched for originals.
    asked = base.filter(F.col("place") < NO_TURN).join(quotes.select("conv_key").distinct(), "conv_key", "left_semi")
    pieces = F.concat(F.array(F.col("reply")), F.split("reply", r"\n\s*\n"), F.split("reply", "\n"))
    originals = passages(asked).select("conv_key", "place", F.explode(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(normal(p))))).alias("key"))
    found = durable(_latest_before(quotes, originals).filter("origin IS NOT NULL"))
    links = found.groupBy("conv_key", "place").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent"))
    roots = _roots(links.filter("parent IS NOT NULL").select("conv_key", "place", "parent"))
    known = links.join(roots, ["conv_key", "place"], "left")
    out = parsed.drop("quotes").join(known, ["conv_key", "place"], "left")
    out = out.withColumn("root", F.coalesce("root", "place"))
    out = _numbered(out)
    return out.select(
        "conv_id",
        "turn",
        "role",
        "reply",
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("reply_to"),
        F.when(F.col("root") < NO_TURN, F.col("root")).alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("position").cast("long").alias("position"),
    )
