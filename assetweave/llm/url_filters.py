"""URL filters by a temporal join with dated lists, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read

#: Days from the first, for the registered query, which has no fetch times of its own.
DAYS = 365
#: Dated entries of the registered query: key, action, change and day. Hosts are those of the
#: synthetic pages; more entries come from list_of().
FIXED_ENTRIES = (
    ("d:spam-farm.example.org", "drop", "add", 0),
    ("d:spam-farm.example.org", "drop", "remove", 200),
    ("d:spam-farm.example.org", "drop", "add", 300),
    ("d:cheap-pills.example.com", "drop", "add", 30),
    ("d:example.net", "drop", "add", 340),
    ("d:m.ththth.example.net", "keep", "add", 350),
)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(changes: DataFrame) -> DataFrame:
    """key, action, since, until from dated changes (key, action, change add / remove, at).

    An entry is active from the day of its add up to, not including, that of the next change of the
    same key and action; on one day a remove comes after an add and wins. Rows with a null are no
    entries; repeated rows say nothing new.
    """
    known = changes.select("key", "action", "change", "at").dropna().distinct()
    w = Window.partitionBy("key", "action").orderBy("at", "change")
    spans = known.withColumn("until", F.lead("at").over(w)).filter(F.col("change") == "add")
    return spans.filter(F.col("until").isNull() | (F.col("until") > F.col("at"))).select("key", "action", F.col("at").alias("since"), "until")


def keys_of(url: str):
    """An array of (key, depth): the host and all domains above it, then the host with each directory of the path."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    path = F.regexp_extract(url, _PATH, 1)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n - i + 1), ".")).alias("key"), (n - i + 1).alias("depth")))
    directories = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key"), (i + 1000).alias("depth"))),
    ).otherwise(F.array().cast("array<struct<key:string,depth:int>>"))
    return F.when(host != "", F.concat(domains, directories))


def evaluate(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """The verdict on every capture (page_id, url, fetched), by the entries active when it was fetched.

    Returns page_id, url, fetched, entry, since, action and kept. Of the active entries that match
    the deepest counts (directories before hosts before domains), then the latest, then keep before
    drop. Entries meet captures on equal keys and days within an interval, so a hot host's rows can
    be dealt to several tasks, and only matches are aggregated; the size of the list decides
    whether Spark broadcasts it. Captures without a host or a fetch time match nothing and are kept;
    repeated rows are judged alike; extra columns are left out.
    """
    captures = captures.select("page_id", "url", "fetched")
    lists = intervals(changes)
    asked = captures.filter(F.col("fetched").isNotNull()).select("page_id", "url", "fetched", F.explode(keys_of("url")).alias("k"))
    asked = asked.select("page_id", "url", "fetched", "k.key", "k.depth")
    active = asked.join(lists, (asked["key"] == lists["key"]) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    rank = F.struct("depth", "since", (F.col("action") == "keep").cast("int").alias("keep"), lists["key"], "action")
    won = active.groupBy("page_id", "url", "fetched").agg(F.max(rank).alias("won"))
    won = won.select(F.col("page_id").alias("aw_page"), F.col("url").alias("aw_url"), F.col("fetched").alias("aw_fetched"), F.col("won.key").alias("entry"), "won.since", "won.action")
    out = captures.join(won, F.col("page_id").eqNullSafe(F.col("aw_page")) & (F.col("url") == F.col("aw_url")) & (F.col("fetched") == F.col("aw_fetched")), "left")
    return out.select("page_id", "url", "fetched", "entry", "since", "action", F.coalesce(F.col("action") != "drop", F.lit(True)).alias("kept"))


def list_of(pages: DataFrame) -> DataFrame:
    """Dated entries for the registered query: fixed ones, and one host in ten of the pages, listed
    on a day that its checksum gives and, one in three of them, taken off 90 days later."""
    spark = pages.sparkSession
    fixed = spark.createDataFrame(list(FIXED_ENTRIES), "key string, action string, change string, at int")
    hosts = pages.select(F.lower(F.regexp_extract("url", _HOST, 1)).alias("host")).filter("host <> ''").distinct().withColumn("c", F.crc32(F.col("host").cast("binary")))
    listed = hosts.filter(F.col("c") % 10 == 0)
    day = (F.floor(F.col("c") / 10) % DAYS).cast("int")
    added = listed.select(F.concat(F.lit("d:"), "host").alias("key"), F.lit("drop").alias("action"), F.lit("add").alias("change"), day.alias("at"))
    removed = listed.filter(F.floor(F.col("c") / 10) % 3 == 0).select(F.concat(F.lit("d:"), "host").alias("key"), F.lit("drop").alias("action"), F.lit("remove").alias("change"), (day + 90).alias("at"))
    return fixed.unionByName(added).unionByName(removed)


def registered(spark, sf_dir: str) -> DataFrame:
    """All pages, fetched on day page_id mod 365, against list_of(pages)."""
    pages = read(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") % DAYS).cast("int").alias("fetched"))
    return evaluate(captures, list_of(pages))


def _oracle_sql() -> str:
    fixed = ", ".join(f"('{key}', '{action}', '{change}', {at})" for key, action, change, at in FIXED_ENTRIES)
    return rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
page AS (
  SELECT page_id, url, (page_id % {DAYS})::INT AS fetched, lower(regexp_extract(url, '{_HOST}', 1)) AS host, regexp_extract(url, '{_PATH}', 1) AS path FROM pages),
host_bytes AS (
  SELECT host, list_transform(range(octet_length(encode(host))), lambda i: ('0x' || substr(hex(encode(host)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT host FROM page WHERE host <> '')),
host_crc AS (
  SELECT host, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS c FROM host_bytes, crc_table),
listed AS (SELECT 'd:' || host AS key, c // 10 AS d FROM host_crc WHERE c % 10 = 0),
changes AS (
  SELECT * FROM (VALUES {fixed}) AS f(key, action, change, "at")
  UNION SELECT key, 'drop', 'add', (d % {DAYS})::INT FROM listed
  UNION SELECT key, 'drop', 'remove', (d % {DAYS} + 90)::INT FROM listed WHERE d % 3 = 0),
spans AS (
  SELECT key, action, change, "at" AS since, lead("at") OVER (PARTITION BY key, action ORDER BY "at", change) AS until FROM changes),
active_entries AS (SELECT * FROM spans WHERE change = 'add' AND (until IS NULL OR until > since)),
parts AS (
  SELECT page_id, url, fetched, host, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda p: p <> '') AS dirs FROM page WHERE host <> ''),
keys AS (
  SELECT page_id, url, fetched, unnest(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: {{'key': 'd:' || array_to_string(labels[i:], '.'), 'depth': len(labels) - i + 1}}),
    list_transform(range(1, len(dirs) + 1), lambda i: {{'key': 'p:' || host || '/' || array_to_string(dirs[:i], '/'), 'depth': i + 1000}}))) AS k FROM parts),
won AS (
  SELECT page_id, url, fetched, max({{'depth': k.depth, 'since': since, 'keep': (action = 'keep')::INT, 'entry': key, 'action': action}}) AS w
  FROM keys JOIN active_entries ON key = k.key AND fetched >= since AND (until IS NULL OR fetched < until) GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched, w.entry AS entry, w.since AS since, w.action AS action, coalesce(w.action <> 'drop', true) AS kept
FROM page p LEFT JOIN won ON won.page_id IS NOT DISTINCT FROM p.page_id AND won.url = p.url AND won.fetched = p.fetched"""


ORACLE_SQL = _oracle_sql()
