"""Connected components of links, without bringing them to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_of, durable

#: Links that one task solves; more are solved in rounds over all tasks.
FEW = 1 << 18


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), ascending, and the smallest node that each can reach."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, (left, right) = np.arange(len(nodes)), (place[: len(a)], place[len(a) :])
    while True:
        x, y = label[left], label[right]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, onward := label[label]):
            label = onward


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.empty((2, 0), np.int64), *(np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], np.int64) for batch in batches)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in solved(*np.concatenate(ends, axis=1))], names=["node", "comp"])

    return durable(links.coalesce(1).mapInArrow(run, "node long, comp long"))


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of ``links`` (a, b): comp is the smallest node it can reach.

    Up to FEW links are solved in one task, which saves the driver the tasks of the rounds. Of more,
    each round a node takes the least label about it, and then its label's label, until nothing
    changes; stars settle in two rounds and chains in about the logarithm of their length. A hub's
    rows are aggregated before they move, and each round is checkpointed. ``links`` is read in each
    round, so it should be durable.
    """
    if count_of(links) <= FEW:
        return _in_one_task(links)
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.inline(ways))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp"))
    labels = durable(labels)
    while True:
        about = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        nearer = labels.join(about, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        onward = labels.select(F.col("node").alias("comp"), F.col("comp").alias("then"))
        new = durable(nearer.join(onward, "comp", "left").select("node", "was", F.least("comp", F.coalesce("then", "comp")).alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("comp <> was").isEmpty():
            return labels


def extended(comps: DataFrame, more: DataFrame) -> DataFrame:
    """``comps`` (node, comp) as they are with the links ``more`` (a, b) besides.

    Unless all are few, only the graph of the components that new links join is solved, so the cost
    follows the new links. ``more`` is read more than once, so it should be durable.
    """
    many = count_of(more)
    if not many:
        return comps
    if many + count_of(comps) <= FEW:
        return _in_one_task(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more.select("a", "b")))
    known = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    joined = more.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    joined = durable(joined.filter("a <> b").distinct())
    if joined.isEmpty():
        return comps
    # A component's name is its smallest node, so the smallest name is the smallest node of all.
    names = components(joined)
    renamed = comps.join(names.select(F.col("node").alias("comp"), F.col("comp").alias("name")), "comp", "left").select("node", F.coalesce("name", "comp").alias("comp"))
    return durable(renamed.unionByName(names.join(comps.select("node"), "node", "left_anti")))
