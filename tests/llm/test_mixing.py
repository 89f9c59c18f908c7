from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assetweave.llm import source_mixing as m

SOURCES = ["a", "b", "", None, "é"]


def texts(n, seed=1):
    deal = random.Random(seed)
    return [" ".join("w" * deal.randint(1, 5) for _ in range(int(deal.lognormvariate(4, 1)))) for _ in range(n)], [deal.choice(SOURCES) for _ in range(n)]


def water_filling(sizes: dict, weights: dict) -> dict:
    """Reshare the excess by weight until no target is above its limit."""
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * weights[s] for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_targets_and_taken(documents):
    t, s = texts(3000)
    got = m.mix(documents(t, s, extra=True)).collect()
    sizes = defaultdict(int)
    for text, source in zip(t, s, strict=True):
        sizes[source] += len(text.split())
    order = sorted((x for x in sizes if x is not None)) + [None]
    want = water_filling(sizes, {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)})
    taken = defaultdict(int)
    assert sum(r["target"] for r in got if r["target"]) > 0
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for x in sizes:
        assert taken[x] == pytest.approx(want[x], rel=0.03)


def test_reruns_and_partitions_agree(documents):
    t, s = texts(400)
    df = documents(t, s)
    one = sorted(m.mix(df.repartition(1)).select("doc_id", "taken").collect())
    assert one == sorted(m.mix(df.repartition(7)).select("doc_id", "taken").collect())


def test_one_group_of_equal_sizes(documents):
    """All rows of a source alike in size, but for their ids: each is taken as often, to one copy."""
    got = m.mix(documents(["one two three"] * 500 + ["x y"] * 10, ["a"] * 500 + ["b"] * 10)).filter("source = 'a'").collect()
    each = got[0]["target"] / got[0]["source_size"]
    assert abs(sum(r["copies"] for r in got) - 500 * each) <= 1
    assert {r["copies"] for r in got} <= {int(each), int(each) + 1}


def test_edges(documents):
    assert m.mix(documents([])).count() == 0
    got = m.mix(documents([None, "", "  "], [None, "a", None])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3
    same = m.mix(documents(["a b"] * 4, ids=[1, 1, None, None])).collect()
    assert len(same) == 4 and sum(r["taken"] for r in same) in (10, 12, 14)


def test_mixed_documents(documents):
    t, s = texts(200)
    df = documents(t, s)
    plan = {r["doc_id"]: r["copies"] for r in m.mix(df).collect()}
    out = m.mixed_documents(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: v for k, v in plan.items() if v}
