from __future__ import annotations

import random
import zlib

import numpy as np

from assetweave.llm import quality_classifier as q


def labelled(spark, documents, n=400):
    deal = random.Random(1)
    words = lambda k: " ".join("".join(deal.choice("abcdefghij") for _ in range(deal.randint(2, 8))) for _ in range(k))
    good = [words(deal.randint(40, 200)).capitalize() + "." for _ in range(n)]
    bad = [words(60).replace(" ", " ### ") if i % 2 else (words(1) + " ") * 80 for i in range(n // 4)]
    texts = good + bad
    labels = [(i, int(i < n), 0) for i in range(len(texts)) if i % 3]
    return documents(texts, extra=True), spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int"), n


def test_held_out_accuracy(spark, documents):
    docs, labels, n = labelled(spark, documents)
    got = q.classify(docs, labels).collect()
    told = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] < n) for r in told) >= 0.97 * len(told)


def test_keep_good_keeps_columns_and_clean_rows(spark, documents):
    docs, labels, n = labelled(spark, documents)
    out = q.keep_good(docs, labels)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert len(ids & set(range(n))) >= 0.98 * n and len(ids - set(range(n))) <= 0.1 * n


def test_pairs_by_squares_equal_pairs_one_by_one():
    deal = np.random.default_rng(0)
    m = q.Machine(0.3, deal.normal(size=q.SIZE), deal.normal(size=(q.SIZE, 4)))
    at, value = [3, 70, 900, 12], [0.5, -1.0, 2.0, 0.25]
    raw, _ = m.raw(*q._packed([(at, value), ([5], [1.0])]))
    pairs = sum(m.factors[at[a]] @ m.factors[at[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert np.isclose(raw[0], 0.3 + sum(m.weights[i] * v for i, v in zip(at, value, strict=True)) + pairs)
    assert np.isclose(raw[1], 0.3 + m.weights[5])


def test_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.classify(documents([]), none).count() == 0
    got = q.classify(documents([None, "", "a", "a" * 30000], ids=[1, 1, None, 2]), none).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and all(r["held_out"] is not None for r in got)
