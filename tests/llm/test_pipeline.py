from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as c
from assetweave.llm import quality_classifier, queries, source_mixing

from .test_join import brute
from .test_packing import whole
from .test_scans import personal

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(c.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
        counts.append(out.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3]
    assert counts[4] > counts[3]
    again = {tuple(r) for r in c.run(spark, DATA).select("doc_id", "piece", "ids_crc32").collect()}
    assert again == {tuple(r) for r in docs.select("doc_id", "piece", "ids_crc32").collect()}


def planted(spark):
    """The table, with near copies of every tenth text (a word more, a word less, the same) and personal data."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    more = []
    for i, text, lang, source, _ in rows[::10]:
        cut = text.rpartition(" ")[0]
        texts = [text, text + " indeed", cut, text + f" Write to user{i}@mail.example.org or 192.168.0.{i % 256}."]
        more += [(10_000 + 10 * i + k, t, lang, source, len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long")


def naive_score(machine, row):
    """From every pair of features, one by one, instead of the sum-of-squares identity."""
    at, value = quality_classifier.features(row["text"] or "", (row["n_chars"],))
    z = machine.factors[at] * np.array(value)[:, None]
    pairs = np.triu(z @ z.T, 1).sum()
    return 1 / (1 + np.exp(-(machine.bias + machine.weights[at] @ np.array(value) + pairs)))


def test_each_stage_against_plain_python(spark, tmp_path):
    """Every stage works on what its predecessor kept, and is held against a brute-force version of its own."""
    import duckdb

    tables = [planted(spark)]
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, tables[-1], DATA).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    start, good, single, clean, mixed, packed = ([r.asDict() for r in t.collect()] for t in tables)

    # 1: a score from all pairs of features.
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    machine = quality_classifier.train(tables[0], labels)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scores = {r["doc_id"]: naive_score(machine, r) for r in start}
    assert {r["doc_id"] for r in good} == {i for i, x in scores.items() if x >= quality_classifier.THRESHOLD}
    kept = {r["doc_id"] for r in good}
    assert sum(i in kept for i, q in quality.items() if q == 1) >= 0.95 * sum(q == 1 for q in quality.values())

    # 2: all pairs of shingle sets.
    by_id = {r["doc_id"]: r["text"] for r in good}
    ids = sorted(by_id)
    groups = brute([by_id[i] for i in ids], ids, 5, 80)
    assert {r["doc_id"] for r in single} == {row[0] for row in groups if row[0] == row[2]} and len(single) == len({r["doc_id"] for r in single})
    assert len(single) < len(good)

    # 3: the patterns find nothing more; texts in which they found nothing, and no @ or digit, are as they were.
    before = {r["doc_id"]: r["text"] for r in single}
    assert any(personal(x) for x in before.values())
    assert len(clean) == len(single) and not any(personal(r["text"]) for r in clean)
    for r in clean:
        if not any(x in "@0123456789" for x in before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]

    # 4: the SQL over what the stage was given.
    d = duckdb.connect()
    d.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    copies = {i: taken // size for i, size, _, _, taken in d.sql(source_mixing.ORACLE_SQL).fetchall() if size and taken}
    has_words = {r["doc_id"] for r in clean if r["text"].split()}
    assert Counter(r["doc_id"] for r in mixed if r["doc_id"] in has_words) == copies
    assert set(copies.values()) == {1, 2}

    # 5: the tokenizer's ids, cut and laid without gaps.
    want: Counter = Counter()
    total = 0
    for r, tokens in zip(mixed, whole([r["text"] for r in mixed]), strict=True):
        total += len(tokens)
        for k, at in enumerate(range(0, len(tokens), 2048)):
            part = tokens[at : at + 2048]
            want[r["doc_id"], k, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) * 1.02 + 2


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    d = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = d.sql(queries.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr) == want
