from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from assetweave.llm import components as c
from assetweave.llm import jaccard_join as j
from assetweave.llm.components import components, extended

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, ids, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i in range(len(texts)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[root(i)]) for i in range(len(texts)))


def corpus(seed, n=60):
    """Families of near copies, chains of edits, shared passages, copies and short texts."""
    deal = random.Random(seed)
    word = lambda: "".join(deal.choice("abcdeé") for _ in range(deal.randint(1, 4)))
    passage = [word() for _ in range(40)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(deal.choice((3, 20, 60, 120)))]
        now = list(base)
        for _ in range(deal.randint(1, 12)):
            copy = list(now if deal.random() < 0.5 else base)
            for _ in range(deal.randint(0, 5)):
                copy[deal.randrange(len(copy))] = word()
            now = copy
            out.append(" ".join(copy + passage * (deal.random() < 0.2)))
    return [*out, None, "", " \n", "One two", "one  TWO", "a b c", "É b c d e", "é b c d e"]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_components(documents, seed, words, percent):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = j.link_components(documents(texts, ids=ids, extra=True), words=words, percent=percent)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, ids, words, percent)


@pytest.mark.parametrize(("tile", "listed", "seed"), [(5, 20_000, 7), (1024, 3, 8), (3, 4, 9)])
def test_tiles_and_groups(documents, monkeypatch, tile, listed, seed):
    """Lists and groups that are cut into tiles and salts lose nothing."""
    monkeypatch.setattr(j, "TILE", tile)
    monkeypatch.setattr(j, "LIST", listed)
    monkeypatch.setattr(j, "HOLD", tile)
    texts = corpus(seed)
    got = j.link_components(documents(texts), words=4, percent=85)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, list(range(len(texts))), 4, 85)


def test_group_links_connect_all_that_links_connect():
    deal = np.random.default_rng(0)
    for percent in (50, 80):
        base = deal.integers(0, 2**40, 60, dtype=np.uint64)
        sets = [np.unique(np.r_[deal.choice(base, 50, replace=False), deal.integers(0, 2**40, deal.integers(0, 30), dtype=np.uint64)]) for _ in range(40)]
        want = [(a, b) for a, b in combinations(range(40), 2) if j.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), percent)]

        def parts(links):
            up = list(range(40))

            def root(i):
                while up[i] != i:
                    i = up[i]
                return i

            for a, b in links:
                up[max(root(a), root(b))] = min(root(a), root(b))
            return [root(i) for i in range(40)]

        got = j.group_links(sets, percent)
        assert parts(got) == parts(want) and {tuple(sorted(x)) for x in got} <= set(want)


def test_derived_links_between_tiles():
    """What two tiles find connects what links connect between them, whatever is connected already."""
    deal = np.random.default_rng(3)
    base = deal.integers(0, 2**40, 80, dtype=np.uint64)
    sets = [np.unique(np.r_[deal.choice(base, 70, replace=False), deal.integers(0, 2**40, deal.integers(0, 25), dtype=np.uint64)]) for _ in range(60)]
    left, right, pivot = sets[1:25], sets[25:], sets[0]
    for percent in (50, 70):
        found = j.derived_links(pivot, left, right, list(range(24)), list(range(24, 59)), percent)
        want = {(a, b) for a in range(24) for b in range(35) if j.linked(len(np.intersect1d(left[a], right[b])), len(left[a]), len(right[b]), percent)}
        assert set(found) <= want

        def parts(links):
            up = list(range(59))
            for _ in range(59):
                for a, b in links:
                    up[a] = up[24 + b] = min(up[a], up[24 + b])
            return up

        assert parts(found) == parts(want)


def test_lists_that_come_in_pieces(monkeypatch):
    """Lists, settled or not, are the same however their entries are cut into batches."""
    import pyarrow as pa

    deal = random.Random(2)
    rows = set()
    for token in range(60):
        for _ in range(deal.choice((1, 2, 2, 3, 12))):
            n = deal.choice((20, 21, 40))
            pos = deal.randrange(6)
            rows.add((token, int(n - pos < j._needed(np.int64(n), n, 80)), deal.randrange(50), n, pos))
    rows = sorted({r[:3]: r for r in rows}.values())
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], pa.int64()) for i in range(5)], names=list("abcde"))

    def told(size):
        out = [b.to_pylist() for b in j._shared_lists(80)(batch(rows[k : k + size]) for k in range(0, len(rows), size))]
        return [tuple(r.values()) for part in out for r in part]

    whole = told(len(rows))
    assert whole and all(told(size) == whole for size in (1, 2, 3, 7))
    by = {}
    for r in whole:
        by.setdefault(r[0], []).append(r)
    for token, got in by.items():
        assert len(got) == sum(r[0] == token for r in rows)
        assert {r[4] for r in got} == {got[0][1]}
        assert all(r[5] & j.SETTLED for r in got) == all(r[5] & 1 for r in got)
    monkeypatch.setattr(j, "HOLD", 2)
    assert [r[:5] for r in told(3) if len(by.get(r[0], ())) > 2] == [r[:5] for r in whole if len(by[r[0]]) > 2]


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    deal = random.Random(5)
    text = " ".join("".join(deal.choice("abcé") for _ in range(deal.randint(1, 9))) for _ in range(5000)) + "  \n" + "x" * 3000 + " end of it"
    want = j.shingles_of([text, "a b"], 5)
    monkeypatch.setattr(j, "_CHUNK", 256)
    got = j.shingles_of([text, "a b"], 5)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_one_group_of_many_near_copies_in_bounded_memory():
    """Two tiles of a large group are compared without a matrix of pairs."""
    import tracemalloc

    deal = np.random.default_rng(1)
    base = deal.integers(0, 2**60, 180, dtype=np.uint64)
    sets = [np.unique(np.r_[deal.choice(base, 150, replace=False), deal.integers(0, 2**60, 20, dtype=np.uint64)]) for _ in range(2 * j.TILE + 1)]
    tracemalloc.start()
    j.derived_links(sets[0], sets[1 : j.TILE + 1], sets[j.TILE + 1 :], list(range(j.TILE)), list(range(j.TILE, 2 * j.TILE)), 80)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_one_of_each(documents):
    base = " ".join(f"w{i}" for i in range(50))
    df = documents([base, base + " more", base, "other text of some words here", None, ""], ids=[5, 3, 9, 1, 2, 2], extra=True)
    out = j.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == [(1, "other text of some words here"), (3, base + " more")]


def test_edges(documents):
    assert j.link_components(documents([])).count() == 0
    got = sorted(j.link_components(documents(["a b"] * 3 + [None], ids=[1, 1, 1, 2]), words=4, percent=85).collect())
    assert [tuple(r) for r in got] == [(1, 1, 1)] * 3 + [(2, 0, 2)]


def test_components_extended_by_links_are_those_of_all_links(spark):
    deal = random.Random(9)
    nodes = deal.sample(range(-(2**40), 2**40), 60)
    cases = [([], [(1, 2)]), ([(5, 4)], [(7, 5), (7, 3)]), ([(1, 2), (3, 4)], [(2, 1)])]
    cases += [([tuple(deal.sample(nodes, 2)) for _ in range(25)], [tuple(deal.sample(nodes, 2)) for _ in range(many)]) for many in (1, 15)]
    for first, more in cases:
        table = lambda rows: spark.createDataFrame(rows, "a long, b long")
        got = {r["node"]: r["comp"] for r in extended(components(table(first)), table(more)).collect()}
        whole = {r["node"]: r["comp"] for r in components(table(first + more)).collect()}
        assert got == whole


def test_components_in_rounds_are_those_of_one_task(spark, monkeypatch):
    deal = random.Random(4)
    nodes = deal.sample(range(-(2**40), 2**40), 16)
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    said = lambda df: sorted(tuple(r) for r in df.collect())
    links = [tuple(deal.sample(nodes, 2)) for _ in range(9)]
    whole = said(components(table(links)))
    parts = said(extended(components(table(links[::2])), table(links[1::2])))
    monkeypatch.setattr(c, "FEW", -1)
    assert whole == parts == said(components(table(links)))
    assert len(whole) == len({x for link in links for x in link})


def test_texts_are_taken_up_for_comparisons_only(spark, documents, monkeypatch):
    """A list of texts that share a shingle too late to link moves none of them."""
    texts, taken = j._texts, []

    def spied(docs, prefixes, pairs, *rest):
        taken.append((out := texts(docs, prefixes, pairs, *rest)).count())
        return out

    monkeypatch.setattr(j, "_texts", spied)
    base = [f"w{i}" for i in range(50)]
    near = [" ".join(base), " ".join([*base, "more"])]
    # Shared words at the end of texts of very different sizes: lists without a pair that can link.
    apart = [" ".join([*(f"{k}x{i}" for i in range(30 * 2**k)), "one", "two", "six", "ten"]) for k in range(6)]
    rows = near + near[:1] + apart
    got = sorted(tuple(r) for r in j.link_components(documents(rows), words=4, percent=85).collect())
    assert got == brute(rows, list(range(len(rows))), 4, 85)
    assert sum(taken) == 2


def test_few_links_take_few_jobs(spark):
    """The driver keeps records of every job and task, so rounds are for many links only."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    assert {r["comp"] for r in components(links).collect()} == {0}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 6
