from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from assetweave.llm import document_fingerprints as d


def brute(rows, low, high):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    texts = [t for _, t in rows]
    edited = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + texts[(i + 1) % len(texts)][:half])
    terms = lambda t: set(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    df = Counter(x for t in texts for x in terms(t))
    n = len(texts)

    def levels(term):
        digest = hashlib.sha256(term.encode()).hexdigest()
        return [16 - len(bin(int(digest[4 * i : 4 * i + 4], 16))[2:]) for i in range(d.LEXICONS)]

    def known(t, wide):
        return {x for x in terms(t) if df[x] >= max(2, low * n) and (wide or df[x] <= max(2, high * n))}

    def is_wide(t):
        band = len(known(t, False))
        return len(known(t, True)) - band > d.POOR * band

    def mark(t, wide):
        mine = sorted(known(t, wide), key=lambda x: x.encode())
        level = len(mine).bit_length() - 1
        parts = [""] * d.PLACES
        for up in (0, 1) if mine else ():
            for i in range(d.LEXICONS):
                held = [x for x in mine if levels(x)[i] >= level + up]
                if held:
                    parts[(level + up) % 2 * d.LEXICONS + i] = hashlib.md5(f"{level + up} {' '.join(held)}".encode()).hexdigest()[:16]
        return parts if any(parts) else [""] * (d.PLACES - 1) + [hashlib.md5(t.encode()).hexdigest()[:16]]

    def like(a, b):
        return sum(x == y != "" for x, y in zip(a, b, strict=True)) / sum(bool(x or y) for x, y in zip(a, b, strict=True))

    own, new = [mark(t, is_wide(t)) for t in texts], [mark(e, is_wide(t)) for t, e in zip(texts, edited, strict=True)]
    return [
        (rows[i][0], len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), ",".join(own[i]), ",".join(new[i]), like(own[i], new[i]), like(own[i], own[(i + 1) % n]))
        for i in range(n)
    ]


@pytest.mark.parametrize("per_range", [1000, 7])
def test_against_brute_force(documents, monkeypatch, per_range):
    monkeypatch.setattr(d, "PER_RANGE", per_range)
    deal = random.Random(1)
    vocabulary = ["".join(deal.choice("abcdeé") for _ in range(3)) for _ in range(120)]
    texts = [" ".join(deal.choice(vocabulary) for _ in range(deal.choice((0, 1, 5, 30, 100)))) for _ in range(60)] + ["zzz\U0001f600é", ""]
    texts += texts[:3]
    ids = deal.sample(range(500), len(texts) - 2) + [None, 7000]
    got = d.fingerprints(documents(texts, ids=ids, extra=True), low=0.02, high=0.5).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(brute(list(zip(ids, texts, strict=True)), 0.02, 0.5), key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_equal_and_near_texts(documents):
    deal = random.Random(2)
    vocabulary = ["".join(deal.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = [" ".join(deal.choice(vocabulary) for _ in range(80)) for _ in range(100)]
    near = [f"{t} only{i}" for i, t in enumerate(texts[:20])]
    got = {r["doc_id"]: r for r in d.fingerprints(documents(texts + texts[:20] + near), low=0.01, high=0.9).collect()}
    assert all(got[i]["fingerprint"] == got[100 + i]["fingerprint"] for i in range(20))
    assert all(got[i]["fingerprint"] == got[120 + i]["fingerprint"] for i in range(20))
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.05
    assert sum(got[i]["near_edited"] > got[i]["near_next"] for i in range(20, 119)) >= 85


def test_a_third_is_near_copies(documents):
    deal = random.Random(4)
    vocabulary = ["".join(deal.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    base = [deal.choice(vocabulary) for _ in range(80)]

    def near(i):
        words = list(base)
        for k, at in enumerate(deal.sample(range(80), 2)):
            words[at] = f"only{i}x{k}" if i % 2 else deal.choice(vocabulary)
        return " ".join(words)

    texts = [near(i) for i in range(100)] + [" ".join(deal.choice(vocabulary) for _ in range(80)) for _ in range(200)]
    got = sorted(d.fingerprints(documents(texts), low=0.01, high=0.25).collect(), key=lambda r: r["doc_id"])
    mean = lambda c, rows: sum(r[c] for r in rows) / len(rows)
    assert mean("near_next", got[:99]) > 0.5 and mean("near_edited", got[:99]) > 0.15
    assert mean("near_next", got[100:]) < 0.1


def test_edges(documents):
    assert d.fingerprints(documents([])).count() == 0
    alone = d.fingerprints(documents(["abc d"])).collect()[0]
    assert alone["edited_sha256"] == hashlib.sha256(b"abcab").hexdigest() and alone["near_next"] == 1
    nulls = d.fingerprints(documents([None, None], ids=[None, None])).collect()
    assert len(nulls) == 2 and all(r["n_chars"] == 0 for r in nulls)
    same = d.fingerprints(documents(["x y z"] * 4, ids=[1, 1, 1, 1])).collect()
    assert all(r["near_next"] == 1 for r in same)
