from __future__ import annotations

import random
import re
from collections import Counter

from assetweave.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(documents):
    deal = random.Random(3)
    some = [" ".join(deal.choice("ab") for _ in range(deal.randint(0, 60))) for _ in range(60)]
    some += ["a\nb\na\n\n \nb\r\nb", None, "", "# é\x0b* $x", "one two three four five six seven eight " * 3, "x" * 5000 + " y", "\n".join(["same line here"] * 5)]
    got = {r["doc_id"]: tuple(r[c] for c in q.COUNTS) for r in q.text_counts(documents(some, extra=True)).collect()}
    assert got == {i: counts(t) for i, t in enumerate(some)}


def test_verdicts_adapt(documents):
    deal = random.Random(5)
    clean = [" ".join("".join(deal.choice("abcdefgh") for _ in range(deal.randint(2, 9))) for _ in range(deal.randint(30, 200))) for _ in range(300)]
    coded = [t.replace(" ", " # ") for t in clean[:150]]  # a source in which symbols are usual
    junk = [t.replace(" ", " ### ") for t in clean[150:160]]
    texts = clean + coded + junk + ["too short"] + ["w x y z a b c d " * 10]
    sources = ["prose"] * 300 + ["code"] * 150 + ["prose"] * 10 + [None, None]
    got = q.judge(documents(texts, sources)).orderBy("doc_id").collect()
    assert sum(r["kept"] for r in got[:450]) >= 445
    assert not any(r["kept"] for r in got[450:])
    assert [r["base_failed"] for r in got[460:]] == [True, True]


def test_repeats_alone_reject(documents):
    """A fifth of a text's words repeated is below the base rule; a header that stands twice is not judged."""
    deal = random.Random(6)
    word = lambda: "".join(deal.choice("abcdefgh") for _ in range(deal.randint(2, 9)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(120)]
    passage = " ".join(word() for _ in range(45))
    header = " ".join(word() for _ in range(12))
    texts += [f"{passage} {texts[0]} {passage}", f"{header} {texts[1]} {header}"]
    got = q.judge(documents(texts)).orderBy("doc_id").collect()
    assert all(r["kept"] for r in got[:120])
    assert not got[120]["base_failed"] and not got[120]["kept"] and got[121]["kept"]


def test_small_groups_are_drawn_to_their_language(documents):
    """Fences move with the number of documents, without a step."""
    sketch = q.sketches(q.text_counts(documents(["# a " * 30] * 3 + ["b c " * 30] * 300, ["odd"] * 3 + ["usual"] * 300)).withColumns({"lang_key": q.null_key("lang"), "source_key": q.null_key("source")}))
    got = {r["source_key"]: r["symbols_high"] for r in q.thresholds(sketch).collect()}
    assert 50 < got["=odd"] < 1050 and got["=usual"] < got["=odd"]


def test_edges(documents):
    assert q.judge(documents([])).count() == 0
    got = q.judge(documents([None, "", "a " * 30, "a " * 30], [None] * 4, [None, "en", None, "en"], ids=[1, 1, None, None])).collect()
    assert len(got) == 4 and not any(r["kept"] for r in got)
