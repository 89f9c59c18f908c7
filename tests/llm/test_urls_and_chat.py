from __future__ import annotations

import random

from assetweave.llm import quotation_linking as q
from assetweave.llm import url_filters as u


def captures(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, fetched int, entry string")


def changes(spark, rows):
    return spark.createDataFrame(rows, "key string, action string, change string, at int")


def test_as_of(spark):
    c = captures(spark, [(1, "http://a.bad.org/x/y?q", 5), (2, "https://A.BAD.org:80/x", 10), (3, "http://bad.org", 4), (4, "http://good.org/x/y", 5), (5, None, 5), (6, "http://a.bad.org/x", None), (7, "no url", 5), (1, "http://a.bad.org/x/y?q", 5)])
    e = changes(spark, [("d:bad.org", "drop", "add", 5), ("d:bad.org", "drop", "remove", 9), ("d:bad.org", "drop", "add", 10), ("p:a.bad.org/x/y", "keep", "add", 0), ("d:org", "drop", "add", 100), (None, "drop", "add", 0), ("d:good.org", "drop", "add", 5), ("d:good.org", "drop", "remove", 5)])
    got = {(r["page_id"], r["url"]): (r["entry"], r["kept"]) for r in u.evaluate(c, e).collect()}
    assert u.evaluate(c, e).count() == 8
    assert got[(1, "http://a.bad.org/x/y?q")] == ("p:a.bad.org/x/y", True)
    assert got[(2, "https://A.BAD.org:80/x")] == ("d:bad.org", False)
    assert all(got[k] == (None, True) for k in got if k[0] > 2)


def test_against_brute_force(spark):
    deal = random.Random(1)
    hosts = [f"{a}.{b}.org" for a in "xyz" for b in "pq"]
    caps = [(i, f"http://{deal.choice(hosts)}/{deal.choice('ab')}/{i}", deal.randrange(30)) for i in range(300)]
    keys = [f"d:{h}" for h in hosts] + ["d:p.org", "d:q.org", "p:x.p.org/a"]
    moves = sorted({(deal.choice(keys), deal.choice(("drop", "keep")), deal.choice(("add", "remove")), deal.randrange(30)) for _ in range(80)})

    def active(key, day):
        out = []
        for action in ("drop", "keep"):
            before = sorted((at, change) for k, a, change, at in moves if (k, a) == (key, action) and at <= day)
            if before and before[-1][1] == "add":
                out.append((before[-1][0], action == "keep", key, action))
        return out

    def verdict(url, day):
        host, first = url[7:].split("/")[:2]
        names = [(1001, f"p:{host}/{first}")] + [(3 - i, "d:" + host.split(".", i)[-1]) for i in range(3)]
        found = [(depth, *x) for depth, key in names for x in active(key, day)]
        return max(found)[3:] if found else (None, None)

    got = {r["page_id"]: (r["entry"], r["action"]) for r in u.evaluate(captures(spark, caps), changes(spark, moves)).collect()}
    assert got == {i: verdict(url, day) for i, url, day in caps}


def test_empty_tables(spark):
    assert u.evaluate(captures(spark, []), changes(spark, [])).count() == 0
    assert u.evaluate(captures(spark, [(1, "http://a.b", 1)]), changes(spark, [])).first()["kept"]


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, reply string")


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "u", "Hello there, world.\nSecond line"),
        (1, 1, "a", "On Monday X wrote:\n> Hello there, world.\n> Second line\nI agree."),
        (1, 2, "u", "> > hello there world\n> I agree.\nGood"),
        (1, 3, "u", "new topic"),
        (1, 4, "a", "> good\n\nok"),
        (1, 5, "a", "> unknown\nhm"),
        (2, 0, "u", None),
        (None, None, None, "x"),
        (2, 1, "u", "> good\n"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in q.link_quotations(messages(spark, rows)).collect()}
    told = lambda k: (got[k]["reply"], got[k]["reply_to"], got[k]["thread"], got[k]["depth"], got[k]["position"])
    assert told((1, 1)) == ("I agree.", 0, 0, 1, 1)
    assert told((1, 2)) == ("Good", 1, 0, 2, 2)
    assert told((1, 4)) == ("ok", 2, 0, 3, 3)
    assert told((1, 3)) == ("new topic", None, 3, 0, 4)
    assert told((1, 5)) == ("hm", None, 5, 0, 5)
    assert told((2, 0)) == ("", None, 0, 0, 0)
    assert told((2, 1)) == ("", None, 1, 0, 1)  # the passage is of another conversation
    assert told((None, None))[:2] == ("x", None)


def test_long_conversation_with_a_repeated_passage(spark):
    """Each quote goes to the latest of many equal originals, across blocks of turns."""
    n = 1200
    rows = [(1, i, "u", "> same words\nanswer" if i % 3 == 2 else "same words") for i in range(n)]
    got = q.link_quotations(messages(spark, rows)).orderBy("position").collect()
    assert all(r["reply_to"] == r["turn"] - 1 for r in got if r["turn"] % 3 == 2)
    assert [r["position"] for r in got] == list(range(n))
    place = {r["turn"]: r["position"] for r in got}
    assert all(place[r["reply_to"]] < r["position"] for r in got if r["reply_to"] is not None)


def test_chat_edges(spark):
    assert q.link_quotations(messages(spark, [])).count() == 0
    got = q.link_quotations(messages(spark, [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 1, "u", ">a"), (1, 1, "u", ">a")])).collect()
    assert len(got) == 4 and sorted(r["position"] for r in got) == [0, 1, 2, 3]


def threaded(rows):
    """The same by plain loops: every message against all before it. Rows (conv_id, turn, text), one a turn."""
    import re

    def normal(text):
        return re.sub(r"[\W_]+", " ", text.lower()).strip()

    def parse(text):
        runs = []
        for line in text.split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            level = marks.count(">")
            body = line[len(marks) :] if level else line
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(body)
        own, quotes = [], set()
        for i, (level, bodies) in enumerate(runs):
            if level:
                quotes |= {(level, normal(x)) for x in ["\n".join(bodies), *bodies]}
            else:
                announced = i + 1 < len(runs) and re.match(r"(?i)on\b.*\bwrote:$", bodies[-1])
                own.append("\n".join(bodies[:-1] if announced else bodies))
        return "\n".join(own).strip(), sum(1 for level, _ in runs if level), {x for x in quotes if x[1]}

    out = {}
    for conv in {c for c, _, _ in rows}:
        said = {turn: parse(text) for c, turn, text in rows if c == conv}
        has = {turn: {normal(p) for p in [reply, *re.split(r"\n\s*\n", reply), *reply.split("\n")]} for turn, (reply, _, _) in said.items()}
        parent, linked = {}, {}
        for turn, (_, _, quotes) in said.items():
            origins = [(level, max((o for o in said if o < turn and key in has[o]), default=None)) for level, key in quotes]
            linked[turn] = sum(o is not None for _, o in origins)
            parent[turn] = max((o for level, o in origins if level == 1 and o is not None), default=None)

        def chain(turn, parent=parent):
            return 0 if parent[turn] is None else 1 + chain(parent[turn])

        def root(turn, parent=parent):
            return turn if parent[turn] is None else root(parent[turn])

        for position, turn in enumerate(sorted(said, key=lambda x: (root(x), x))):
            out[conv, turn] = (said[turn][0], said[turn][1], linked[turn], parent[turn], root(turn), chain(turn), position)
    return out


def test_against_plain_loops(spark):
    """Random conversations that quote whole messages, paragraphs, lines, quotes of quotes, and nothing known."""
    import random

    deal = random.Random(11)
    words = "red green blue stone river cloud paper north seven apple".split()
    rows = []
    for conv in range(40):
        replies, texts = [], []
        for turn in range(deal.randint(1, 25)):
            reply = "\n".join(" ".join(deal.choices(words, k=deal.randint(1, 3))) + deal.choice(["", ".", "!"]) if deal.random() < 0.85 else "" for _ in range(deal.randint(1, 4))).strip()
            text, kind = reply, deal.random()
            if replies and kind < 0.7:
                i = deal.randrange(len(replies))
                quoted = deal.choice([replies[i], texts[i], deal.choice(replies[i].split("\n")), "nobody said this"])
                text = "\n".join(deal.choice(["> ", ">"]) + deal.choice([x, x.upper()]) for x in quoted.split("\n"))
                text = deal.choice(["", "On Monday someone wrote:\n", "Well.\n"]) + text + ("\n" + reply if kind < 0.6 else "")
            replies.append(reply)
            texts.append(text)
            rows.append((conv, turn, text))
    got = q.link_quotations(messages(spark, [(c, turn, "u", text) for c, turn, text in rows])).collect()
    want = threaded(rows)
    assert {(r["conv_id"], r["turn"]): (r["reply"], r["n_quotes"], r["n_linked"], r["reply_to"], r["thread"], r["depth"], r["position"]) for r in got} == want
    assert sum(x[2] for x in want.values()) > 200
