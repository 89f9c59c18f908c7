from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from assetweave.llm import pii
from assetweave.llm import secret_scan as s

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])


def secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24])


CUES = pii.automaton()
RATIO = s.log_ratio(s.markov(s.random_samples(2000)), s.markov(s.identifiers()))


@settings(max_examples=400, deadline=None)
@given(st.text("01239 -.+@()ab%_é", max_size=120))
def test_personal_data_like_patterns(text):
    assert [x for x in pii.spans(text, CUES) if x[1] < pii.N_BASE] == personal(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["pass", "word", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "abcdef", "0123456789", "AKIA", "ABCDEFGH12345678", "é", "ſ", "."]), max_size=25))
def test_secrets_like_patterns(parts):
    text = "".join(parts)
    assert [x for x in s.spans(text, RATIO) if x[1] < 3] == secrets(text)


def test_personal_data_rows(documents):
    texts = ["write to a.b@c.de or +49 (30) 123-4567, host 10.0.0.256 10.0.0.25", None, "", "é 4111 1111 1111 1111", "https://user:pw@host.org/x iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789", "a@b.c"]
    got = {r["doc_id"]: r for r in pii.find(documents(texts, extra=True, ids=[0, 1, 2, 3, 4, None])).collect()}
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_phone"]) == (1, 1, 1)
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["n_card"] == 1 and got[3]["spans"] == "card:2:21"
    assert "login:" in got[4]["spans"] and "iban:" in got[4]["spans"] and "ssn:" in got[4]["spans"]
    assert got[None]["n_email"] == 1
    assert pii.find(documents([])).count() == 0


def test_redaction(documents):
    df = documents(["mail x@y.org now", None, "clean"], extra=True)
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert out[0]["text"] == "mail <email> now" and out[0]["n_chars"] == len("mail <email> now")
    assert out[1]["text"] is None and out[2]["text"] == "clean"
    assert pii.redacted(df).columns == df.columns


def test_secret_models(documents):
    deal = random.Random(11)
    keys = ["".join(deal.choice(s.ALPHABET[:62]) for _ in range(40)) for _ in range(200)]
    names = ["internal_request_counter_2024_total", "HttpConnectionPoolManager2Factory3Impl4", "docs/en/source/index3/page12/part4", "chapter-12-section-34-paragraph-56"] * 20
    caught = sum(any(k == 3 for _, k, _ in s.spans(f"see {key} here", RATIO)) for key in keys)
    assert caught >= 170
    assert not any(s.spans(f"see {n} here", RATIO) for n in names)
    texts = [f"ordinary words about the house and the garden {i}" for i in range(50)] + [f"x {keys[0]} y", None, "", "password = hunter22 token: 'abc'"]
    got = {r["doc_id"]: r for r in s.scan(documents(texts, extra=True)).collect()}
    assert got[50]["n_markov"] == 1 and not any(got[i]["spans"] for i in range(50))
    assert got[53]["spans"] == "assign:0:19" and got[51]["spans"] == ""
    assert s.scan(documents([])).count() == 0


def test_keys_after_names_and_in_paths():
    deal = random.Random(12)
    for before in ("client_credential=", "/users/account/settings/download/", "AWS_SECRET_ACCESS_KEY="):
        caught = 0
        for _ in range(100):
            text = f"see {before}{''.join(deal.choice(s.ALPHABET[:62]) for _ in range(40))} here"
            at = 4 + len(before)
            caught += any(k == 3 and a <= at + 2 and b >= at + 38 for a, k, b in s.spans(text, RATIO))
        assert caught >= 90


def test_keys_of_letters_and_of_any_length():
    deal = random.Random(13)
    for n in (20, 24, 32, 40):
        for letters in (52, 62):
            keys = ["".join(deal.choice(s.ALPHABET[:letters]) for _ in range(n)) for _ in range(100)]
            assert sum(any(k == 3 for _, k, _ in s.spans(f"see {key} here", RATIO)) for key in keys) >= 85
    assert not any(k == 3 for x in ("=" * 40, "-" * 30, "_" * 25, "1234567890" * 3) for _, k, _ in s.spans(f"see {x} here", RATIO))


def test_cues_in_any_case_and_ibans_without_one():
    for text in ("Social Security 123-45-6789", "SOCIAL SECURITY NUMBER: 123-45-6789", "Ssn 123-45-6789", "SSN Number: 123-45-6789"):
        assert [text[a:b] for a, k, b in pii.spans(text, CUES) if k == 6] == ["123-45-6789"]
    iban = "DE89 3704 0044 0532 0130 00"
    for text in (f"pay to {iban} today", f"pay {iban.replace(' ', '')}.", f"iBaN: {iban}", f"IBAN {iban}", f"{iban} THAT IS IT"):
        assert [text[a:b].replace(" ", "") for a, k, b in pii.spans(text, CUES) if k == 5] == [iban.replace(" ", "")]
    assert not [x for x in pii.spans("pay DE88 3704 0044 0532 0130 00 or XDE89370400440532013000", CUES) if x[1] == 5]
