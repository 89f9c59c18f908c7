"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers do the rest."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Kinds in the order in which spans of one start are listed; the last three are added by the method.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn")
N_BASE = 4
DIGITS = "0123456789"
#: Cues: at-signs, plus signs and digits (numbers), schemes, and words (in any case) that announce an identifier.
CUES = ("@", "+", *DIGITS, "://", "iban", "ssn", "social security")
#: Lower case for ASCII only, which keeps places.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[A-Za-z0-9._~%+-]+:[^\s/@:]+@[A-Za-z0-9.-]*[A-Za-z0-9]")
LETTERS = re.compile(r"[A-Za-z]*")
IBAN = re.compile(r"[\x20:#=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
#: An IBAN that no word announces: its country says how long it is.
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
        "QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
IBAN_BODIES = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
SSN = re.compile(r"(?:[Nn][Uu][Mm][Bb][Ee][Rr]|[Nn][Oo]\.?)?[\x20:#=]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for cue in CUES:
        made.add_word(cue, cue)
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    """Of any number of digits."""
    plain = digits.lstrip("0")
    return len(plain) <= 3 and int(plain or 0) <= 255


def iban_valid(candidate: str) -> bool:
    plain = candidate.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ssn_valid(candidate: str) -> bool:
    a, b, c = candidate.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def spans(text: str, cues: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, found in one pass over the cues.

    Each kind keeps the end of its last match, so that expansion goes leftmost and without
    overlap, as a pattern search over the whole text would; a number's digits after the first are
    inside its match and start nothing. Failing matches are dropped and not tried again, but they
    do use up their characters.
    """
    found: list[tuple[int, int, int]] = []
    ibans: set[tuple[int, int]] = set()
    email_end = ip_end = card_end = phone_end = word_end = 0
    for last, cue in cues.iter(text.translate(LOWER)):
        at = last + 1 - len(cue)
        if cue in DIGITS:
            if at >= card_end and (m := CARD.match(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, card_end))
            if at >= 2 and text[at - 2 : at] in IBAN_LENGTHS and IBAN_START.match(text, at - 2):
                m = IBAN_BODIES[IBAN_LENGTHS[text[at - 2 : at]]].match(text, at - 2)
                if m and iban_valid(m.group()):
                    ibans.add(m.span())
            if at >= ip_end and (at == ip_end or text[at - 1] not in DIGITS) and (m := IP.match(text, at)):
                ip_end = m.end()
                if all(at_most_255(part) for part in m.group().split(".")):
                    found.append((at, 1, ip_end))
        elif cue == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif cue == "+":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                    found.append((at, 3, phone_end))
        elif cue == "://":
            if m := LOGIN.match(text, last + 1):
                found.append((m.start(), 4, m.end()))
        elif cue in ("ssn", "social security"):
            if (m := SSN.match(text, last + 1 + (text[last + 1 : last + 2] == " "))) and ssn_valid(m.group(1)):
                found.append((m.start(1), 6, m.end(1)))
        elif last >= word_end:  # another "iban" in the same word announces nothing else
            word_end = LETTERS.match(text, last + 1).end()
            for begin in (word_end - 2, word_end):  # "IBANDE89..." too
                if begin > last and (m := IBAN.match(text, begin)) and iban_valid(m.group(1)):
                    ibans.add(m.span(1))
                    break
    return sorted([*found, *((s, 5, e) for s, e in ibans)])


def digest(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each stretch that spans cover becomes the name of the first of them, in angle brackets."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """Personal data of every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Places are code points, end exclusive. The method adds spans of kinds login (user and password
    in an address), iban (checked) and ssn (after its cue) to the base kinds. Null and empty texts
    have none; repeated rows give repeated results; an empty table gives no rows.
    """

    def make():
        cues = automaton()

        def each(texts: list[str]) -> list[tuple]:
            rows = []
            for text in texts:
                found = spans(text, cues)
                base = digest([x for x in found if x[1] < N_BASE])
                rows.append((*(sum(x[1] == k for x in found) for k in range(N_BASE)), hashlib.sha256(base.encode()).hexdigest(), digest(found)))
            return rows

        return each

    fields = [("n_email", "long"), ("n_ip", "long"), ("n_card", "long"), ("n_phone", "long"), ("base_sha256", "string"), ("spans", "string")]
    return map_texts(docs, ["doc_id"], fields, make)


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced by placeholders; n_chars, where there is one, follows.

    Null texts stay null. Row order is not kept; all other columns are unchanged.
    """
    plain = [c for c in docs.columns if c not in ("text", "n_chars")]

    def make():
        cues = automaton()
        return lambda texts: [(redact(text, spans(text, cues)),) for text in texts]

    out = map_texts(docs.withColumn("aw_null", F.col("text").isNull()), [*plain, "aw_null"], [("text", "string")], make)
    out = out.withColumn("text", F.when(~F.col("aw_null"), F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
