"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sample_of, text_or_empty

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"({'|'.join(any_case(w) for w in _NAMES)})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A whole run of hex digits that is long enough; shorter runs fail either way.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A cue that must be in a lower-cased text for ASSIGN to match; quick to look for.
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the models judge: long strings of one run.
LEAST = 20
LONG = 4096
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
DIGITS, MARKS = "0123456789", "+/_=-"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
PLACE = {c: i for i, c in enumerate(ALPHABET)}
THRESHOLD = 1.0


def markov(samples: Iterable[str], smoothing: float = 0.5) -> np.ndarray:
    """Log-probabilities of a character given the one before; the last row is the start."""
    n = len(ALPHABET)
    counts = np.full((n + 1, n), smoothing)
    for sample in samples:
        before = n
        for c in sample:
            if (here := PLACE.get(c)) is not None:
                counts[before, here] += 1
                before = here
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def log_ratio(random_model: np.ndarray, plain_model: np.ndarray) -> list[list[float]]:
    return (random_model - plain_model).tolist()


def mean_ratio(ratio: list[list[float]], candidate: str) -> float:
    """Mean log-likelihood ratio a character: above 0, a random string explains it better."""
    total, before = 0.0, len(ALPHABET)
    for c in candidate:
        here = PLACE[c]
        total += ratio[before][here]
        before = here
    return total / max(1, len(candidate))


def random_samples(n: int, seed: int = 7) -> list[str]:
    """Labelled samples of random strings: keys as generators of credentials write them."""
    deal = random.Random(seed)
    sets = (ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "0123456789ABCDEF")
    return ["".join(deal.choice(sets[i % len(sets)]) for _ in range(deal.randint(20, 64))) for i in range(n)]


#: Words of identifiers as programs and addresses have them.
PLAIN_WORDS = (
    "user name value index count total page list item node table column row text file path image source target client server request response session cookie "
    "header body message error status code type class object array string number date time year month version config option default internal external public "
    "private static final data model view control manager factory service handler parser reader writer buffer stream thread process worker queue cache storage"
).split()


def identifiers(n: int = 3000, seed: int = 3) -> list[str]:
    """Labelled samples of ordinary identifiers, joined as programs and addresses join words."""
    deal = random.Random(seed)
    out = []
    for i in range(n):
        words = [deal.choice(PLAIN_WORDS) for _ in range(deal.randint(2, 5))]
        number = str(deal.choice((deal.randint(0, 99), deal.randint(1990, 2030)))) if i % 3 == 0 else ""
        forms = ("_".join(words), "-".join(words), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]), "/".join(words), "_".join(words).upper(), "".join(words))
        out.append(forms[i % len(forms)] + number)
        if i % 10 == 0:
            out.append(deal.choice(MARKS) * deal.randint(4, 40))  # a ruled line
    return out


def plain_samples(docs: DataFrame, bound: int = 2000, words: int = 40) -> list[str]:
    """Labelled samples of ordinary identifiers: words of a bounded sample of documents.

    The sample is dealt by hash: about ``bound`` different documents and about ``words`` runs of three
    words of each, from anywhere in its text. Neighbouring words are joined as identifiers are
    (snake_case, kebab-case, camelCase, paths), some with a number, so that word boundaries and
    versions look ordinary too. What a fixed pattern of secrets finds is cut out first.
    """
    text = F.regexp_replace(text_or_empty(), f"{ASSIGN.pattern}|{ACCESS.pattern}|{HEX.pattern}", " ")
    found = F.filter(F.split(text, r"[^A-Za-z]+"), lambda w: w != "")
    part = sample_of(docs.select("doc_id", "text"), ["doc_id", "text"], bound).dropDuplicates().select("doc_id", found.alias("w"))
    runs = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(i.alias("i"), F.slice("w", i + 1, 3).alias("w"))),
        lambda r: F.pmod(F.xxhash64("doc_id", r["i"]), F.size("w")) < words,
    )
    rows = part.select("doc_id", F.when(F.size("w") > 2, runs).alias("runs")).filter("runs IS NOT NULL").collect()
    out: list[str] = []
    for row in sorted(rows, key=lambda r: (str(r["doc_id"]), r["runs"])):
        k = zlib.crc32(str(row["doc_id"]).encode())
        for i, (a, b, c) in row["runs"]:
            joined = (f"{a}_{b}_{c}", f"{a}-{b}-{c}", a.lower() + b.capitalize() + c.capitalize(), f"{a}/{b}/{c}", (a + "_" + b).upper(), a + b + c)
            out.append(joined[(k + i) % len(joined)] + (str((k + i) % 2030) if i % 4 == 0 else ""))
    return out + identifiers()


def train(docs: DataFrame, *, bound: int = 2000, words: int = 40) -> list[list[float]]:
    """The ratio table of both models, trained from labelled samples; its size is fixed (68 x 67)."""
    plain = plain_samples(docs, bound, words)
    return log_ratio(markov(random_samples(max(2000, len(plain)))), markov(plain))


def spans(text: str, ratio: list[list[float]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order. Base spans stay; a span of the models overlaps none of them."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    begins, ends = [], []  # of base spans, joined where they overlap
    for s, _, e in sorted(found):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    for m in CANDIDATE.finditer(text):
        s = m.start()
        for i, j in random_parts(m.group(), ratio, threshold):
            k = bisect_right(ends, s + i)
            if k == len(ends) or begins[k] >= s + j:
                found.append((s + i, 3, s + j))
    return sorted(found)


def random_parts(run: str, ratio: list[list[float]], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(start, end) of what the model of random strings explains better by far.

    The whole run, where its mean ratio is above the threshold; else stretches of LEAST characters or
    more whose ratios sum to more than threshold * LEAST: the best stretch, then those on either side
    of it. A stretch goes on to the marks that bound its words. Digits alone are a number.
    """
    if mean_ratio(ratio, run) > threshold:
        return [(0, len(run))] if run.strip(MARKS + DIGITS) else []
    out, open_ = [], [(0, len(run))]
    while open_:
        low, high = open_.pop()
        s, e = best_stretch(run, low, high, ratio, threshold * LEAST)
        if s == e:
            continue
        while s > low and run[s - 1] not in MARKS:
            s -= 1
        while e < high and run[e] not in MARKS:
            e += 1
        if run[s:e].strip(MARKS + DIGITS):
            out.append((s, e))
        open_ += [(low, s), (e, high)]
    return sorted(out)


def best_stretch(run: str, low: int, high: int, ratio: list[list[float]], least: float) -> tuple[int, int]:
    """The stretch of LEAST characters or more with the highest sum of ratios, if that is above ``least``."""
    sums, before = [0.0], len(ALPHABET) if low == 0 else PLACE[run[low - 1]]
    for c in run[low:high]:
        here = PLACE[c]
        sums.append(sums[-1] + ratio[before][here])
        before = here
    best, found, lowest = least, (0, 0), 0
    for e in range(LEAST, len(sums)):
        if sums[e - LEAST] < sums[lowest]:
            lowest = e - LEAST
        if sums[e] - sums[lowest] > best:
            best, found = sums[e] - sums[lowest], (low + lowest, low + e)
    return found


def digest(found: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, *, bound: int = 2000, words: int = 40, threshold: float = THRESHOLD) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Base kinds are the fixed patterns; the Markov models add spans of kind ``markov``. Places are
    code points, end exclusive. Null and empty texts have no spans (base_sha256 is that of the empty
    string); repeated rows give repeated results; an empty table gives no rows and trains on a
    built-in sample. The models learn from about ``bound`` documents, ``words`` samples of each.
    """
    ratio = train(docs, bound=bound, words=words)

    def make():
        def each(texts: list[str]) -> list[tuple]:
            rows = []
            for text in texts:
                found = spans(text, ratio, threshold)
                base = digest([x for x in found if x[1] < 3], KINDS)
                rows.append((*(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), digest(found, KINDS)))
            return rows

        return each

    fields = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("n_markov", "long"), ("base_sha256", "string"), ("spans", "string")]
    return map_texts(docs, ["doc_id"], fields, make)
