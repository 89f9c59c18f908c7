"""Exact n-gram Jaccard join that skips by relations between sets.

A set's shingles are put in one order for all sets: rare first, by a sketch of counts of fixed size, then by
hash. Two sets that link share one of the first shingles of both (the prefix), so lists of sets by
prefix shingle hold every candidate. Two kinds of work are skipped:

* in a list, blocks of entries whose sizes and places rule out enough common shingles;
* answers that follow from another set's: sets with equal shingles are one node; the first set of
  a list (the pivot) is compared with the others first, and those that link take over its
  component; the answers of the rest of its group are derived from differences to it; only pairs
  of different components in a list that no such group has settled are then compared one by one.

A group or list that is too large for a task is cut into tiles: one copy of each member for every
tile of those outside the pivot's component, so that near copies cost a copy each however many
they are, and only sets that share shingles without linking are compared tile by tile.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of, count_of, durable, map_texts, stretches, text_or_empty
from .components import components, extended

#: The sketch has 2 ** SKETCH_BITS counts, and moves in blocks.
SKETCH_BITS = 20
BLOCKS = 16
#: Sets, and shingles of sets, that one task holds as a tile; larger groups are cut into tiles.
TILE = 1024
TILE_SHINGLES = 1 << 19
#: Entries of one shingle that are sorted together; by the sketch's count, longer lists are salted.
LIST = 20_000
#: Entries that a list skips at once.
SKIP = 64
#: Tasks among which the members of one group are dealt where they meet what is known of the group.
SALTS = 16
#: Bits of the filter that tells which texts are needed again; passing it wrongly does no harm.
FILTER_BITS = 23


_GAP = re.compile(rb"[\x20\x09-\x0D]+")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte; A-Z have those of a-z.
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of texts that are hashed together; longer texts are hashed in stretches of about so many.
_CHUNK = 1 << 18


def _step_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""
    step, out = int(_MIX[0]), []
    for factor in (step, pow(step, -1, 1 << 64)):
        row = np.full(n, factor, dtype=np.uint64)
        row[0] = 1
        out.append(np.cumprod(row))
    return out[0], out[1]


_POWERS = _step_powers(2 * _CHUNK)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, first word of each text and the end).

    A word's hash is the sum of its bytes' numbers times powers of an odd number, taken from one
    running sum over all texts and moved to the word's begin by the inverse power, then mixed.
    """
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]  # the data end in a space
    up, down = _POWERS if len(data) < len(_POWERS[0]) else _step_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return _mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, begins)


def _stretches(text: bytes) -> list[bytes]:
    """A long text cut between words; only a single word can make a stretch longer than _CHUNK or so."""
    out, at = [], 0
    while len(text) - at > _CHUNK:
        cut = _GAP.search(text, at + _CHUNK)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def shingles_of(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    Words are runs without ASCII white space, with A-Z lower-cased. A text of fewer words is one
    shingle; one without words has none. Long texts are hashed stretch by stretch.
    """
    out: list[np.ndarray] = []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    while len(out) < len(raw):
        size, end = 0, len(out)
        while end < len(raw) and (end == len(out) or size + len(raw[end]) < _CHUNK):
            size += len(raw[end]) + 1
            end += 1
        if size > 2 * _CHUNK:
            parts = [_word_hashes([x])[0] for x in _stretches(raw[len(out)])]
            word = np.concatenate(parts)
            first = np.array([0, len(word)])
        else:
            word, first = _word_hashes(raw[len(out) : end])
        n = len(word) - words + 1
        whole = np.empty(0, np.uint64)
        if n > 0:
            whole = word[:n] + np.uint64(words)
            for j in range(1, words):
                whole = whole * _MIX[0] + word[j : n + j]
            whole = _mixed(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(whole[a : b - words + 1]))
            else:
                short = word[a : min(b, a + 1)] + np.uint64(b - a)
                for j in range(a + 1, b):
                    short = short * _MIX[0] + word[j : j + 1]
                out.append(_mixed(short))
    return out


def _sets(packed: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The shingles of compressed texts, of which only a stretch is expanded at once."""
    cache_of("")
    expand, held, size = zstandard.ZstdDecompressor(), [], 0
    for z in packed:
        held.append(expand.decompress(z.as_py()).decode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= _CHUNK:
            yield from shingles_of(held, words)
            held, size = [], 0
    yield from shingles_of(held, words)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def node_of(found: np.ndarray) -> int:
    """One 64-bit name for each set of shingles."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64)))


def _cell(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents have a shingle in each of 2 ** SKETCH_BITS cells, over all documents.

    Only an order comes from it, so sharing a cell costs no result. Each task sends its counts as
    compressed blocks; the sum has a fixed size, 4 MB.
    """
    size = 1 << SKETCH_BITS
    per = size // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("")
        counts = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            for at, end in stretches(batch.column(0)):
                for found in shingles_of(batch.column(0)[at:end].to_pylist(), words):
                    counts[_cell(found)] += 1  # cells that a text meets twice count once
        blocks = [zlib.compress(counts[i * per : (i + 1) * per].tobytes(), 1) for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), dtype=np.uint32)
                sums[block] = sums[block] + counts if block in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    summed = docs.select(text_or_empty().alias("t")).mapInArrow(count, schema).repartition(BLOCKS, "block").mapInArrow(add, schema)
    out = np.zeros(size, dtype=np.uint32)
    for row in summed.collect():  # BLOCKS rows, of 4 MB together
        out[row["block"] * per : (row["block"] + 1) * per] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
    return out


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", text_or_empty()).alias("row"))


def _prefixes(docs: DataFrame, sketch, words: int, percent: int) -> DataFrame:
    """doc_id, row, n, node and the prefix (its hashes as bytes) of each document, the last only
    where this task first meets the node: copies add at most one prefix a task. ``row`` is a hash
    of id and text."""

    def make():
        counts, seen = sketch.value, set()

        def each(texts: list[str]) -> list[tuple]:
            out = []
            for found in shingles_of(texts, words):
                n = len(found)
                if not n:
                    out.append((0, None, None))
                    continue
                node = node_of(found)
                prefix = None
                if node not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(node)
                    first = n + percent * n // -100 + 1  # n - ceil(percent n / 100) + 1
                    prefix = found[np.argsort(counts[_cell(found)], kind="stable")[:first]].tobytes()
                out.append((n, node, prefix))
            return out

        return each

    return map_texts(_with_row(docs), ["doc_id", "row"], [("n", "int"), ("node", "long"), ("prefix", "binary")], make)


_ENTRY = "token long, order int, node long, n int, pos int"


def _entries(sketch, percent: int):
    """(node, n, prefix) -> a row for each shingle of the prefix. A set can link with one of its own
    size only where enough of it is left (else it is late). Where the sketch counts more than LIST
    sets with a shingle, they are dealt to so many salts, from 1, that about LIST have one. ``order``
    is twice the salt, and one more where late."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                prefixes = batch.column(2).to_pylist()
                lengths = [len(p) // 8 for p in prefixes]
                token = np.frombuffer(b"".join(prefixes), dtype=np.uint64)
                node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
                n = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32), lengths)
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                salts = -(-counts[_cell(token)].astype(np.int64) // LIST)
                salt = np.where(salts > 1, 1 + (_mixed(node.view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64), 0)
                late = n - pos < _needed(n.astype(np.int64), n, percent)
                columns = [token.view(np.int64), (2 * salt + late).astype(np.int32), node, n, pos]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "order", "node", "n", "pos"])

    return run


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Common shingles that sets of sizes a and b need to link."""
    return -(-percent * (a + b) // (100 + percent))


_LISTED = "token long, node long, n int, pos int, pivot long, star int"
#: In place of star: the pivot is that of one salt only. Added to it: all of the list meet the pivot.
SALTED, SETTLED = 2, 4
#: Entries of a list that are held until its end is seen.
HOLD = 4096


def _shared_lists(percent: int):
    """Entries sorted by (token, order, node) -> those of lists that can hold links, with the list's
    first node (the pivot) and whether both may link here (star).

    Lists of one node go, and those of two that can't link. Where all may link with the pivot, its
    group settles the list. A list longer than HOLD is passed on as it comes, unsettled.
    """

    def listed(columns: list[np.ndarray], going: dict | None, whole: bool) -> tuple[pa.RecordBatch, dict | None]:
        """The rows of lists, of which the first may go on from before and the last go on (not ``whole``)."""
        token, order, node, n, pos = columns
        salt = order >> 1
        new = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
        starts = np.flatnonzero(new)
        first = np.repeat(starts, np.diff(np.r_[starts, len(new)]))
        pivot, pivot_n, pivot_pos = node[first], n[first], pos[first]
        on = going is not None and going["key"] == (token[0], salt[0])
        if on:
            for c, x in zip((pivot, pivot_n, pivot_pos), going["pivot"], strict=True):
                c[first == 0] = x
        star = (node == pivot) | (np.minimum(n - pos, pivot_n - pivot_pos) >= _needed(n, pivot_n, percent))
        many, all_star = np.diff(np.r_[starts, len(new)]), np.logical_and.reduceat(star, starts)
        long_ = np.zeros(len(starts), dtype=bool)
        long_[0], long_[-1] = on, long_[-1] or not whole or (on and len(starts) == 1)
        salted = salt[starts] > 0
        settled = all_star & ~long_ & ~salted
        keep = long_ | salted | (many > 2) | ((many == 2) & all_star)
        code = np.where(np.repeat(salted, many), SALTED, star + SETTLED * np.repeat(settled, many))
        rows = np.repeat(keep, many)
        if on and node[0] == going["last"]:
            rows[0] = False
        made = [token, node, n.astype(np.int32), pos.astype(np.int32), pivot, code.astype(np.int32)]
        state = {"key": (token[-1], salt[-1]), "pivot": (pivot[-1], pivot_n[-1], pivot_pos[-1]), "last": node[-1]}
        return pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in made], names=["token", "node", "n", "pos", "pivot", "star"]), state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
        going = None
        for batch in batches:
            columns = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            if not len(columns[0]):
                continue
            token, order, node = columns[:3]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (order[1:] != order[:-1]) | (node[1:] != node[:-1])]
            columns = [c[fresh] for c in columns]
            token, salt = columns[0], columns[1] >> 1
            last = int(np.flatnonzero((token == token[-1]) & (salt == salt[-1]))[0])
            on = going is not None and last == 0 and going["key"] == (token[0], salt[0])
            if on or len(token) - last > HOLD:
                made, going = listed(columns, going, False)
                held = [np.empty(0, np.int64)] * 5
                yield made
            else:
                held = [c[last:] for c in columns]
                if last:
                    yield listed([c[:last] for c in columns], going, True)[0]
                    going = None
        if len(held[0]):
            yield listed(held, going, True)[0]

    return run


def _lists(entries: DataFrame, percent: int) -> DataFrame:
    """token, node, n, pos, pivot, star (whether node and pivot may link here) and settled (whether
    all of the list may) of every list that can hold links.

    Salts of one shingle that is very common get one pivot, the first of theirs: it is found among
    rows of the first of each salt and joined back by shingle and salt, so no task meets all sets
    that have the shingle.
    """
    dealt = entries.repartition(F.col("token"), F.shiftright("order", 1)).sortWithinPartitions("token", "order", "node")
    made = durable(dealt.mapInArrow(_shared_lists(percent), _LISTED))
    needed = lambda n, m: F.ceil(percent * (F.col(n).cast("long") + F.col(m)) / F.lit(100 + percent))
    salted = made.filter(F.col("star") == SALTED).drop("star").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    first = salted.groupBy("token", "salt").agg(F.min(F.struct((F.col("n") - F.col("pos") < needed("n", "n")).alias("late"), "node", "n", "pos")).alias("x"))
    best = first.groupBy("token").agg(F.min("x").alias("top"))
    best = first.join(best, "token").select("token", "salt", F.col("top.node").alias("pivot"), F.col("top.n").alias("pivot_n"), F.col("top.pos").alias("pivot_pos"))
    one = salted.drop("pivot").join(best, ["token", "salt"])
    star = (F.col("node") == F.col("pivot")) | (F.least(F.col("n") - F.col("pos"), F.col("pivot_n") - F.col("pivot_pos")) >= needed("n", "pivot_n"))
    one = durable(one.select("token", "node", "n", "pos", "pivot", star.alias("star"), F.lit(False).alias("settled")))
    rest = made.filter(F.col("star") != SALTED).withColumn("settled", F.col("star") >= SETTLED).withColumn("star", F.col("star") % 2 == 1)
    return rest.unionByName(one)


def list_pairs(asked: list[np.ndarray], held: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a set of ``asked`` and one of ``held`` (node, n, pos, comp, star, outside
    each) of one list, in different components, but for those of two sets that were both compared
    with the pivot: its group has settled them. Pairs of two sets outside the pivot's component,
    which would come up twice, are told once.

    Held entries lie by size and then by place. A probe begins and ends at the sizes that can link,
    and skips whole blocks in which even the most that remains after any entry's place is too little.
    """
    order = np.lexsort((held[2], held[1]))
    node, n, pos, comp, star, outside = (x[order] for x in held)
    n = n.astype(np.int64)
    rest = n - pos
    starts = np.arange(0, len(n), SKIP)
    most_rest, least_n = np.maximum.reduceat(rest, starts), n[starts]
    for node_i, n_i, pos_i, comp_i, star_i in zip(*(x.tolist() for x in asked[:5]), strict=True):
        low, end = int(np.searchsorted(n, -(-percent * n_i // 100))), int(np.searchsorted(n, 100 * n_i // percent, side="right"))
        if end <= low:
            continue
        b0, b1, rest_i = low // SKIP, (end - 1) // SKIP + 1, n_i - pos_i
        go = np.minimum(rest_i, most_rest[b0:b1]) >= _needed(n_i, least_n[b0:b1], percent)
        for b in np.flatnonzero(go) + b0:
            s, e = max(low, b * SKIP), min(end, (b + 1) * SKIP)
            ok = (comp[s:e] != comp_i) & (np.minimum(rest_i, rest[s:e]) >= _needed(n_i, n[s:e], percent)) & ~(outside[s:e] & (node[s:e] < node_i))
            if star_i:
                ok &= ~star[s:e]
            if ok.any():
                others = node[s:e][ok]
                yield np.minimum(node_i, others), np.maximum(node_i, others)


def _cross_pairs(percent: int):
    """Rows of (token, c1, c2, kind, node, n, pos, comp, star, outside), sorted by the first three -> pairs."""

    def flush(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([p[i] for p in parts]) for i in range(10)]
        asks = columns[3] == 0
        left, right, many = [], [], 0
        if asks.any() and not asks.all():
            for a, b in list_pairs([c[asks] for c in columns[4:]], [c[~asks] for c in columns[4:]], percent):
                left.append(a)
                right.append(b)
                many += len(a)
                if many >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
                    left, right, many = [], [], 0
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        key = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(10)]
            if not len(columns[0]):
                continue
            changes = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])) + 1
            for s, e in zip(np.r_[0, changes], np.r_[changes, len(columns[0])], strict=True):
                here = (columns[0][s], columns[1][s], columns[2][s])
                if key is not None and here != key:
                    yield from flush(parts)
                    parts = []
                key = here
                parts.append([c[s:e] for c in columns])
        if parts:
            yield from flush(parts)

    return run


def _with_group(members: DataFrame, key: str, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Members (with ``node``) joined to what is known of their group, one row each in ``groups``;
    the members of one group are dealt to SALTS tasks."""
    known = groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(known, [key, "salt"], how).drop("salt")


def _tiled(members: DataFrame, key: str, extra: list[str], tile_of: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, node, n, outside and ``extra``) of groups -> (key, c1, c2, kind, node, ...), and
    the pairs of tiles (key, c1, c2).

    Those outside (kind 0) are dealt to tiles c1, all members (kind 1) to tiles c2, and each pair of
    tiles meets once: a group with few outside costs a copy of each member and few more.
    """
    of = lambda n, size: F.ceil(F.greatest(n / tile_of, size / TILE_SHINGLES)).cast("int")
    out = F.when(F.col("outside"), F.col("n").cast("long"))
    sizes = members.groupBy(key).agg(of(F.count(out), F.coalesce(F.sum(out), F.lit(0))).alias("t1"), of(F.count("*"), F.sum(F.col("n").cast("long"))).alias("t2")).filter("t1 > 0")
    dealt = _with_group(members, key, sizes)
    tile = lambda t: F.pmod(F.xxhash64("node", F.lit(1)), F.col(t)).cast("int")
    every = lambda t: F.explode(F.sequence(F.lit(0), F.col(t) - 1))
    columns = ["node", "n", *extra, "outside"]
    asked = dealt.filter("outside").select(key, tile("t1").alias("c1"), every("t2").alias("c2"), F.lit(0).alias("kind"), *columns)
    held = dealt.select(key, every("t1").alias("c1"), tile("t2").alias("c2"), F.lit(1).alias("kind"), *columns)
    return asked.unionByName(held), sizes.select(key, every("t1").alias("c1"), "t2").select(key, "c1", every("t2").alias("c2"))


def _texts(docs: DataFrame, prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and a compressed text of it, one row for each node of ``pairs`` (a, b).

    A node's text comes from its document of least row hash. A filter of fixed size over those
    hashes lets few other texts through; the join that follows is exact. Texts are what costs most
    to move, so each is taken up only for pairs that will be compared, and repeated rows go where
    the join has brought them together.
    """
    chosen = prefixes.filter("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"))
    chosen = durable(chosen.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
    bits = 1 << FILTER_BITS
    per = bits // 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits, dtype=bool)
        for batch in batches:
            on[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        blocks = [(i, np.packbits(on[i * per : (i + 1) * per])) for i in range(64)]
        blocks = [(i, zlib.compress(x.tobytes(), 1)) for i, x in blocks if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
                sums[block] = sums[block] | x if block in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "bits"])

    marks = chosen.select("row").mapInArrow(mark, "block int, bits binary").repartition(8, "block").mapInArrow(merge, "block int, bits binary")
    on = np.zeros(bits, dtype=bool)
    for got in marks.collect():  # 64 rows, of 1 MB together
        on[got["block"] * per : (got["block"] + 1) * per] = np.unpackbits(np.frombuffer(zlib.decompress(got["bits"]), dtype=np.uint8)).astype(bool)
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(on).tobytes())

    def make():
        flags = np.unpackbits(np.frombuffer(wanted.value, dtype=np.uint8)).astype(bool)
        press = zstandard.ZstdCompressor(level=3)

        def each(texts: list[str], rows: list[int]) -> list[list[tuple]]:
            passes = flags[np.array(rows, dtype=np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)]
            return [[(press.compress(t.encode("utf-8", "surrogatepass")),)] if ok else [] for t, ok in zip(texts, passes.tolist(), strict=True)]

        return each

    packed = map_texts(_with_row(docs), ["row"], [("z", "binary")], make, several=True, extra=["row"])
    return durable(packed.join(chosen, "row").dropDuplicates(["row", "node"]).select("node", "z"))


def _dealt(pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """a, part, parts, kind, node, z: the text of a (kind 0) before those of its b (kind 1), in
    parts of about ``parts`` texts, so that a set with very many candidates is dealt to many tasks."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / parts, F.sum(F.col("n").cast("long")) / TILE_SHINGLES)).cast("int").alias("parts")).filter("parts > 1")
    known = _with_group(pairs.select("a", F.col("b").alias("node")), "a", sizes, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salted = known.select("a", F.col("node").alias("b"), "parts", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"))
    probes = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "parts", F.lit(1).alias("kind"), F.col("b").alias("node"), "z")
    heads = salted.select("a", "part", "parts").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", "parts", F.lit(0).alias("kind"), F.col("a").alias("node"), "z")
    return heads.unionByName(probes).repartition("a", "part").sortWithinPartitions("a", "part", "kind")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, n of b; distinct) that link, by their whole sets, two held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, dtype=np.uint64)
        for batch in batches:
            left, right = [], []
            for a, kind, node, found in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), _sets(batch.column(5), words), strict=True):
                if kind == 0:
                    head = found
                elif linked(len(np.intersect1d(head, found, assume_unique=True)), len(head), len(found), percent):
                    left.append(a)
                    right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return _dealt(pairs, texts, TILE).mapInArrow(run, "a long, b long")


def _links_of(nodes_a: list[int], nodes_b: list[int], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([nodes_a[i] for i, _ in found], pa.int64()), pa.array([nodes_b[j] for _, j in found], pa.int64())], names=["a", "b"])


def _star_links(stars: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of pivots a and their candidates b; of a group that one task holds also those
    that connect whatever links connect among the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        alone = False

        def flush() -> pa.RecordBatch:
            return _links_of(nodes, nodes, group_links(sets, percent, alone) if len(sets) > 1 else [])

        for batch in batches:
            for parts, kind, node, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), _sets(batch.column(5), words), strict=True):
                if kind == 0:
                    yield flush()
                    nodes, sets, alone = [], [], parts == 1
                nodes.append(node)
                sets.append(found)
        yield flush()

    return _dealt(stars, texts, TILE).mapInArrow(run, "a long, b long")


def _tile_links(stars: DataFrame, comps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) that connect whatever links connect among the candidates of a pivot whose group
    one task can't hold: its sets outside the pivot's component, tile by tile, against all. None
    where there is no such group."""
    large = stars.groupBy("a").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("size")).filter((F.col("m") > TILE) | (F.col("size") > TILE_SHINGLES))
    large = large.join(comps.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("comp", "a").alias("home_a"))
    held = _with_group(stars.select("a", F.col("b").alias("node"), "n"), "a", large).join(comps, "node", "left")
    held = held.select("a", "node", "n", F.coalesce("comp", "node").alias("home"), "home_a").withColumn("outside", F.col("home") != F.col("home_a"))
    held = durable(held)
    if not count_of(held):
        return None
    tiles, places = _tiled(held, "a", ["home"], TILE)
    tiles = tiles.select("a", "c1", "c2", (F.col("kind") + 1).alias("kind"), "node", "home")
    heads = places.select("a", "c1", "c2", F.lit(0).alias("kind"), F.col("a").alias("node"), F.lit(0).cast("long").alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, dtype=np.uint64)
        held: tuple[list, list] = ([], [])

        def flush() -> pa.RecordBatch:
            (left, right) = held
            found = derived_links(pivot, [x for *_, x in left], [x for *_, x in right], [h for _, h, _ in left], [h for _, h, _ in right], percent) if left and right else []
            return _links_of([x[0] for x in left], [x[0] for x in right], found)

        for batch in batches:
            for kind, node, home, found in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), _sets(batch.column(6), words), strict=True):
                if kind == 0:
                    yield flush()
                    pivot, held = found, ([], [])
                else:
                    held[kind - 1].append((node, home, found))
        yield flush()

    dealt = heads.unionByName(tiles).join(texts, "node").select("a", "c1", "c2", "kind", "node", "home", "z")
    return dealt.repartition("a", "c1", "c2").sortWithinPartitions("a", "c1", "c2", "kind").mapInArrow(run, "a long, b long")


def _differences(pivot: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes; then what sets lack of the pivot (set, place in the pivot) and have besides (set, shingle)."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    hit = pivot[at] == flat
    has = np.zeros((len(sets), len(pivot)), dtype=bool)
    has[owner[hit], at[hit]] = True
    return sizes, *np.nonzero(~has), owner[~hit], flat[~hit]


def derived_links(pivot: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], left_home: list[int], right_home: list[int], percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of links between ``left`` and ``right`` sets that connect whatever links connect
    among them, beyond what is connected already (equal homes).

    Two sets differ by what their differences from the pivot don't share, so a left set's answers
    follow from the lists of right sets by what those lack of the pivot or have besides. Memory is
    in proportion to the sets: one left set is counted at a time.
    """
    ln, l_lacks, l_place, l_more, l_extra = _differences(pivot, left)
    rn, r_lacks, r_place, r_more, r_extra = _differences(pivot, right)
    known = np.unique(r_extra)
    token = np.concatenate([r_place, len(pivot) + np.searchsorted(known, r_extra)])
    order = np.argsort(token, kind="stable")
    listed = np.concatenate([r_lacks, r_more])[order].astype(np.int32)
    starts = np.searchsorted(token[order], np.arange(len(pivot) + len(known) + 1))
    r_apart = np.bincount(listed, minlength=len(right))
    l_apart = np.bincount(np.concatenate([l_lacks, l_more]), minlength=len(left))
    place = np.searchsorted(known, l_extra)
    shared = np.zeros(len(place), dtype=bool)
    if len(known):
        shared = known[np.minimum(place, len(known) - 1)] == l_extra
    owner = np.concatenate([l_lacks, l_more[shared]])
    order = np.argsort(owner, kind="stable")
    asks = np.concatenate([l_place, len(pivot) + place[shared]])[order]
    bounds = np.searchsorted(owner[order], np.arange(len(left) + 1))
    homes = np.unique(np.concatenate([np.array(left_home, dtype=np.int64), np.array(right_home, dtype=np.int64)]), return_inverse=True)[1]
    home_l, home_r = homes[: len(left)], homes[len(left) :]
    links: list[tuple[int, int]] = []
    for i in range(len(left)):
        far = home_r != home_l[i]
        if not far.any():
            continue
        mine = asks[bounds[i] : bounds[i + 1]]
        first, many = starts[mine], starts[mine + 1] - starts[mine]
        before = np.cumsum(many) - many
        met = np.bincount(listed[np.repeat(first - before, many) + np.arange(int(many.sum()))], minlength=len(right))
        total = ln[i] + rn
        common = (total - (l_apart[i] + r_apart - 2 * met)) // 2
        for j in np.flatnonzero(far & (100 * common >= percent * (total - common))).tolist():
            was, now = home_r[j], home_l[i]
            if was != now:
                home_l[home_l == was] = now
                home_r[home_r == was] = now
                links.append((i, j))
    return links


def group_links(sets: list[np.ndarray], percent: int, alone: bool = True) -> list[tuple[int, int]]:
    """Places (i, j) of links of the first set, the pivot, and if the group is ``alone`` in its task
    also of links that connect whatever links connect among the others."""
    pivot = sets[0]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
    common = np.bincount(owner[hit], minlength=len(sets))
    near = 100 * common >= percent * (sizes[0] + sizes - common)
    links = [(0, i) for i in np.flatnonzero(near).tolist() if i]
    others = np.flatnonzero(~near)
    if not alone or not len(others) or len(sets) < 3:
        return links
    home = np.where(near, 0, np.arange(len(sets)))
    found = derived_links(pivot, [sets[i] for i in others], sets[1:], home[others].tolist(), home[1:].tolist(), percent)
    return links + [(int(others[i]), j + 1) for i, j in found]


def link_components(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link when their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; component_id is the smallest doc_id reachable by links. Shingles and
    sets are told apart by 64-bit hashes. Null and empty texts have no shingles and link with
    nothing; texts of equal sets link, repeated rows included; an empty table gives no rows.
    No cap is set on lists, candidates or components.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, words))
    prefixes = durable(_prefixes(docs, sketch, words, percent))
    entries = prefixes.filter("prefix IS NOT NULL").select("node", "n", "prefix").mapInArrow(_entries(sketch, percent), _ENTRY)
    lists = _lists(entries, percent)
    stars = durable(lists.filter("star AND node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "n").distinct())
    texts = _texts(docs, prefixes, stars)
    links = durable(_star_links(stars, texts, words, percent))
    comps = components(links)
    if (more := _tile_links(stars, comps, texts, words, percent)) is not None:
        more = durable(more)
        links = links.union(more)
        comps = extended(comps, more)

    known = lists.filter("NOT settled").select("token", "node", "n", "pos", "pivot", "star").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    home = F.max(F.when(F.col("node") == F.col("pivot"), F.col("comp"))).alias("home")
    open_ = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_and("star").alias("settled"), home).filter("lo < hi AND NOT settled").select("token", "home")
    cut = durable(_with_group(known, "token", open_).select("token", "node", "n", "pos", "comp", "star", (F.col("comp") != F.col("home")).alias("outside")))
    if count_of(cut):
        tiles, _ = _tiled(cut, "token", ["pos", "comp", "star"], max(1, TILE // 2))
        tiles = tiles.select("token", "c1", "c2", "kind", "node", "n", "pos", "comp", "star", "outside")
        crossing = tiles.repartition("token", "c1", "c2").sortWithinPartitions("token", "c1", "c2").mapInArrow(_cross_pairs(percent), "a long, b long").distinct()
        crossing = durable(crossing.join(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
        if count_of(crossing):
            texts = _texts(docs, prefixes, crossing)
            comps = extended(comps, durable(_verified(crossing.withColumn("n", F.lit(1)), texts, words, percent)))

    nodes = prefixes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = nodes.join(nodes.groupBy("comp").agg(F.min("least").alias("name")), "comp").select("node", "name")
    return prefixes.select("doc_id", "n", "node").join(names, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document of smallest id.

    Documents without words all stay. Rows equal in id and text count as one.
    """
    found = link_components(docs, words=words, percent=percent)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
