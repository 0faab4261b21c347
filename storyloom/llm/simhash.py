"""SimHash near-duplicates, compared bit by bit over vertical planes.

A fingerprint has one bit per column of the shingles' hashes: set where more
than half of the hashes have it.  Fingerprints are compared in blocks stored
vertically, plane b holding bit b of 64 fingerprints in one word.  The
differences of a query to a whole block go into carry-save counters (one bitwise
adder for 64 distances), and a word is abandoned as soon as all of its 64
distances are beyond the radius.

Which fingerprints meet is decided by blocking keys.  For 64 bits and radius r
the keys are exact: of r + 2 parts two at least agree, so every link has a key in
common (:func:`part_keys`).  For wide fingerprints of whole documents the keys
are minima of shingle hashes (:func:`sketch`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm import shared_files
from storyloom.llm.common import LOWER, components, frames, groups, octets, stored

#: Fingerprints of one block: a bucket beyond it is cut into parts, and pairs of parts are compared.
BLOCK = 2048


def shingle_hashes(text: bytes, k: int, seed: int) -> np.ndarray:
    """XXH64 of each k-word shingle of lower-cased text, repeats included; a shorter text is one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())], np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 hash bits for each hash; the first word is the hash itself."""
    if not word:
        return h
    h = (h ^ np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Big-endian bytes of the fingerprint; no shingle gives zero."""
    out = []
    for word in range(words):
        rows = _mixed(hashes, word).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, key: str, text: str = "text", k: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """``key`` and ``fp`` (8 * words bytes) of every row; null and blank texts have fingerprint zero."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({key: rows[key], "fp": [fingerprint(shingle_hashes(t, k, seed), words) for t in rows["_t"]]})
    return frames(docs.select(key, octets(text).alias("_t")), work, f"{key} {kind}, fp binary")


def part_keys(radius: int, words: int = 1) -> Column:
    """Exact blocking keys: the fingerprint in radius + 2 parts, each pair of parts is a key.

    Two fingerprints within the radius differ in at most ``radius`` parts, so two parts agree.
    """
    size, parts = 8 * words, radius + 2
    cuts = [size * i // parts for i in range(parts + 1)]
    piece = lambda i: F.substring("fp", cuts[i] + 1, cuts[i + 1] - cuts[i])
    return F.array(*[F.concat(F.lit(bytes([i, j])), piece(i), piece(j)) for i, j in combinations(range(parts), 2)])


def planes(fps: np.ndarray) -> np.ndarray:
    """Rows of bytes to vertical planes: (bits, lanes / 64) words, unused lanes zero."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, fps.shape[1] * 8), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps, axis=1)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced number is greater than the radius."""
    over, same = np.zeros_like(counter[0]), np.full_like(counter[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same &= counter[i]
        else:
            over |= same & counter[i]
            same &= ~counter[i]
    return over


#: Fingerprints asked at a time against a whole block: bounds the pairs that are held at once.
SLAB = 256


def _slabs(fps: np.ndarray, radius: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of bytes within the radius, by carry-save counters over vertical planes, a slab of rows i at a time."""
    n, bits = len(fps), fps.shape[1] * 8
    vertical = planes(fps)
    width = vertical.shape[1]
    for begin in range(0, n, SLAB):
        rows = np.arange(begin, min(begin + SLAB, n))
        asked = np.where(np.unpackbits(fps[rows], axis=1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        first = rows // 64
        query = np.repeat(rows, width - first)
        word = np.concatenate([np.arange(f, width) for f in first])
        counter = [np.zeros(len(query), np.uint64)]
        for b in range(bits):
            carry = vertical[b][word] ^ asked[query - begin, b]
            for i in range(len(counter)):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            if carry.any():
                counter.append(carry)
            if b % step == step - 1 and b + 1 < bits and b + 1 > radius:
                alive = _over(counter, radius) != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    query, word, counter = query[alive], word[alive], [c[alive] for c in counter]
                    if not len(query):
                        break
        if not len(query):
            continue
        within = ~_over(counter, radius)
        lanes = np.unpackbits(within.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(lanes)
        i, j = query[at], word[at] * 64 + lane
        keep = (j > i) & (j < n)
        yield i[keep], j[keep]


def close(fps: np.ndarray, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of rows of bytes within the radius."""
    none = np.empty(0, np.int64)
    found = list(_slabs(fps, radius, step)) or [(none, none)]
    return tuple(np.concatenate(x) for x in zip(*found))


def connected(fps: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Smallest row reachable over pairs within the radius, for each row; pairs are never held all at once."""
    root = np.arange(len(fps))
    for a, b in _slabs(fps, radius, step):
        root = _roots(len(fps), np.concatenate((a, np.arange(len(fps)))), np.concatenate((b, root)))
    return root


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable over the pairs, for each of n rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest set reachable over pairs with a Jaccard similarity of at least ALIKE, for each of the sets; empty ones are equal.

    The list is emptied on the way.
    """
    size = np.array([len(s) for s in sets])
    end = np.cumsum(size)
    flat = np.concatenate(sets)
    sets.clear()  # these are most of a task's memory
    kinds = np.unique(flat)
    ids = np.searchsorted(kinds, flat).astype(np.int32)
    del flat
    part, whole = ALIKE
    root, rest = np.arange(len(size)), np.arange(len(size))
    while len(rest):
        first, rest = rest[0], rest[1:]
        reached = [first]
        while reached and len(rest):
            one = reached.pop()
            has = np.zeros(len(kinds), bool)
            has[ids[end[one] - size[one]:end[one]]] = True
            before = np.concatenate(([0], np.cumsum(has[ids], dtype=np.int32)))
            common = before[end[rest]] - before[end[rest] - size[rest]]
            near = whole * common >= part * (size[one] + size[rest] - common)
            root[rest[near]] = first
            reached += rest[near].tolist()
            rest = rest[~near]
    return root


def _alike_within(root: np.ndarray, rows: pd.DataFrame, folder: str) -> np.ndarray:
    """Components of rows cut to what the sets of shingles confirm."""
    root, files = root.copy(), {}
    order = np.argsort(root, kind="stable")
    cut = np.nonzero(np.diff(root[order]))[0] + 1
    for members in np.split(order, cut):
        if len(members) > 1:
            sets = []
            for file, begin, size in rows.iloc[members][["file", "begin", "size"]].itertuples(index=False):
                if file not in files:
                    files[file] = shared_files.reader(folder, file)
                sets.append(np.frombuffer(files[file](begin, size), np.uint64))
            root[members] = members[alike(sets)]
    return root


def link(nodes: DataFrame, key: str, radius: int, block: int = BLOCK, sets: str | None = None) -> DataFrame:
    """Links (a, b) between rows (``key``, fp, keys) that share a blocking key and lie within the radius.

    Each compared block gives a spanning forest, not all its pairs, so the links
    stay below the number of (row, key) and lose no component.  Buckets larger
    than a block are cut into parts by fingerprint, and every pair of parts
    becomes a bucket of its own: bounded tasks, no pair lost.

    With a folder of ``sets``, in which ``nodes`` say by file, begin and size where
    the hashes of each row's shingles are, rows within the radius are only named, and
    linked where the sets themselves are alike.
    """
    rows = nodes.select(F.col(key).alias("node"), F.explode(F.array_distinct("keys")).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(2 * F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(
        F.least(mine, p).alias("i"), F.greatest(mine, p).alias("j")))
    rows = rows.join(counts, "bucket").select("node", "bucket", F.explode(F.when(F.col("n") > block, others).otherwise(
        F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))).alias("part"))
    rows = rows.select("node", F.xxhash64("bucket", "part.i", "part.j").alias("bucket"))
    # only those that share a bucket fetch their fingerprints
    rows = rows.join(nodes.select(F.col(key).alias("node"), "fp", *(["file", "begin", "size"] if sets else [])), "node")
    kind = nodes.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, "bucket", block // 4):
            fps = np.frombuffer(b"".join(rows["fp"]), np.uint8).reshape(len(rows), -1)
            root = connected(fps, radius)
            if sets:
                root = _alike_within(root, rows, sets)
            off = np.nonzero(root != np.arange(len(rows)))[0]
            ids = rows["node"].to_numpy()
            yield pd.DataFrame({"a": ids[root[off]], "b": ids[off]})
    return frames(rows.repartition("bucket").sortWithinPartitions("bucket"), work, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42,
                    radius: int = 2) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key reachable over links of the radius.

    Copies meet first: only distinct fingerprints are compared, each standing for
    all its rows.  A row with a null key is given a fingerprint and its component,
    but never names one.  An empty table gives an empty table; repeated rows are
    returned as often as they came; other columns are not read.
    """
    prints = stored(fingerprints(docs, key, text, k, seed), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    links = link(nodes.select("fp", part_keys(radius).alias("keys"), F.col("fp").alias("node")), "node", radius)
    roots = components(links)
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


#: Of whole documents: words of a shingle, 64-bit words of the fingerprint, bands of minima and minima of a band.
SHINGLE, WIDE, BANDS, ROWS = 5, 8, 12, 3
#: Part and whole: the share of common shingles of near copies.
ALIKE = 4, 5
#: Differing bits of 512 within which sets of shingles are compared.  Bits of two fingerprints agree with probability
#: 1 - angle / pi; a share of 0.8 is an angle of acos(8 / 9), 77 bits, and up to 96 bits for sets of four and five
#: shingles.  Four standard deviations (of 9 bits) more lose no copies, and strangers differ in 256.
WIDE_RADIUS = 132
#: Bytes of sets of shingles in a file.
SETS_BYTES = 32 << 20
_MULTIPLIERS = np.random.default_rng(99).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> list[int]:
    """Blocking keys of a document: a hash of each band of minima of its shingles' hashes.

    Documents with 0.8 of their shingles in common agree in one of 12 bands of 3
    with probability 1 - (1 - 0.8 ** 3) ** 12, above 0.9998.
    """
    if not len(hashes):
        return [0]
    out, least = [], np.empty(BANDS * ROWS, np.uint64)
    for begin in range(0, len(hashes), 65536):  # long texts in parts
        part = (hashes[begin:begin + 65536, None] * _MULTIPLIERS).min(axis=0)
        least = np.minimum(least, part) if begin else part
    for band, row in enumerate(least.reshape(BANDS, ROWS)):
        out.append(xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63))
    return out


def near_copies(docs: DataFrame, text: str = "text", radius: int = WIDE_RADIUS) -> DataFrame:
    """``node`` (a hash of a text) and ``root`` (the same for all near copies) of every different text that has one.

    Near copies are texts with 0.8 of their 5-word shingles in common, and what such
    links connect: wide fingerprints of the different shingles name them within
    ``radius`` bits, the shingles decide.  Texts without a near copy are not
    returned; nulls and blank texts are copies of each other.
    """
    folder = shared_files.new_folder(docs.sparkSession, "shingles")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, parts, end = uuid.uuid4().hex, [], 0
        for rows in batches:
            made = [np.unique(shingle_hashes(t, SHINGLE, 42)) for t in rows["_t"]]
            size = np.array([h.nbytes for h in made], np.int64)
            yield pd.DataFrame({"node": rows["node"], "fp": [fingerprint(h, WIDE) for h in made], "keys": [sketch(h) for h in made],
                                "file": file, "begin": end + np.cumsum(size) - size, "size": size})
            parts += [h.tobytes() for h in made]
            end += int(size.sum())
            if end >= SETS_BYTES:
                shared_files.write(folder, file, parts)
                file, parts, end = uuid.uuid4().hex, [], 0
        if parts:
            shared_files.write(folder, file, parts)
    prints = frames(docs.select(node_of(text).alias("node"), octets(text).alias("_t")), work,
                    "node binary, fp binary, keys array<long>, file string, begin long, size long")
    one = prints.groupBy("node").agg(F.first(F.struct("fp", "keys", "file", "begin", "size")).alias("one"))
    nodes = stored(one.select("node", "one.*"), "nodes")
    roots = components(link(nodes, "node", radius, block=1024, sets=folder))
    shared_files.remove(folder)
    return roots


def node_of(text: str = "text") -> Column:
    return F.unhex(F.md5(octets(text)))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each group of copies and near copies, whole; nulls count as largest.

    Of rows equal in key and text one stays.
    """
    columns = docs.columns
    roots = stored(near_copies(docs, text), "roots")
    named = docs.select(F.col(key).alias("_key"), node_of(text).alias("node")).join(roots, "node", "left")
    first = named.groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("node").alias("node"))).alias("w"))
    winners = first.select(F.col("w.node").alias("_node"), F.col("w.key").alias("_first"))
    rows = docs.select("*", node_of(text).alias("_node")).join(winners, "_node").where(F.col(key).eqNullSafe(F.col("_first")))
    return rows.dropDuplicates(["_node", key]).select(*columns)
