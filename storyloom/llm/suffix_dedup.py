"""Exact substring removal by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes.

Where to look.  A start's anchor is the k-gram with the least hash in its window of
``length`` bytes, the rightmost at ties.  Equal strings have equal anchors at equal
places, so strings meet by the anchor's hash; anchors seen once are dropped before
any text moves.  Around an anchor a segment holds all strings anchored there.
Equal segments collapse to one with a weight.

How to tell.  Segments are cut into 8-byte symbols on a grid through the anchor.  A
task takes whole anchors, cuts its segments into shards, sorts each shard's suffixes
by prefix doubling and keeps the transform (each suffix's preceding symbol).  Shards
are merged by refining their interleave: one pass moves every suffix of the current
order behind its preceding symbol, which sorts by one symbol more; the pass in which
neighbours part gives their common prefix.  Blocks whose suffixes all come from one
shard are settled, as that shard knows their order and prefixes.  Repeated intervals
then are the runs with a common prefix of the symbols that lie whole in a string;
the preceding symbol's last bytes and the next symbol's first ones decide the rest.

An anchor found more often than ``hot`` times is not gathered: its strings are
counted by hash with map-side combination, a start per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import frames, groups, octets, stored

LENGTH = 400
#: Bytes of the k-grams that anchor strings.
GRAM = 64
#: Anchors seen more often than this have their strings counted, not gathered.
HOT = 8192
#: Segments that a task sorts together, and segments of a shard.
TASK, SHARD = 4096, 1024
#: Bytes hashed at a time; longer texts go slice by slice.
SLICE = 1 << 20
_LOW = 24
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STARTS = np.uint64((1 << _LOW) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _doubled(x: np.ndarray, n: int, join) -> np.ndarray:
    """Fold every window of n neighbours with an operation, by doubling and one overlapped or added rest."""
    size = 1
    while 2 * size <= n:
        x = join(x[:-size], x[size:], size)
        size *= 2
    return x, size


def gram_hashes(flat: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes at every place; k is a power of two."""
    h, _ = _doubled(_BYTE[flat], k, lambda a, b, size: _mix(a * np.uint64(2 * size + 1) + (b ^ np.uint64(size))))
    return h


def anchors(flat: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start, anchor and the anchor's hash of every run of valid starts with one anchor.

    ``starts`` marks the places where a string may start; its window must lie within the bytes.
    """
    h = gram_hashes(flat, k)
    window = length - k + 1
    packed = (h >> np.uint64(_LOW) << np.uint64(_LOW)) | (_STARTS - np.arange(len(h), dtype=np.uint64))
    least, size = _doubled(packed, window, lambda a, b, _: np.minimum(a, b))
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size:])
    valid = np.nonzero(starts[: len(least)])[0]
    at = (_STARTS - (least[valid] & _STARTS)).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1))) if len(valid) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    last = np.concatenate((first[1:], [len(valid)])) - 1 if len(first) else first
    return valid[first], valid[last], at[first], h[at[first]].view(np.int64)


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, valid starts, and for each place its text and where the slice begins in it."""
    def flush(parts):
        flat = np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8)
        sizes = np.array([len(p) for p, _, _ in parts])
        ends = np.cumsum(sizes)
        starts = np.zeros(len(flat), bool)
        for e, n in zip(ends.tolist(), sizes.tolist()):
            starts[e - n:e - length + 1] = True
        return flat, starts, np.repeat([i for _, i, _ in parts], sizes), np.repeat([a for _, _, a in parts] - (ends - sizes), sizes)
    held, total = [], 0
    for i, t in enumerate(texts):
        for begin in range(0, len(t) - length + 1, SLICE):
            part = t[begin:begin + SLICE + length - 1]
            held.append((part, i, begin))
            total += len(part)
            if total >= SLICE:
                yield flush(held)
                held, total = [], 0
    if held:
        yield flush(held)


def find_anchors(texts: DataFrame, length: int, k: int) -> DataFrame:
    """k1, k2 of the text and (anchor, first, last, at) of every run of its starts."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            k1, k2 = rows["k1"].to_numpy(), rows["k2"].to_numpy()
            for flat, starts, owner, shift in _slices(list(rows["_t"]), length):
                first, last, at, h = anchors(flat, starts, length, k)
                yield pd.DataFrame({"k1": k1[owner[first]], "k2": k2[owner[first]], "anchor": h, "first": first + shift[first],
                                    "last": last + shift[first], "at": at + shift[first]})
    return frames(texts, work, "k1 long, k2 long, anchor long, first long, last long, at long")


# ---------------------------------------------------------------------------------- transforms


def symbols(segments: list[bytes], leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-byte symbols of all segments on grids through their anchors, first symbol of each, bytes padded in front.

    Each segment ends in one more symbol, so that every string has a next one.
    """
    front = (8 - leads % 8) % 8
    parts = []
    for s, f in zip(segments, front.tolist()):
        parts += [bytes(f), s, bytes(8 + -(f + len(s)) % 8)]
    flat = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
    sizes = np.array([(f + len(s) + 7) // 8 + 1 for s, f in zip(segments, front.tolist())])
    return flat, np.cumsum(sizes) - sizes, front


def shard_classes(sym: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` symbols, equal prefixes having equal ranks (prefix doubling).

    Ranks are right for suffixes with that many symbols left (``rest``); only
    suffixes still tied are sorted again.
    """
    n = len(sym)

    def ranked(act: np.ndarray, key: np.ndarray, low: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, low))
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (low[order][1:] != low[order][:-1])))
        # a class keeps the low end of the ranks its parent had
        opened = np.concatenate(([True], low[order][1:] != low[order][:-1]))
        place = np.arange(len(act)) - np.maximum.accumulate(np.where(opened, np.arange(len(act)), 0))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(act)), 0))
        rank[act[order]] = low[order] + place[lead]
        size = np.diff(np.concatenate((np.nonzero(new)[0], [len(act)])))
        return act[order][np.repeat(size > 1, size)]
    rank = np.zeros(n, np.int64)
    if not n:
        return rank
    tied, have = ranked(np.arange(n), sym, np.zeros(n, np.int64)), 1
    while have < depth and len(tied):
        ahead = min(have, depth - have)
        tied = tied[rest[tied] >= have + ahead]
        if len(tied):
            tied = ranked(tied, rank[tied + ahead].copy(), rank[tied].copy())
        have += ahead
    return rank


def merge_shards(sym: np.ndarray, inner: np.ndarray, shard: np.ndarray, classes: np.ndarray, depth: int) -> np.ndarray:
    """Classes of equal ``depth``-symbol prefixes over all shards, from the classes within each.

    ``sym[i - 1]`` is the transform's symbol of suffix i (its preceding one) where
    ``inner[i]``.  The interleave holds the suffixes of all shards, sorted by their
    first h symbols and shard by shard among equals.  Moving them in that order
    behind their preceding symbols sorts those by h + 1 symbols.  Blocks of one
    shard alone are settled and leave.
    """
    merged = classes + (shard * (len(sym) + 1))
    order = np.lexsort((shard, sym))
    first = sym[order]
    new = np.concatenate(([True], first[1:] != first[:-1])) if len(order) else np.zeros(0, bool)
    for h in range(1, depth + 1):
        block = np.cumsum(new) - 1
        at = np.nonzero(new)[0]
        if len(order):
            source = shard[order]
            mixed = (np.minimum.reduceat(source, at) != np.maximum.reduceat(source, at))[block]
            order, block = order[mixed], block[mixed]
        if not len(order) or h == depth:
            break
        has = inner[order]
        before, block = order[has] - 1, block[has]
        move = np.lexsort((block, sym[before]))  # stable in the interleave: blocks are numbered in its order
        order, block = before[move], block[move]
        c = sym[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (block[1:] != block[:-1]))) if len(order) else np.zeros(0, bool)
    if len(order):
        merged[order] = block + (int(shard.max()) + 1) * (len(sym) + 1)
    return merged


def repeated_starts(segments: list[bytes], leads: np.ndarray, counts: np.ndarray, weights: np.ndarray, length: int = LENGTH,
                    shard_size: int = SHARD) -> list[np.ndarray]:
    """For each segment, which of its first ``counts`` starts have a string that some segment also has elsewhere.

    ``weights`` are the places a segment stands for.
    """
    depth = length // 8 - 1
    raw, base, front = symbols(segments, leads)
    owner = np.repeat(np.arange(len(segments)), np.diff(np.concatenate((base, [len(raw)]))))
    end = np.concatenate((base[1:], [len(raw)]))
    index = np.arange(len(raw))
    rest = end[owner] - index
    sym = np.unique(raw, return_inverse=True)[1].astype(np.int64)
    shard = owner // shard_size
    classes = np.zeros(len(raw), np.int64)
    for s in range(int(shard.max()) + 1 if len(shard) else 0):
        mine = slice(int(np.searchsorted(shard, s)), int(np.searchsorted(shard, s, "right")))
        classes[mine] = shard_classes(sym[mine], rest[mine], depth)
    classes = merge_shards(sym, index > base[owner], shard, classes, depth)

    found = [np.zeros(c, bool) for c in counts]
    place = 8 * (index - base[owner]) - front[owner]
    use = np.nonzero((rest > depth) & (place >= 0) & (place < counts[owner] + 7))[0]
    label = np.unique(classes[use], return_inverse=True)[1]
    heavy = np.bincount(label, weights[owner[use]])[label] > 1 if len(use) else np.zeros(0, bool)
    use, label = use[heavy], label[heavy]
    behind = np.where(use > base[owner[use]], raw[use - 1], 0) if len(use) else raw[:0]
    ahead = raw[np.minimum(use + depth, len(raw) - 1)] if len(use) else raw[:0]
    extra = length - 8 * depth  # bytes of a string beyond the whole symbols, 8 to 15
    ahead2 = raw[np.minimum(use + depth + 1, len(raw) - 1)] if len(use) else raw[:0]
    for t in range(8):
        p = place[use] - t
        ok = (p >= 0) & (p < counts[owner[use]])
        at, need = use[ok], extra - t
        back = behind[ok] & np.uint64((1 << 8 * t) - 1)
        front1 = ahead[ok] if need >= 8 else ahead[ok] >> np.uint64(8 * (8 - need))
        front2 = ahead2[ok] >> np.uint64(8 * (16 - need)) if need > 8 else np.zeros(len(at), np.uint64)
        order = np.lexsort((front2, front1, back, label[ok]))
        keys = [x[order] for x in (label[ok], back, front1, front2)]
        if not len(order):
            continue
        new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
        block = np.cumsum(new) - 1
        twice = np.bincount(block, weights[owner[at[order]]])[block] > 1
        for o, q in zip(owner[at[order[twice]]].tolist(), p[ok][order[twice]].tolist()):
            found[o][q] = True
    return found


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()


# ---------------------------------------------------------------------------------- jobs


def _keys(binary: Column) -> list[Column]:
    return [F.xxhash64(binary).alias("k1"), F.xxhash64(binary, F.lit(7)).alias("k2")]


def find_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """k1, k2 of a text and the ``spans`` (from, to) of its repeated bytes, for texts that have any.

    ``texts`` has k1, k2 (two hashes of the text) and its bytes ``_t``, one row per row of the corpus.
    """
    made = stored(find_anchors(texts.select("k1", "k2", "_t"), length, gram), "anchors")
    # written, so that the join below stands on plain exchanges and adaptive execution can cut a hot anchor's part
    often = stored(made.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "often")
    wanted = made.join(often, "anchor").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("first", "last", "at", "anchor", (F.col("n") > hot).alias("hot"))).alias("runs"), F.count("*").alias("n"))
    wanted = wanted.select("k1", "k2", "runs", (F.col("n") / F.size("runs")).cast("long").alias("weight"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key = None
        for rows in batches:
            out = []
            for k1, k2, t, runs, weight in zip(rows["k1"], rows["k2"], rows["_t"], rows["runs"], rows["weight"]):
                if (k1, k2) == last_key:  # a further row of a text: its weight is counted already
                    continue
                last_key = k1, k2
                out += [(k1, k2, r["first"], r["anchor"], r["hot"], r["at"] - r["first"], r["last"] - r["first"] + 1, weight,
                         t[r["first"]:r["last"] + length]) for r in runs]
                if len(out) > 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)
    names = ["k1", "k2", "first", "anchor", "hot", "lead", "count", "weight", "segment"]
    joined = texts.select("k1", "k2", "_t").join(wanted, ["k1", "k2"]).sortWithinPartitions("k1", "k2")
    segments = frames(joined, cut, "k1 long, k2 long, first long, anchor long, hot boolean, lead long, count long, weight long, segment binary")
    segments = stored(segments.withColumns({"s1": F.xxhash64("segment", "lead"), "s2": F.xxhash64("segment", F.lit(7))}), "segments")
    # rows of one text may come from several tasks: (k1, k2, first) is what counts once
    places = segments.groupBy("k1", "k2", "first", "anchor", "hot", "s1", "s2").agg(F.max("weight").alias("weight"))
    places = stored(places, "places")
    weights = places.groupBy("anchor", "s1", "s2").agg(F.sum("weight").alias("weight"))
    one = segments.groupBy("anchor", "s1", "s2").agg(F.first(F.struct("hot", "lead", "count", "segment")).alias("s"))
    distinct = stored(one.join(weights, ["anchor", "s1", "s2"]).select("anchor", "s1", "s2", "weight", "s.*"), "distinct")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, "anchor", TASK):
            flags = repeated_starts(list(rows["segment"]), rows["lead"].to_numpy(), rows["count"].to_numpy(),
                                    rows["weight"].to_numpy(), length)
            hit = [i for i, f in enumerate(flags) if f.any()]
            runs = [_runs(flags[i]) for i in hit]
            yield pd.DataFrame({"s1": rows["s1"].to_numpy()[hit], "s2": rows["s2"].to_numpy()[hit],
                                "low": [a for a, _ in runs], "high": [b for _, b in runs]})
    kinds = "s1 long, s2 long, low array<long>, high array<long>"
    cool = frames(distinct.where("not hot").select("anchor", "s1", "s2", "lead", "count", "weight", "segment")
                  .repartition("anchor").sortWithinPartitions("anchor"), sort, kinds)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for s1, s2, n, weight, segment in zip(rows["s1"], rows["s2"], rows["count"], rows["weight"], rows["segment"]):
                h = [hashlib.blake2b(segment[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pd.DataFrame({"s1": s1, "s2": s2, "start": np.arange(n), "weight": weight, "string": h})
    # each start of a hot anchor is a row: sums meet before the shuffle, and no anchor is ever gathered
    each = stored(frames(distinct.where("hot").select("s1", "s2", "count", "weight", "segment"), strings,
                         "s1 long, s2 long, start long, weight long, string binary"), "strings")
    twice = each.groupBy("string").agg(F.sum("weight").alias("n")).where("n > 1").select("string")
    warm = each.join(twice, "string").groupBy("s1", "s2").agg(F.collect_list("start").alias("low"))
    results = stored(cool.unionByName(warm.select("s1", "s2", "low", F.col("low").alias("high"))), "results")

    spans = places.join(results, ["s1", "s2"]).select("k1", "k2", F.arrays_zip(
        F.transform("low", lambda x: x + F.col("first")).alias("from"),
        F.transform("high", lambda x: x + F.col("first") + length).alias("to")).alias("spans"))
    return spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _union(spans, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["from"], min(s["to"], size)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _whole(data: bytes, a: int, b: int) -> tuple[int, int]:
    """A span shrunk to whole characters."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   with_text: bool = False) -> DataFrame:
    """``keep`` and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row; the text that stays if asked.

    Strings are judged on the input, every copy of a repeated string goes, and
    texts shorter than ``length`` keep all.  A null text counts as the empty one.
    Repeated rows are each other's copies.  The text that stays is cut at whole
    characters; counts and hash are exact to the byte.
    """
    assert length - gram >= gram and length >= 24 and gram & gram - 1 == 0
    body = octets(text)
    base = docs.select(*keep, body.alias("_t"), *_keys(body))
    spans = find_spans(base, length, gram, hot)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, texts = [], []
            for t, found in zip(rows["_t"], rows["spans"]):
                gone = _union(found, len(t)) if found is not None else []
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(t[at:a])
                    at = b
                sha.update(t[at:])
                out.append((len(t), sum(b - a for a, b in gone), len(gone), sha.hexdigest()))
                if with_text:
                    kept, at = [], 0
                    for a, b in (_whole(t, *s) for s in gone):
                        kept.append(t[at:a])
                        at = b
                    texts.append(b"".join([*kept, t[at:]]).decode("utf-8", "replace"))
            made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"], index=rows.index)
            if with_text:
                made["kept_text"] = texts
            yield pd.concat([rows[keep], made], axis=1)
    return frames(base.join(spans, ["k1", "k2"], "left").select(*keep, "_t", "spans"), work,
                  kinds + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else ""))
