"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays.

Words are 64-bit hashes.  Tasks count words and pairs of a few million tokens at a
time and send them as blobs of sorted arrays, one blob for each slice of the first
word's hash; another task joins a slice's blobs.  No row is made for a single n-gram,
and a frequent word only weighs as much as it has different neighbours.  A slice's
pairs become a file of sorted pair hashes with their counts, its words a file of
sorted word hashes with counts, different predecessors, and different successors
seen once, twice and more often.  Scoring memory-maps the files and looks a batch's
different pairs up by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import shared_files
from storyloom.llm.common import LOWER, frames, octets, stored

#: Tokens that a task counts before it sends them on.
TOKENS = 3_000_000
#: Bytes of text for which there is a slice of the model.
SLICE_BYTES = 4 << 20
#: Entries of a slice below which blobs are not merged before its end.
LEAST = 1 << 18
#: The end of a text, and what stands before its first word; fixed hashes no text is likely to have.
END, BEGIN = 0x45D9F3B3335B369, 0x3C6EF372FE94F82B


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first ^ (first >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + second
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    """Slice of a word's hash; slices is a power of two."""
    return (h >> np.uint64(40)).astype(np.int64) & (slices - 1)


class _Tokens:
    """Texts as dense word numbers: 0 begins a text, 1 ends it."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each with its end; and how many each has."""
        seen = self.seen
        split = [t.translate(LOWER).split() for t in texts]
        lengths = np.fromiter((len(w) + 1 for w in split), np.int64, len(split))
        flat = np.fromiter((i for words in split for i in (*[seen.setdefault(w, len(seen) + 2) for w in words], 1)),
                           np.int64, int(lengths.sum()))
        return flat, lengths

    def hashes(self) -> np.ndarray:
        return np.array([BEGIN, END, *map(_hash, self.seen)], np.uint64)


def _before(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of the token before each token."""
    before = np.concatenate(([0], flat[:-1])) if len(flat) else flat
    before[np.cumsum(lengths) - lengths] = 0
    return before


def _sorted_sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order and the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, values
    new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    at = np.nonzero(new)[0]
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) for v in values]


def _blobs(kind: str, by: np.ndarray, slices: int, columns: list[np.ndarray]) -> pd.DataFrame:
    """Rows of whole columns, one for each slice that has entries."""
    order = np.argsort(by, kind="stable")
    by, columns = by[order], [c[order] for c in columns]
    cut = np.searchsorted(by, np.arange(slices + 1))
    rows = [(kind, s, [c[cut[s]:cut[s + 1]].tobytes() for c in columns] + [b""] * (3 - len(columns)))
            for s in range(slices) if cut[s] < cut[s + 1]]
    return pd.DataFrame({"kind": [r[0] for r in rows], "slice": [r[1] for r in rows],
                         **{f"c{i}": [r[2][i] for r in rows] for i in range(3)}})


_BLOB = "kind string, slice int, c0 binary, c1 binary, c2 binary"


def _count(docs: DataFrame, text: str, slices: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, codes, singles, held = _Tokens(), [], [], 0

        def flush():
            h = tokens.hashes()
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            first, second = h[code >> 32], h[code & 0xFFFFFFFF]
            yield _blobs("pair", _slice(first, slices), slices, [first, second, n.astype(np.uint32)])
            word, n = np.unique(np.concatenate(singles), return_counts=True)
            yield _blobs("word", _slice(h[word], slices), slices, [h[word], n.astype(np.uint64)])
        for rows in batches:
            flat, lengths = tokens.of(list(rows["_t"]))
            codes.append(_before(flat, lengths) << 32 | flat)
            singles.append(flat)
            held += len(flat)
            if held >= TOKENS:
                yield from flush()
                tokens, codes, singles, held = _Tokens(), [], [], 0
        if held:
            yield from flush()
    return frames(docs.select(octets(text).alias("_t")), work, _BLOB)


def _by_slice(blobs: DataFrame) -> DataFrame:
    return blobs.repartition("slice").sortWithinPartitions("slice")


def _one(kind: str, blobs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Blobs of a slice as one: distinct keys in order, counts of 64 bits summed."""
    columns = [np.concatenate(c) for c in zip(*blobs)]
    keys = 2 if kind == "pair" else 1
    summed, (n,) = _sorted_sums(columns[:keys], [columns[keys].astype(np.int64)])
    return [*summed, n, *columns[keys + 1:]]


def _slices_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, dict[str, list[np.ndarray]]]]:
    """Each slice's columns by kind, summed over its blobs; the stream is sorted by slice.

    Blobs are merged as they come, whenever the new ones outweigh what is merged: a task
    holds about twice the different keys of a slice, however many tasks counted them.
    """
    at, held, fresh = None, {}, {}
    done = lambda: {k: _one(k, v) for k, v in held.items()}
    for rows in batches:
        for kind, s, c0, c1, c2 in zip(rows["kind"], rows["slice"], rows["c0"], rows["c1"], rows["c2"]):
            if s != at:
                if held:
                    yield at, done()
                at, held, fresh = s, {}, {}
            types = (np.uint64, np.uint64, np.uint32) if kind == "pair" else (np.uint64, np.uint64, np.uint32)
            blobs = held.setdefault(kind, [])
            blobs.append([np.frombuffer(c, t) for c, t in zip((c0, c1, c2), types)])
            fresh[kind] = fresh.get(kind, 0) + len(blobs[-1][0])
            if fresh[kind] > max(LEAST, len(blobs[0][0])):
                blobs[:] = [_one(kind, blobs)]
                fresh[kind] = 0
    if held:
        yield at, done()


def _small(counts: np.ndarray) -> list[bytes]:
    """Counts in a byte each; those of 255 and more also in full, behind their places."""
    large = np.nonzero(counts >= 255)[0]
    return [np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype(np.uint64).tobytes(), counts[large].astype(np.uint64).tobytes()]


def _file(keys: np.ndarray, columns: list[list[bytes]]) -> list[bytes]:
    """Number of keys, keys, then for each column its number of large counts and its three arrays."""
    out = [np.array([len(keys), len(columns)] + [len(c[1]) // 8 for c in columns], np.uint64).tobytes(), keys.tobytes()]
    return out + [p for c in columns for p in c]


class _Table:
    """A file of :func:`_file`, memory-mapped."""

    def __init__(self, folder: str, name: str):
        raw = shared_files.mapped(folder, name)
        self.keys, self.columns = np.empty(0, np.uint64), []
        if not len(raw):
            return
        n, columns = (int(x) for x in np.frombuffer(raw[:16].tobytes(), np.uint64))
        large = np.frombuffer(raw[16:16 + 8 * columns].tobytes(), np.uint64).astype(int)
        at = 16 + 8 * columns
        self.keys = raw[at:at + 8 * n].view(np.uint64)
        at += 8 * n
        for k in large:
            small = raw[at:at + n]
            at += n
            extra = raw[at:at + 16 * k].tobytes()
            at += 16 * k
            self.columns.append((small, np.frombuffer(extra[:8 * k], np.uint64), np.frombuffer(extra[8 * k:], np.uint64)))

    def find(self, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """Counts of each key, zero where it is not held."""
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.nonzero(self.keys[at] == keys)[0]
        for made, (small, places, large) in zip(out, self.columns):
            value = small[at[hit]].astype(np.int64)
            big = np.nonzero(value == 255)[0]
            if len(big):
                value[big] = large[np.searchsorted(places, at[hit][big].astype(np.uint64))].astype(np.int64)
            made[hit] = value
        return out


_SEEN = ("n1", "n2", "n3", "n4", "types", "sum")


def _seen(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, how many there are, and their sum."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(counts), int(counts.sum())]


@dataclass(frozen=True)
class Level:
    """Discounts for counts of 1, 2, and 3 or more; numbers of types with such counts; all types; their sum."""
    discounts: tuple[float, float, float]
    numbers: tuple[int, int, int]
    types: int
    total: int

    @staticmethod
    def of(n1: int, n2: int, n3: int, n4: int, types: int, total: int) -> Level:
        """The closed form for modified discounts; where counts of counts are missing, halves stand in."""
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        pick = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else 0.5
        return Level((pick(1, n1, n2), pick(2, n2, n3), pick(3, n3, n4)), (n1, n2, types - n1 - n2), types, total)

    def less(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(counts - np.array([0.0, *self.discounts])[np.minimum(counts, 3)], 0.0)


@dataclass(frozen=True)
class BigramModel:
    """Where the arrays are and what all words share."""
    folder: str
    slices: int
    tokens: int
    words: int
    pairs: Level
    heads: Level

    def table(self, kind: str, s: int) -> _Table:
        held = _OPEN.setdefault(self.folder, {})
        if (kind, s) not in held:
            if len(held) > 4096:
                held.clear()
            held[kind, s] = _Table(self.folder, f"{kind}-{s:05d}")
        return held[kind, s]

    def find(self, kind: str, by: np.ndarray, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """Counts of keys whose slices are ``by``, slice after slice."""
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        order = np.lexsort((keys, by))
        cut = np.searchsorted(by[order], np.arange(self.slices + 1))
        for s in range(self.slices):
            mine = order[cut[s]:cut[s + 1]]
            if len(mine):
                for made, got in zip(out, self.table(kind, s).find(keys[mine], columns)):
                    made[mine] = got
        return out


#: Tables a worker has open, by folder.
_OPEN: dict[str, dict[tuple[str, int], _Table]] = {}


def train(docs: DataFrame, text: str = "text") -> BigramModel:
    """Count all rows and store the model; null texts are empty, no rows make a model that knows nothing."""
    size = docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    slices = 16
    while slices * SLICE_BYTES < size and slices < 1 << 20:
        slices *= 2
    folder = shared_files.new_folder(docs.sparkSession, "bigrams")
    blobs = _count(docs, text, slices)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s, held in _slices_of(batches):
            if "word" in held:  # words pass through, summed
                w, n = held["word"][:2]
                yield _blobs("word", np.full(len(w), s), slices, [w, n.astype(np.uint64)]).assign(seen=None)
            if "pair" not in held:
                continue
            first, second, n = held["pair"]
            keys = _pair(first, second)
            order = np.argsort(keys)
            shared_files.write(folder, f"pair-{s:05d}", _file(keys[order], [_small(n[order])]))
            # successors of each first word that were seen once, twice, more often
            at = np.nonzero(np.concatenate(([True], first[1:] != first[:-1])))[0]
            after = [np.add.reduceat((c).astype(np.int64), at) for c in (n == 1, n == 2, n >= 3)]
            total = np.add.reduceat(n, at)
            shared_files.write(folder, f"head-{s:05d}", _file(first[at], [_small(c) for c in (*after, total)]))
            w, k = np.unique(second, return_counts=True)
            made = _blobs("cont", _slice(w, slices), slices, [w, k.astype(np.uint64)]).assign(seen=None)
            made.at[0, "seen"] = _seen(n)
            yield made
    joined = stored(frames(_by_slice(blobs), pairs, _BLOB + ", seen array<long>"), "cont")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s, held in _slices_of(batches):
            parts = [(held[k][0], held[k][1].astype(np.int64), k) for k in ("word", "cont") if k in held]
            w = np.concatenate([p[0] for p in parts])
            zero = lambda k: np.concatenate([p[1] if p[2] == k else np.zeros(len(p[0]), np.int64) for p in parts])
            (w,), (n, before) = _sorted_sums([w], [zero("word"), zero("cont")])
            shared_files.write(folder, f"word-{s:05d}", _file(w, [_small(n), _small(before)]))
            yield pd.DataFrame([[int(n.sum()), int((n > 0).sum()), *_seen(before[before > 0])]],
                               columns=["tokens", "words", *_SEEN])
    counts = frames(_by_slice(joined.select("kind", "slice", "c0", "c1", "c2")), words,
                    "tokens long, words long, " + ", ".join(f"{c} long" for c in _SEEN))
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in counts.columns]).first()
    seen = joined.where("seen IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)) for i in range(6)]).first()
    return BigramModel(folder, slices, total[0], total[1], Level.of(*seen), Level.of(*total[2:]))


def log_probabilities(model: BigramModel, first: np.ndarray, second: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 P(second | first); ``before`` has the different predecessors of each second word."""
    heads, pairs = model.heads, model.pairs
    even = 1.0 / (model.words + 1)
    if heads.total:
        spread = sum(d * n for d, n in zip(heads.discounts, heads.numbers)) / heads.total
        lower = heads.less(before) / heads.total + spread * even
    else:
        lower = np.full(len(first), even)
    by = _slice(first, model.slices)
    (n,) = model.find("pair", by, _pair(first, second), 1)
    once, twice, more, total = model.find("head", by, first, 4)
    kept = sum(d * c for d, c in zip(pairs.discounts, (once, twice, more)))
    known = total > 0
    return np.log10(np.where(known, (pairs.less(n) + kept * lower) / np.maximum(total, 1), lower))


def score(docs: DataFrame, model: BigramModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    Whole texts count, an end after each; a null or empty text is its end alone.
    """
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            tokens = _Tokens()
            flat, lengths = tokens.of(list(rows["_t"]))
            h = tokens.hashes()
            n, before = model.find("word", _slice(h, model.slices), h, 2)
            code, at = np.unique(_before(flat, lengths) << 32 | flat, return_inverse=True)
            second = code & 0xFFFFFFFF
            logs = log_probabilities(model, h[code >> 32], h[second], before[second])
            base = np.log10((n + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            owner = np.repeat(np.arange(len(rows)), lengths)
            total = lambda x: np.bincount(owner, x, len(rows))
            whole = total(logs[at])
            yield pd.concat([rows[keep], pd.DataFrame({
                "n_tokens": lengths, "n_known": total(n[flat] > 0).astype(np.int64), "train_tokens": model.tokens,
                "base_score": total(base[flat]), "score": whole, "perplexity": 10 ** np.minimum(-whole / lengths, 300.0)},
                index=rows.index)], axis=1)
    return frames(docs.select(*keep, octets(text).alias("_t")), work, kinds +
                  "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
