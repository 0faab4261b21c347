"""Periodic runs of words by internal pattern matching.

A run is a longest stretch of words with smallest period q (words q apart are equal)
and a length of at least max(6, 4 q).

A run of period q holds a whole dyadic block: a stretch of B words, B the largest
power of two not above 2 q, that begins at a multiple of B (2 B - 1 <= 4 q).  The
block is longer than q, so within the run it occurs again exactly q words on, and
at q words on or q words back it lies whole in the run (B + 2 q - 1 <= 4 q).  The
nearest occurrences of a block, at a distance from B / 2 to B, therefore name all
candidate periods, two at most for each block.

Occurrences of a block are a range of the suffix array.  A wavelet tree over that
array answers range successor and predecessor: the nearest occurrence on either
side, for all blocks of a level at once.  Occurrences at one distance from each
other form a progression, of which a run is the extent: names of dyadic stretches,
left over from sorting the suffixes, give how far a candidate period reaches both ways.

Many texts are laid end to end with a word of its own after each, so that no stretch
repeats over an end and one suffix array serves them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import frames, octets

#: Least length of a run, and least number of its periods.
LEAST, TIMES = 6, 4
#: Words laid end to end before they are searched; a longer text is searched by itself.
WORDS = 1 << 17


class Wavelet:
    """Wavelet tree over a permutation of 0 .. n - 1, level by level from the highest bit (zeros stand before ones)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros_before: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            low = (values >> bit & 1) == 0
            self.zeros_before.append(np.concatenate(([0], np.cumsum(low, dtype=np.int32))).astype(np.int32))
            values = np.concatenate((values[low], values[~low]))

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of places low .. high - 1 are smaller than ``value``."""
        count = np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros_before):
            a, b = zeros[low], zeros[high]
            one = (value >> (self.bits - 1 - level) & 1) == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
        return count

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of that rank (from 0) among places low .. high - 1."""
        value = np.zeros(len(low), np.int64)
        for zeros in self.zeros_before:
            a, b = zeros[low], zeros[high]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value = value << 1 | one
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
        return value


def suffixes(words: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places sorted by their first 2 ** levels words, and for each level the names of stretches of 2 ** level words.

    A name is the first place, in that order, of the suffixes that begin with the
    stretch, so a stretch is the range from its name over as many places as share
    it.  Prefix doubling: only names still shared are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = words[order]
    start = np.concatenate(([True], first[1:] != first[:-1]))
    name = np.empty(n, np.int32)
    name[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    names = [name]
    for level in range(levels):
        ahead, name = 1 << level, names[-1].copy()
        # places in order whose name another one shares
        end = np.concatenate((start[1:], [True]))
        tied = np.nonzero(~(start & end))[0]
        if len(tied):
            held = order[tied]
            follow = held + ahead
            key = name[held].astype(np.int64) * (n + 1) + np.where(follow < n, names[-1][np.minimum(follow, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            key, held = key[by], held[by]
            order[tied] = held
            parted = np.concatenate(([True], key[1:] != key[:-1]))
            start[tied] = parted
            name[held] = np.maximum.accumulate(np.where(parted, tied, 0))
        names.append(name)
    return order, names


def _reach(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words after (or before, places a and b excluded) two places are equal, by the longest stretch first."""
    n, far = len(names[0]), np.zeros(len(a), np.int64)
    for level in reversed(range(len(names))):
        size, name, active = 1 << level, names[level], np.arange(len(a))
        while len(active):
            x, y = (z[active] - far[active] - size if back else z[active] + far[active] for z in (a, b))
            fits = (x >= 0) & (y + size <= n)
            active, x, y = active[fits], x[fits], y[fits]
            active = active[name[x] == name[y]]
            far[active] += size
            if level + 1 < len(names):
                break  # what is left is shorter than the longest stretch: each shorter one fits once
    return far


def find_runs(words: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of a row of word numbers, by start and then period.

    ``longest`` is the length of the longest text in it, if that is known to be shorter.
    """
    none = np.empty(0, np.int64)
    n = len(words)
    longest = min(n, longest or n)
    if longest < LEAST:
        return none, none, none
    most = longest // TIMES  # no run has a longer period
    levels = max(1, (2 * most).bit_length() - 1)
    order, names = suffixes(words, levels)
    tree = Wavelet(order)
    at, gap = [none], [none]
    for level in range(1, levels + 1):
        size = 1 << level
        name = names[level]
        block = np.arange(0, n - size + 1, size)
        low = name[block].astype(np.int64)
        shared = np.bincount(name, minlength=n)[low]
        block, low, shared = (x[shared > 1] for x in (block, low, shared))
        if not len(block):
            break  # a longer block is not shared either
        high = low + shared
        rank = tree.below(low, high, block)
        for side in (1, -1):
            has = (rank + 1 < shared) if side == 1 else rank > 0
            near = tree.ranked(low[has], high[has], rank[has] + side)
            step = side * (near - block[has])
            fits = (2 * step >= size) & (step < size)
            at.append(np.minimum(near, block[has])[fits])
            gap.append(step[fits])
    at, gap = np.concatenate(at), np.concatenate(gap)
    start = at - _reach(names, at, at + gap, True)
    length = at + gap + _reach(names, at, at + gap, False) - start
    found = length >= np.maximum(LEAST, TIMES * gap)
    runs = np.unique(np.stack((start[found], gap[found], length[found]), axis=1), axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def _words(text: bytes, number: int, made_periodic: bool) -> list[bytes]:
    """Words of a text; in a text made periodic every word from some place on repeats the first ones from there."""
    words = text.split()
    if made_periodic and words and number % 10 == 0:
        g, n = number // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = (words[a:a + p] * (-(-(n - a) // p)))[:n - a]
    return words


def _described(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> tuple:
    """n_runs, the greatest run and both digests of a text from its runs."""
    kept, best = words, (None,) * 4
    if start:
        stays = np.zeros(len(words) + 1, np.int64)
        for s, n, q in zip(start, length, period):
            stays[s + q] += 1
            stays[s + n] -= 1
        kept = compress(words, (np.cumsum(stays) == 0).tolist())
        most, s, q = min((-n, s, q) for s, n, q in zip(start, length, period))
        best = s, -most, q, 1000 * -most // q
    said = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start, length, period))
    return (len(start), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def runs(docs: DataFrame, keep: list[str], text: str = "text", key: str | None = None, made_periodic: bool = False,
         with_runs: bool = False) -> DataFrame:
    """``keep`` and what the runs of every row's words are; the runs themselves too if asked.

    Words are stretches of anything but space and the ASCII controls 9 to 13.  With
    ``made_periodic`` a tenth of the texts, by the crc32 of ``key`` written as text,
    first get a periodic end.  ``n_runs``, then ``start``, ``length``, ``period`` and
    ``exponent_milli`` of the longest run (nulls without a run), a digest of all runs
    and one of the words that stay when each run keeps only its first period.

    A null or empty text has no words and no runs; a null key counts as the empty
    text; repeated rows are each answered.  A text of any length is searched whole,
    in memory linear in its words times the logarithm of its longest period.  An
    empty table gives an empty one; columns not named are not read; a kept column
    may not bear the name of a new one.
    """
    if set(keep) & {*NAMES, "runs"}:
        raise ValueError(f"rename {sorted(set(keep) & {*NAMES, 'runs'})} first")
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    extra = ", runs array<struct<start: long, length: long, period: long>>" if with_runs else ""

    def search(rows: list[list[bytes]]) -> list[tuple]:
        seen: dict[bytes, int] = {}
        sizes = np.array([len(r) for r in rows])
        ends = np.cumsum(sizes + 1)
        flat = np.empty(int(ends[-1]), np.int64)
        for row, end in zip(rows, ends.tolist()):
            flat[end - 1 - len(row):end - 1] = [seen.setdefault(w, len(seen)) for w in row]
        flat[ends - 1] = len(seen) + np.arange(len(rows))  # a word of its own ends each text
        start, length, period = find_runs(flat, int(sizes.max()))
        cut = np.searchsorted(start, np.concatenate(([0], ends)))
        out = []
        for i, (row, a, b) in enumerate(zip(rows, cut[:-1].tolist(), cut[1:].tolist())):
            found = ((start[a:b] - (ends[i - 1] if i else 0)).tolist(), length[a:b].tolist(), period[a:b].tolist()) if b > a else ([], [], [])
            out.append((*_described(row, *found), *([list(zip(*found))] if with_runs else [])))
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, held, size = [], [], 0
            for t, number in zip(batch["_t"], batch["_h"]):
                words = _words(t, number, made_periodic)
                if held and size + len(words) > WORDS:
                    made += search(held)
                    held, size = [], 0
                held.append(words)
                size += len(words) + 1
            if held:
                made += search(held)
            # objects throughout: the longest run's columns are whole numbers beside nulls
            table = pd.DataFrame(made, columns=[*NAMES, *(["runs"] if with_runs else [])], index=batch.index, dtype=object)
            if with_runs:
                table["runs"] = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in table["runs"]]
            yield pd.concat([batch[[f"_k{i}" for i in range(len(keep))]].set_axis(keep, axis=1), table], axis=1)
    number = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) if key else F.lit(0).cast("long")
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], octets(text).alias("_t"), number.alias("_h"))
    return frames(rows, work, kinds + "n_runs long, start long, length long, period long, exponent_milli long, "
                  "runs_sha256 string, collapsed_sha256 string" + extra)
