"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most a sequence's length.  Which pieces share a
sequence depends on lengths alone, and there are no more lengths than the sequence
has places.  So the driver plans over the histogram: a dynamic program over bitsets
finds the fullest sum the lengths still there can make, that combination is taken as
often as the counts allow, and the next is sought.  Each choice uses up at least one
length, which bounds the plan by the square of the sequence length whatever the
corpus.  Pieces then find their place from their rank among those of their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import frames, octets, stored

#: Buckets in which pieces of one length are numbered; a length that a third of all pieces have is spread over them.
BUCKETS = 4096


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level tokenizer file, run by the faster of the two public libraries.

    The file writes bytes as printable characters: those that print stand for
    themselves, the others are counted up from 256 in order.  Added tokens are cut out of
    a text before anything else, wherever they stand.
    """
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    vocabulary, added = read["model"]["vocab"], {t["content"]: t["id"] for t in read["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in read["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take blanks or whole words are not supported")
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
    for token in added:
        ranks.pop(token.encode(), None)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: full ones, the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def pieces(docs: DataFrame, key: str, path: str, pattern: str, size: int, text: str = "text", end: int = 0) -> DataFrame:
    """``key``, piece, start, length, ids_crc32 of every piece; a null text is the end token alone."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_ = encoding(path, pattern)
        for rows in batches:
            out = []
            for k, t in zip(rows[key], rows["_t"]):
                ids = np.append(with_.encode_to_numpy(t.decode("utf-8", "replace"), allowed_special="all"), end).astype("<u4")
                for i, (start, n) in enumerate(cuts(len(ids), size)):
                    out.append((k, i, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            columns = list(zip(*out)) or [()] * 5
            yield pd.DataFrame({key: pd.Series(columns[0], dtype=object), "piece": columns[1], "start": columns[2],
                                "length": columns[3], "ids_crc32": columns[4]})
    return frames(docs.select(key, octets(text).alias("_t")), work,
                  f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: list[int], size: int) -> list[tuple[int, int]]:
    """(length, how often) of the combination with the least slack, long lengths first among equals.

    Bit s of the set is on when some multiset of the lengths so far sums to s.
    Counts are split into powers of two, so each length adds a few shifts; the
    sets before every shift are kept to walk back.
    """
    mask, reach, trail = (1 << size + 1) - 1, 1, []
    for length, count in zip(lengths, counts):
        left, part = min(count, size // length), 1
        while left:
            take = min(part, left)
            trail.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            part *= 2
        if reach >> size & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, combination) until no piece is left."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        lengths = sorted(left, reverse=True)
        # the longest piece there must go somewhere: it is fixed first, the rest of its bin is filled as full as can be
        head = lengths[0]
        rest = fullest(*_others(left, lengths, head), size - head) if head < size else []
        combination = dict(rest)
        combination[head] = combination.get(head, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        out.append((times, sorted(combination.items(), reverse=True)))
        for n, k in combination.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _others(left: dict[int, int], lengths: list[int], head: int) -> tuple[list[int], list[int]]:
    counts = [left[n] - (n == head) for n in lengths]
    return [n for n, c in zip(lengths, counts) if c], [c for c in counts if c]


def pack(made: DataFrame, size: int) -> DataFrame:
    """``made`` (with a length) and sequence_id, offset: gapless sequences of at most ``size``.

    Any rows with a length of 1 to ``size`` will do; an empty table gives none.
    Rows of one length are told apart only by a number within hashed buckets, so
    neither a length nor a run of equal rows is ever gathered.
    """
    columns = made.columns
    numbered = stored(made.withColumn("_b", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int")), "pieces")
    per = stored(numbered.groupBy("length", "_b").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = plan(histogram, size)
    # for each length, where its ranks fall: first rank, entry's first sequence, copies in a sequence, offset of the first
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    rank, sequence = dict.fromkeys(histogram, 0), 0
    for times, combination in planned:
        offset = 0
        for n, k in combination:
            places.setdefault(n, []).append((rank[n], sequence, k, offset))
            rank[n] += k * times
            offset += n * k
        sequence += times
    arrays = {n: np.array(p, np.int64) for n, p in places.items()}

    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    ranked = numbered.join(starts, ["length", "_b"]).withColumn(
        "_rank", F.col("_from") + F.row_number().over(Window.partitionBy("length", "_b").orderBy(*columns)) - 1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows["_rank"].to_numpy()
            where, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for n in np.unique(length):
                at, table = np.nonzero(length == n)[0], arrays[n]
                entry = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                past = rank[at] - entry[:, 0]
                where[at] = entry[:, 1] + past // entry[:, 2]
                offset[at] = entry[:, 3] + past % entry[:, 2] * n
            yield pd.concat([rows[columns], pd.DataFrame({"sequence_id": where, "offset": offset}, index=rows.index)], axis=1)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in made.schema)
    return frames(ranked.select(*columns, "_rank"), work, kinds + "sequence_id long, offset long")
