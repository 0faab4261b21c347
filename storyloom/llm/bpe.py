"""Byte-level BPE as a transducer: merges compiled into states made as they are met.

The encoding of a piece is the only way to cut it into vocabulary tokens such that
merging every two neighbours alone gives back those two.  So a non-deterministic
transducer guesses where each token ends: it walks the trie of the tokens, and may
close a token where the pair with the token before it is stable.  Determinising it
as bytes arrive gives states that are sets of (place in the trie, tokens not yet
written); what all members of a set agree on is written at once.  A token is thus
out after a lookahead no longer than the longest token.  States and steps are kept
and reused; the store is emptied when it reaches a stated size.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from struct import Struct

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from storyloom.llm.common import frames, octets

#: States and remembered pieces held before the store starts anew: bounds a worker's memory.
STATES = 250_000
PIECES = 1_000_000
#: Bytes of a piece after which states are no longer stored: so far in, few pieces share them.
DEEP = 7
#: Packs so many ids as little-endian 32-bit numbers.
_PACK = [Struct(f"<{n}I").pack for n in range(40)]
#: Bytes that are decoded at a time.
CHUNK = 1 << 16


class Transducer:
    """Encoder of single pieces over ranks (token bytes to id; the id is the rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        places: dict[bytes, int] = {b"": 0}
        for token in ranks:
            for n in range(1, len(token) + 1):
                places.setdefault(token[:n], len(places))
        begun = {token[:n] for token in ranks for n in range(len(token))}
        #: place in the trie << 8 | byte to (next place << 8, token that ends there or -1, whether tokens go on from there)
        self.next = {places[t[:-1]] << 8 | t[-1]: (at << 8, ranks.get(t, -1), t in begun) for t, at in places.items() if t}
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self._empty()

    def _empty(self) -> None:
        self.sets: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: list[tuple[int, ...]] = []
        self._state(((0, ()),))

    def _state(self, members: tuple) -> int:
        at = self.known.get(members)
        if at is None:
            at = self.known[members] = len(self.sets)
            self.sets.append(members)
            self.ends.append(members[0][1])
        return at

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a byte."""
        if token not in self.parts:
            raw = self.bytes_of[token]
            cut = merge(raw, self.ranks, token) if len(raw) > 1 else []
            self.parts[token] = (self.ranks[cut[0]], self.ranks[cut[1]]) if len(cut) == 2 else None
        return self.parts[token]

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens by rank ends with just these two.

        Their merges are taken back, the latest first; if the tokens then facing
        each other across the seam would have merged before that, the two are not
        stable.  Of equal ranks the one further left is merged first.
        """
        got = self.pairs.get(a << 32 | b)
        if got is not None:
            return got
        if len(self.pairs) > 4 * STATES:
            self.pairs.clear()
        x, y, before, got = a, b, len(self.ranks) + 256, True
        while got:
            got = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], before) >= before
            left, right = self.halves(x), self.halves(y)
            if left is None and right is None:
                break
            if right is None or (left is not None and x > y):
                before, x = x, left[1]
            else:
                before, y = y + 1, right[0]
        self.pairs[a << 32 | b] = got
        return got

    def move(self, members: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """Next set and what it lets go of; the first member of a set stands at the end of a token."""
        next_, pairs = self.next, self.pairs
        closed, open_ = None, []
        for node, waiting in members:
            got = next_.get(node | byte)
            if got is None:
                continue
            node, t, more = got
            if closed is None and t >= 0:
                if waiting:
                    fits = pairs.get(waiting[-1] << 32 | t)
                    if self.stable(waiting[-1], t) if fits is None else fits:
                        closed = (*waiting, t)
                else:
                    closed = (t,)
            if more:
                open_.append((node, waiting))
        if not open_:
            return ((0, closed[-1:]),), closed[:-1]
        agreed = closed
        for _, waiting in open_:
            n = min(len(agreed), len(waiting))
            while n and waiting[:n] != agreed[:n]:
                n -= 1
            agreed = agreed[:n]
        # the last agreed token stays as left neighbour of what follows
        gone = len(agreed) - 1
        if gone > 0:
            return ((0, closed[gone:]), *[(n, w[gone:]) for n, w in open_]), agreed[:gone]
        return ((0, closed), *open_), ()

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The same between stored states, remembered."""
        members, out = self.move(self.sets[state], byte)
        made = self.steps[state << 8 | byte] = (self._state(members), out)
        return made

    def _deep(self, members: tuple, rest: bytes) -> list[int]:
        """Tokens of the rest of a piece from a set of states that is not stored.

        The same moves, but tokens not yet written are kept as a chain: each place a
        token ends at knows that token and the place it began at, so nothing is copied.
        """
        next_, pairs = self.next, self.pairs
        given = [waiting for _, waiting in members]
        last, begun = [w[-1] if w else -1 for w in given], list(range(len(given)))
        open_ = [(node, i) for i, (node, _) in enumerate(members)]
        for b in rest:
            closed, moved = False, [(0, len(last))]
            for node, at in open_:
                got = next_.get(node | b)
                if got is None:
                    continue
                node, t, more = got
                if t >= 0 and not closed:
                    before = last[at]
                    fits = before < 0 or pairs.get(before << 32 | t)
                    if self.stable(before, t) if fits is None else fits:
                        closed = True
                        last.append(t)
                        begun.append(at)
                if more:
                    moved.append((node, at))
            open_ = moved
        at, out = len(last) - 1, []
        while at >= len(given):
            out.append(last[at])
            at = begun[at]
        return [*given[at], *reversed(out)]

    def encode(self, piece: str) -> tuple[bytes, bytes]:
        """Ids of a piece as packed 32-bit numbers, and the bytes these ids stand for."""
        got = self.pieces.get(piece) or self.older.get(piece)
        if got is not None:
            return self._keep(piece, got)
        if len(self.sets) > STATES:
            self._empty()
        state, ids, steps, raw = 0, [], self.steps, piece.encode()
        for b in raw[:DEEP]:
            state, out = steps.get(state << 8 | b) or self.step(state, b)
            if out:
                ids.extend(out)
        ids.extend(self._deep(self.sets[state], raw[DEEP:]) if len(raw) > DEEP else self.sets[state][0][1])
        return self._keep(piece, (_PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes(),
                                  b"".join([self.bytes_of[i] for i in ids])))

    def _keep(self, piece: str, got: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        """Remember a piece; pieces not met since the last turn of the store are forgotten at the next."""
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES // 2:
                self.older = self.pieces.copy()
                self.pieces.clear()
            self.pieces[piece] = got
        return got


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Merges by rank, lowest first and leftmost among equals, only those under ``below`` if given: the definition."""
    parts, none = [piece[i:i + 1] for i in range(len(piece))], len(ranks) + 256
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
        if rank >= (none if below is None else below):
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(read_ranks(path))


def packed(text: bytes, pattern: regex.Pattern, with_: Transducer) -> list[tuple[bytes, bytes]]:
    """Packed ids and the bytes they stand for, of each match of the pattern in a whole text."""
    one, known = with_.encode, with_.pieces.get
    return [known(p) or one(p) for p in pattern.findall(text.decode("utf-8", "replace"))]


def encode(text: bytes, pattern: regex.Pattern, with_: Transducer) -> list[int]:
    """Ids of a whole text, each match of the pattern encoded by itself."""
    return np.frombuffer(b"".join([ids for ids, _ in packed(text, pattern, with_)]), "<u4").tolist()


class Utf8Stream:
    """Bytes in any chunks to text: characters come out whole, a cut one waits for its rest.

    The state is how many bytes the open character still lacks, with the bytes seen.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _lacking(tail: bytes) -> int:
        """Length of an unfinished character at the end of the bytes."""
        lacks = 0
        for back in range(1, min(4, len(tail) + 1)):
            b = tail[-back]
            if b & 0xC0 == 0x80:
                continue
            needs = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            if needs > back:
                lacks = back
            break
        return lacks

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = self._lacking(data)
        self.held = data[len(data) - cut:] if cut else b""
        return data[: len(data) - cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode(ids: Iterable[int], bytes_of: dict[int, bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of the ids in parts, holding no more than a chunk of tokens."""
    stream, ids = Utf8Stream(), iter(ids)
    while part := list(islice(ids, chunk)):
        yield stream.feed(b"".join(map(bytes_of.__getitem__, part)))
    yield stream.close()


def round_trip(docs: DataFrame, keep: list[str], path: str, pattern: str, text: str = "text",
               with_ids: bool = False) -> DataFrame:
    """``keep``, ``n_tokens`` and the SHA-256 of ids and of the text decoded from them; ids too if asked.

    A null text counts as the empty one, which has no tokens.  Repeated rows are
    each encoded; columns that are not named are not read.
    """
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_, compiled = transducer(path), regex.compile(pattern)
        gc.disable()  # the tables are millions of small tuples without cycles: nothing for the collector to find
        try:
            for rows in batches:
                n, first, second, all_ids = [], [], [], []
                for t in rows["_t"]:
                    found = packed(t, compiled, with_)
                    ids, back, stream = b"".join([i for i, _ in found]), hashlib.sha256(), Utf8Stream()
                    raw = b"".join([r for _, r in found])  # what the ids stand for, not the text
                    for begin in range(0, len(raw), CHUNK):
                        back.update(stream.feed(raw[begin:begin + CHUNK]).encode())
                    back.update(stream.close().encode())
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(back.hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, "<u4").tolist())
                made = {"n_tokens": np.array(n, np.int64), "ids_sha256": first, "decoded_sha256": second}
                if with_ids:
                    made["ids"] = all_ids
                yield pd.concat([rows[keep], pd.DataFrame(made, index=rows.index)], axis=1)
        finally:
            gc.enable()
    return frames(docs.select(*keep, octets(text).alias("_t")), work,
                  kinds + "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
