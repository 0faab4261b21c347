"""Counts of a whole text, as the quality operators use them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from storyloom.llm.common import frames, octets

#: The counts of a text, all long.
COUNTS = ("n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct",
          "n_upper", "n_lower", "n_digits", "n_points", "n_wide", "n_common", "longest_word", "n_same_word")

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_POINTS = np.frombuffer(b"!\"'()+,-./:;=?@[]\\^_`{}~", np.uint8)


def repeated(ids: np.ndarray) -> np.ndarray:
    """Which words lie in a 3-word window that is found twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < 4:
        return covered
    n = int(ids.max()) + 1
    if n < 2_000_000:
        window = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * n + ids[2:]
    order = np.argsort(window)
    same = np.diff(window[order]) == 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for i in range(3):
        covered[i:len(ids) - 2 + i] |= twice
    return covered


def counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    space = int(by_byte[9:14].sum() + by_byte[32])
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if len(words) else []
    often = np.bincount(ids, minlength=1)
    return (len(text), len(words), len(text) - int(by_byte[0x80:0xC0].sum()) - space, int(by_byte[_SYMBOLS].sum()),
            len(lines), len(lines) - len(set(lines)), int(repeated(ids).sum()), len(seen),
            int(by_byte[65:91].sum()), int(by_byte[97:123].sum()), int(by_byte[48:58].sum()), int(by_byte[_POINTS].sum()),
            int(by_byte[0xC0:].sum()), int(often.max()), max(map(len, seen), default=0),
            int((ids[1:] == ids[:-1]).sum()))


def text_counts(docs: DataFrame, keep: list[str], text: str = "text", prefix: str = "_s_") -> DataFrame:
    """The columns ``keep`` and :data:`COUNTS`, each name with the prefix, of every row.

    Words are runs of anything but space and the ASCII controls 9 to 13, the
    same as ``bytes.split`` cuts.  A null text counts as the empty one; repeated
    rows are counted each; the prefix keeps the counts apart from columns of the table.
    """
    names = [prefix + c for c in COUNTS]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in names]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = np.array([counts(t) for t in rows["_t"]], np.int64).reshape(len(rows), len(COUNTS))
            yield pd.concat([rows[keep], pd.DataFrame(made, columns=names, index=rows.index)], axis=1)
    return frames(docs.select(*keep, octets(text).alias("_t")), work, ", ".join(kinds))
