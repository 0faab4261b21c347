"""Language spans: script ranges narrow the candidates, Viterbi labels the words.

Training counts letter n-grams (UTF-8 bytes of lower-cased words, hashed) and
scripts by language over all rows that carry one.  A word's score for a language
is the log probability of its n-grams; languages that never use the word's script
are out.  Over a text, dynamic programming finds the labels of highest total
score where every change of language costs a penalty, so single odd words do not
break a span and real insertions do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import frames, octets

#: Where runs of letters of one script begin in Unicode, and the script's name.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])

#: Bins of the n-gram counts: bounds the model at bins x languages whatever the corpus.
BINS = 1 << 16
#: Lengths of the n-grams in bytes, the word's two edges included.
GRAMS = (2, 3, 4, 5)
#: Cost of changing the language between two words, in nats.
SWITCH = 14.0
#: A language is a candidate for a script that makes up at least this share of its training letters.
SCRIPT_SHARE = 0.001

_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: bytes) -> list[str]:
    """Lower-cased runs of letters."""
    found = _RUN.findall(text.decode("utf-8", "replace").lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every n-gram of the words, and the index of its word."""
    raw = [w.encode("utf-8", "replace") for w in words]
    flat = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).astype(np.uint64)
    edge = np.cumsum(np.concatenate(([0], np.fromiter(map(len, raw), np.int64, len(raw)) + 1)))
    inside = np.zeros(len(flat), np.int64)
    inside[edge[:-1]] = 1
    owner = np.cumsum(inside) - 1
    stops = np.concatenate(([0], np.cumsum(flat == 32)))
    bins, owners = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        last = len(flat) - n + 1
        h = np.full(last, n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ (flat[i:last + i] * np.uint64(0x9E3779B97F4A7C15))
        ok = stops[n - 1:last + n - 1] - stops[1:last + 1] == 0  # no edge but at either end
        bins.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48))[ok])
        owners.append(owner[:last][ok])
    return np.concatenate(bins).astype(np.int64), np.concatenate(owners)


def _scripts(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT[np.searchsorted(_STARTS, first, "right") - 1]


@dataclass(frozen=True)
class LanguageModel:
    """Languages, log probabilities (bins x languages) and which languages may use a script."""
    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word for each language, and its number of n-grams; languages that do not use its script are far below."""
        out, grams = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        if words:
            bins, owner = _grams(words)
            grams = np.bincount(owner, minlength=len(words))
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(owner, self.weights[bins, k], len(words))
            allowed = self.allowed[_scripts(words)]
            out = np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, -1e6)
        return out, grams


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count n-grams and scripts of every row with a language; null texts count nothing."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for rows in batches:
            for name, texts in rows.groupby("_l")["_t"]:
                seen = Counter()
                for t in texts:
                    seen.update(words_of(t))
                if not seen:
                    continue
                words, times = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
                bins, owner = _grams(words)
                made = total.setdefault(name, np.zeros(BINS + len(_NAMES)))
                made[:BINS] += np.bincount(bins, times[owner], BINS)
                made[BINS:] += np.bincount(_scripts(words), times, len(_NAMES))
        for name, made in total.items():
            at = np.nonzero(made)[0]
            yield pd.DataFrame({"lang": name, "bin": at, "n": made[at].astype(np.int64)})
    counted = frames(docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_l"), octets(text).alias("_t")),
                     work, "lang string, bin long, n long")
    summed = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(summed["lang"].unique())
    table = np.zeros((BINS + len(_NAMES), len(names)))
    for k, name in enumerate(names):
        mine = summed[summed["lang"] == name]
        table[mine["bin"].to_numpy(), k] = mine["n"].to_numpy()
    grams, scripts = table[:BINS], table[BINS:]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BINS)) if names else np.zeros((BINS, 0))
    return LanguageModel(names, weights, scripts >= SCRIPT_SHARE * scripts.sum(axis=0))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word of several texts laid end to end, all texts advancing together."""
    total, n = scores.shape
    if not total:
        return np.empty(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    came = np.empty((total, n), np.int8 if n < 128 else np.int32)
    best = np.zeros((len(lengths), n))
    best[: live[0]] = scores[begin[: live[0]]]
    for t in range(1, len(live)):
        k = live[t]
        now = best[:k]
        top = now.argmax(axis=1)
        leave = now[np.arange(k), top][:, None] - switch
        at = begin[:k] + t
        came[at] = np.where(now >= leave, np.arange(n), top[:, None])
        best[:k] = np.maximum(now, leave) + scores[at]
    labels = np.empty(total, np.int64)
    state = best.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return labels


def label(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", switch: float = SWITCH) -> DataFrame:
    """``keep`` and ``lang_pred``, ``score``, ``spans`` (first word, words, language) of every row.

    The text's language is the one with most letters in its spans, the first by
    name at a tie; the score is its share of the letters.  A null text, one
    without letters, or a model without languages gives ``und``, 0 and no spans.

    ``letters`` counts the text's letters.  ``evidence`` is by how much, in nats for an
    n-gram, the spans' languages explain the text better than chance does (every bin
    alike): letters without a language stay below 0.  It is null where the model has
    no language or the text no letter.
    """
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    names, shared = np.array([*model.languages, "und"]), model

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(shared.languages)
        for rows in batches:
            seen: dict[str, int] = {}
            ids = [[seen.setdefault(w, len(seen)) for w in words_of(t)] for t in rows["_t"]]
            if not n:
                yield pd.concat([rows[keep], pd.DataFrame({
                    "lang_pred": "und", "score": 0.0, "spans": [[] for _ in ids], "evidence": None,
                    "letters": [sum(len(w) for w in words_of(t)) for t in rows["_t"]]}, index=rows.index)], axis=1)
                continue
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
            known = list(seen)
            size = np.fromiter(map(len, known), np.int64, len(known))
            words, grams = shared.scores(known)
            labels = viterbi(words[flat], lengths, switch)
            owner = np.repeat(np.arange(len(ids)), lengths)
            mass = np.zeros((len(ids), n + 1))
            np.add.at(mass, (owner, labels), size[flat])
            mass[lengths == 0, n] = 1
            pred = mass.argmax(axis=1)
            letters = np.bincount(owner, size[flat], len(ids)).astype(np.int64)
            fit = np.bincount(owner, np.maximum(words[flat, labels], -1e5), len(ids)) / np.maximum(np.bincount(owner, grams[flat], len(ids)), 1)
            evidence = np.where(lengths > 0, fit + np.log(BINS), np.nan)
            share = np.where(lengths > 0, mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1), 0.0)
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1]))) if len(flat) else np.zeros(0, bool)
            cut = np.nonzero(new)[0]
            run = np.diff(np.concatenate((cut, [len(flat)])))
            first = np.cumsum(lengths) - lengths
            spans: list[list[dict]] = [[] for _ in ids]
            for o, c, r, k in zip(owner[cut].tolist(), cut.tolist(), run.tolist(), labels[cut].tolist()):
                spans[o].append({"first": c - int(first[o]), "words": r, "lang": str(names[k])})
            yield pd.concat([rows[keep], pd.DataFrame(
                {"lang_pred": names[pred], "score": share, "spans": spans, "evidence": evidence, "letters": letters}, index=rows.index)], axis=1)
    return frames(docs.select(*keep, octets(text).alias("_t")), work,
                  kinds + "lang_pred string, score double, spans array<struct<first: long, words: long, lang: string>>, "
                  "evidence double, letters long")
