"""License scans: templates with markup, compiled to token automata.

A template is wording with regions: ``<<optional>> ... <<end>>`` may be missing,
and ``<<any LOW-HIGH>>`` stands for so many words of any kind.  All other words are
mandatory, and a text is accepted where they stand exactly so.

A template compiles to states joined by single words or by any word.  Running it from
every place of a text at once keeps a set of states, each with the first place it was
reached from.  Sets are determinised as they are met: a step knows the next set and
which old state each new one takes its place from, so a place costs one look-up.
Words that no template names are all alike, which keeps the steps few.

Every stretch of mandatory words stands in every text a template accepts; only texts
that hold them are run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from storyloom.llm.common import LOWER, frames, octets

#: Phrases and the labels they stand for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WARRANTY = """the software is provided <<optional>> as is <<end>> without warranty of any kind express or implied including but not
limited to the warranties of merchantability fitness for a particular purpose and noninfringement"""

#: The wording of public licenses and of the notices that name them.
TEMPLATES = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
        is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software
        """ + _WARRANTY,
    "mit-notice": """<<optional>> is <<end>> released under the <<optional>> terms of the <<end>> mit license""",
    "apache-2.0-notice": """licensed under the apache license version 2 0 <<optional>> the license <<optional>> you may not use this file
        except in compliance with the license <<end>> <<end>>""",
    "apache-2.0-boilerplate": """licensed under the apache license version 2 0 the license you may not use this <<any 1-3>> except in
        compliance with the license you may obtain a copy of the license at <<any 3-12>> unless required by applicable law or agreed to
        in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
        either express or implied see the license for the specific language governing permissions and limitations under the license""",
    "gpl-3.0-notice": """licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> gpl <<end>>
        version 3 <<optional>> or <<optional>> any <<end>> later <<optional>> version <<end>> <<end>>""",
    "gpl-2.0-notice": """licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> gpl <<end>>
        version 2 <<optional>> or <<optional>> any <<end>> later <<optional>> version <<end>> <<end>>""",
    "gpl-header": """<<any 1-6>> is free software you can redistribute it and or modify it under the terms of the gnu <<optional>> lesser
        <<end>> <<optional>> affero <<end>> general public license as published by the free software foundation either version <<any 1-2>>
        of the license or at your option any later version""",
    "cc-by-nc": """licensed under <<optional>> a <<end>> cc by nc <<any 1-2>>""",
    "cc-by-sa": """licensed under <<optional>> a <<end>> cc by sa <<any 1-2>>""",
    "cc-text": """licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution <<any 0-4>>
        <<any 1-2>> <<optional>> international <<end>> license""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this
        list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution <<optional>> <<optional>> 3 <<end>> neither the name of <<any 1-12>> nor the names of <<any 1-3>> contributors
        may be used to endorse or promote products derived from this software without specific prior written permission <<end>>""",
    "isc-text": """permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    "mpl-2.0-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at <<any 3-8>>""",
    "all-rights-reserved": """copyright <<any 0-6>> all rights reserved""",
}

#: Blanks out what is no part of a word, lower-cases A-Z and keeps the rest.
_CUT = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).translate(LOWER)
_MARK = re.compile(r"<<(optional|end|any (\d+)-(\d+))>>|(\S+)")
#: Sets of states held by a worker for each template before they are made anew.
SETS = 20_000


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(_CUT).split()


class Template:
    """The automaton of one template: ``ways[state]`` are (word or None for any, next state) and free moves."""

    def __init__(self, markup: str):
        self.ways: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        at, opened, self.stretches = 0, [], [[]]  # stretches: mandatory words in one piece
        for mark in _MARK.finditer(markup):
            kind, low, high, word = mark.groups()
            if word is not None:
                if "<<" in word or ">>" in word or words_of(word.encode()) != [word.encode()]:
                    raise ValueError(f"not a word or region: {word}")
                at = self._add(at, word.encode())
                if not opened:
                    self.stretches[-1].append(word.encode())
                continue
            self.stretches.append([])
            if kind == "optional":
                opened.append(at)
            elif kind == "end":
                if not opened:
                    raise ValueError("an end without a beginning")
                at = self._skip(opened.pop(), at)
            else:
                if int(low) > int(high):
                    raise ValueError(f"no number lies in {kind}")
                for i in range(int(high)):
                    before = at
                    at = self._add(at, None)
                    if i >= int(low):
                        self.free[before].append(-1 - i)  # leaves for the end of the region, filled in below
                for moves in self.free:
                    moves[:] = [at if m < 0 else m for m in moves]
        self.stretches = [s for s in self.stretches if s]
        self.mandatory = sum(map(len, self.stretches))
        if opened or not self.mandatory:
            raise ValueError("a region without an end" if opened else "no mandatory word outside of regions")
        self.last = at
        self.named = {w for ways in self.ways for w, _ in ways if w is not None}
        self._empty()

    def _state(self) -> int:
        self.ways.append([])
        self.free.append([])
        return len(self.ways) - 1

    def _add(self, at: int, word: bytes | None) -> int:
        new = self._state()
        self.ways[at].append((word, new))
        return new

    def _skip(self, begin: int, end: int) -> int:
        new = self._state()
        self.free[begin].append(new)
        self.free[end].append(new)
        return new

    def _closed(self, state: int) -> list[int]:
        """A state and what free moves lead to, each once."""
        out, todo = [], [state]
        while todo:
            s = todo.pop()
            if s not in out:
                out.append(s)
                todo += reversed(self.free[s])
        return out

    def _empty(self) -> None:
        self.sets: dict[tuple[int, ...], int] = {}
        self.members: list[tuple[int, ...]] = []
        self.steps: dict[tuple[int, bytes | None], tuple[int, tuple[int, ...], int]] = {}
        self.begun = self._number(tuple(self._closed(0)))

    def _number(self, members: tuple[int, ...]) -> int:
        if members not in self.sets:
            self.sets[members] = len(self.members)
            self.members.append(members)
        return self.sets[members]

    def step(self, at: int, word: bytes | None) -> tuple[int, tuple[int, ...], int]:
        """Next set, for each of its states the old one it takes its place from, and where in it the last state is (or -1).

        The states of a set are in order of their places, the earliest first, so the
        first way into a state is the one that counts.  Position -1 stands for a run
        that begins with the next word.
        """
        taken: dict[int, int] = {}
        for i, state in enumerate(self.members[at]):
            for named, target in self.ways[state]:
                if named is None or named == word:
                    for s in self._closed(target):
                        taken.setdefault(s, i)
        end = list(taken).index(self.last) if self.last in taken else -1
        for s in self._closed(0):
            taken.setdefault(s, -1)
        out = self._number(tuple(taken)), tuple(taken.values()), end
        self.steps[at, word] = out
        return out

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, word after the last) of the texts accepted: leftmost ones, each as long as it can be, none in another."""
        if len(self.members) > SETS:
            self._empty()
        named, steps, found, begin = self.named, self.steps, [], 0
        while begin < len(words):
            at, places, best = self.begun, [begin] * len(self.members[self.begun]), None
            for i in range(begin, len(words)):
                key = at, words[i] if words[i] in named else None
                at, takes, end = steps.get(key) or self.step(*key)
                places = [places[t] if t >= 0 else i + 1 for t in takes]
                if end >= 0 and (best is None or places[end] <= best[0]):
                    best = places[end], i + 1
                if best and places[0] > best[0]:
                    break  # nothing that began so early goes on
            if best is None:
                break
            found.append(best)
            begin = best[1]
        return found


class Scanner:
    """Phrases and compiled templates of a scan."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.templates = {label: Template(markup) for label, markup in templates.items()}
        self.phrases = [(b" %s " % b" ".join(words_of(p.encode())), label) for p, label in phrases.items()]
        self.needed = {label: sorted((b" %s " % b" ".join(s) for s in t.stretches), key=len, reverse=True)
                       for label, t in self.templates.items()}
        # the wording that stands behind a phrase: the shortest template that holds it
        self.share = {}
        for phrase, label in self.phrases:
            n = phrase.count(b" ") - 1
            behind = [t.mandatory for name, t in self.templates.items() if any(phrase in s for s in self.needed[name])]
            self.share[label] = max(self.share.get(label, 0.0), min(1.0, n / min(behind)) if behind else 1.0)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Words of a text, places of phrases and spans of templates, each with its label."""
        words = words_of(text)
        line = b" %s " % b" ".join(words)
        places, spans = [], []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            seen, word, n = 0, 0, phrase.count(b" ") - 1
            while at >= 0:
                word += line.count(b" ", seen, at)
                seen = at
                places.append((word, word + n, label))
                at = line.find(phrase, at + 1)
        for label, needed in self.needed.items():
            if all(n in line for n in needed):
                spans += [(a, b, label) for a, b in self.templates[label].spans(words)]
        return len(words), places, spans


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, keep: list[str], text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
         with_spans: bool = False) -> DataFrame:
    """``keep`` and what license wording every row's text holds; the spans of words and their labels too if asked.

    ``n_words`` words, ``n_base`` places of phrases with their smallest and greatest
    start (null without one), ``base_labels`` of the phrases, ``labels`` of phrases and
    templates together, both sorted and joined by commas.  ``score`` is how much of the
    wording behind the surest label was found: 1 where a template accepts, for a mere
    phrase its share of the shortest template that holds it, else 0.

    A null or empty text has no words, no labels and score 0; repeated rows are each
    answered, texts of any length are read whole, an empty table gives an empty one.
    Other columns are not read; a kept column may not bear the name of a new one.
    """
    if set(keep) & {*NAMES, "spans"}:
        raise ValueError(f"rename {sorted(set(keep) & {*NAMES, 'spans'})} first")
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    given = tuple(phrases.items()), tuple(templates.items())
    _scanner(*given)  # a template that does not compile is told here, not by a task

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(*given)
        for rows in batches:
            made = []
            for t in rows["_t"]:
                n, places, spans = scanner.scan(t)
                base = {label for *_, label in places}
                starts = [a for a, *_ in places]
                score = 1.0 if spans else max((scanner.share[label] for label in base), default=0.0)
                made.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | {label for *_, label in spans})), score,
                             *([[dict(zip(("first", "after", "label"), s)) for s in sorted(places + spans)]] if with_spans else [])))
            table = pd.DataFrame(made, columns=[*NAMES, *(["spans"] if with_spans else [])], index=rows.index, dtype=object)
            yield pd.concat([rows[[f"_k{i}" for i in range(len(keep))]].set_axis(keep, axis=1), table.astype({"score": np.float64})], axis=1)
    rows = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], octets(text).alias("_t"))
    return frames(rows, work, kinds + "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                  "score double" + (", spans array<struct<first: long, after: long, label: string>>" if with_spans else ""))


def pattern(markup: str) -> str:
    """A template as a regular expression over words each followed by a blank: the same wording said another way."""
    out = []
    for mark in _MARK.finditer(markup):
        kind, low, high, word = mark.groups()
        out.append(f"{word} " if word else "(?:" if kind == "optional" else ")?" if kind == "end" else f"(?:[^ ]+ ){{{low},{high}}}")
    return " " + "".join(out)
