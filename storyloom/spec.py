"""What a caller may ask for, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FilterSpec:
    """Catalogue conditions, all ANDed.  Unset ones do not restrict.

    ``ids`` narrows to candidates and an absent one means no narrowing;
    ``job_ids`` is a scope, so an empty one leaves nothing.
    """

    state: str = "all"
    availability: str | None = None
    collection: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    author: tuple[str, ...] = ()
    author_ignore_case: bool = True
    bookmarked_by: str | None = None
    rating: tuple[str, ...] = ()
    language: str | None = None
    complete: bool | None = None
    words_min: int | None = None
    words_max: int | None = None
    chapters_min: int | None = None
    chapters_max: int | None = None
    updated_after: str | None = None
    updated_before: str | None = None
    otp: bool = False
    crossover: bool | None = None
    ids: DataFrame | None = None
    job_ids: DataFrame | None = None
    show_unrevealed: bool = False

    def but(self, **changes: Any) -> FilterSpec:
        return replace(self, **changes)


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; ``prefix`` lets the last one be the start of a word.

    With ``near`` set, the two terms need only lie at most ``near`` tokens
    apart, in either order.
    """

    terms: tuple[str, ...]
    prefix: bool = False
    near: int | None = None

    @staticmethod
    def of(text: str, prefix: bool = False) -> Phrase:
        return Phrase(tuple(text.split()), prefix)


@dataclass(frozen=True)
class SearchSpec:
    """All of these phrases, at least one of those, none of the last."""

    all_of: tuple[Phrase, ...] = ()
    any_of: tuple[Phrase, ...] = ()
    none_of: tuple[Phrase, ...] = field(default=())

    @property
    def blank(self) -> bool:
        """Nothing to look for; a search that only excludes finds nothing."""
        return not any(p.terms for p in (*self.all_of, *self.any_of))

    @property
    def wanted(self) -> tuple[Phrase, ...]:
        return tuple(p for p in (*self.all_of, *self.any_of) if p.terms)

    @staticmethod
    def typed(*words: str) -> SearchSpec:
        """Every word, the last one taken as still being typed."""
        if not words:
            return SearchSpec()
        return SearchSpec(all_of=tuple(
            Phrase((w,), prefix=i == len(words) - 1) for i, w in enumerate(words)))
