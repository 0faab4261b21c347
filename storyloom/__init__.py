"""Analytics over large libraries of serial fiction, as Spark jobs."""

from storyloom.model import Library, evolve
from storyloom.spec import FilterSpec, Phrase, SearchSpec

__all__ = ["FilterSpec", "Library", "Phrase", "SearchSpec", "evolve"]
