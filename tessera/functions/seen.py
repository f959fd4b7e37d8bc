"""Which terms a text holds, from one pass over it."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Seen:
    """A lower-case text by the terms that rules ask it for.

    Rules are built first, with `contains` and `word` in place of those of a column; each names its term. `column` then gives the
    column that they read, under the name that was agreed: all those terms found by one automaton in one pass over the text,
    anywhere and as whole words, beside which no letter, digit or underscore stands. The terms are those of rules and a profile,
    not of a table, so the automaton is small and goes with the task. A null text holds nothing.
    """

    def __init__(self, name: str):
        self.name = name
        self.terms: dict[str, int] = {}

    def _holds(self, term: str, whole: bool) -> Column:
        k = self.terms.setdefault(term, len(self.terms))
        return F.array_contains(F.col(self.name), F.lit(2 * k + whole))

    def contains(self, term: str) -> Column:
        return self._holds(term, False)

    def word(self, term: str) -> Column:
        return self._holds(term, True)

    def column(self, text: Column) -> Column:
        """array<int>: twice the number of each term that is held, and one more where it is held as a whole word."""
        terms = dict(self.terms)

        @F.arrow_udf("array<int>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = ahocorasick.Automaton()
            for term, k in terms.items():
                automaton.add_word(term, (len(term), k))
            automaton.make_automaton()
            for batch in batches:
                told = (t.as_py() for t in batch)  # one text at a time, so that a batch isn't held twice
                yield pa.array((_scan(automaton, t) if t and terms else [] for t in told), pa.list_(pa.int32()))

        return found(text)


def _inner(c: str) -> bool:
    return c.isalnum() or c == "_"


def _scan(automaton: ahocorasick.Automaton, text: str) -> list[int]:
    out: set[int] = set()
    last = len(text) - 1
    for end, (n, k) in automaton.iter(text):
        out.add(2 * k)
        if 2 * k + 1 not in out and (end == last or not _inner(text[end + 1])) and (end < n or not _inner(text[end - n])):
            out.add(2 * k + 1)
    return sorted(out)
