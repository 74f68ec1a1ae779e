"""A query as a lattice: alternatives that each cover an interval of its words.

Synonym rules meet in every combination, but the combinations are never listed: an entry matches if a way leads from the
first word to the last over alternatives whose words it holds, which is found alternative by alternative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: left terms and right terms; no right ones: all left ones are equal.
Rule = tuple[list[str], list[str]]


@dataclass(frozen=True)
class Term:
    """A word by its forms; edits allowed, or any word that begins so."""

    forms: tuple[str, ...]
    edits: int = 0
    prefix: bool = False


@dataclass(frozen=True)
class Arc:
    start: int
    end: int
    terms: tuple[int, ...]


@dataclass
class Lattice:
    length: int
    terms: list[Term] = field(default_factory=list)
    arcs: list[Arc] = field(default_factory=list)

    def number(self, term: Term) -> int:
        if term not in self.terms:
            self.terms.append(term)
        return self.terms.index(term)

    def add(self, start: int, end: int, terms: list[Term]) -> None:
        arc = Arc(start, end, tuple(dict.fromkeys(map(self.number, terms))))
        if arc not in self.arcs:
            self.arcs.append(arc)

    @property
    def plain(self) -> bool:
        """One word after another, without alternatives."""
        return sorted((a.start, a.end) for a in self.arcs) == [(i, i + 1) for i in range(self.length)]

    def matched(self, held: Column) -> Column:
        """Whether a way leads through, given the numbers of the terms that an entry holds."""
        if self.plain:
            return F.size(held) == len(self.terms)
        return F.array_contains(self._walk(held), F.lit(self.length))

    def _walk(self, held: Column) -> Column:
        """The places that are reached. Arcs come by their start, so all that end in a place come before those that begin there."""
        arcs = F.array(*[F.struct(F.lit(a.start).alias("s"), F.lit(a.end).alias("e"), F.array(*map(F.lit, a.terms)).alias("t")) for a in sorted(self.arcs, key=lambda a: a.start)])

        def step(reached: Column, arc: Column) -> Column:
            open_ = F.array_contains(reached, arc["s"]) & ~F.array_contains(reached, arc["e"]) & (F.size(F.array_except(arc["t"], held)) == 0)
            return F.when(open_, F.array_append(reached, arc["e"])).otherwise(reached)

        return F.aggregate(arcs, F.array(F.lit(0)), step)

    def score(self, scores: Column) -> Column:
        """Of a map from term to score: for each place the best of the alternatives there that are held whole, summed."""
        total = F.lit(0.0)
        for place in sorted({a.start for a in self.arcs}):
            whole = [self._sum([F.try_element_at(scores, F.lit(t)) for t in a.terms]) for a in self.arcs if a.start == place]
            best = F.greatest(*whole, F.lit(0.0)) if whole else F.lit(0.0)
            total = total + best
        return total

    @staticmethod
    def _sum(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def ways(self, most: int = 100) -> Iterator[list[str]]:
        """The first ways through, as words, for people to look at."""
        by: dict[int, list[Arc]] = {}
        for a in self.arcs:
            by.setdefault(a.start, []).append(a)

        def from_(place: int) -> Iterator[list[str]]:
            if place == self.length:
                yield []
            for a in by.get(place, []):
                for rest in from_(a.end):
                    yield [self.terms[t].forms[0] for t in a.terms] + rest

        for n, way in enumerate(from_(0)):
            if n == most:
                return
            yield way


def build(words: list[tuple[str, ...]], rules: list[tuple[list[list[tuple[str, ...]]], list[list[tuple[str, ...]]]]] = (), edits=lambda word: 0) -> Lattice:
    """Of a query's words, given by their forms, and rules over words of the same kind. A term of a one-way rule gives way to the rule's right side; words of rules are exact."""
    out = Lattice(len(words))
    for i, word in enumerate(words):
        equal: list[tuple[int, list[tuple[str, ...]]]] = []
        oneway: list[tuple[int, list[tuple[str, ...]]]] = []
        for left, right in rules:
            for term in left:
                if term and len(term) <= len(words) - i and all(set(a) & set(b) for a, b in zip(term, words[i:], strict=False)):
                    (oneway if right else equal).extend((len(term), r) for r in right or left if r)
        if not oneway:
            out.add(i, i + 1, [Term(word, edits(word[0]))])
        for n, some in [*equal, *oneway]:
            if not (n == 1 and some == [word] and not oneway):
                out.add(i, i + n, [Term(w) for w in some])
    return out
