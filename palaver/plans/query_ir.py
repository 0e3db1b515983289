"""Structured queries and the terms they ask for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

#: A name that stands for anyone.
ANY = "*"


@dataclass(frozen=True)
class FacetTerm:
    name: str
    value: str


@dataclass(frozen=True)
class EntityTerm:
    name: str
    types: tuple[str, ...] = ()
    facets: tuple[FacetTerm, ...] = ()

    def terms(self) -> list[str]:
        return [self.name, *[x for f in self.facets for x in (f.name, f.value)], *self.types]


@dataclass(frozen=True)
class ActionTerm:
    verbs: tuple[str, ...] = ()
    actors: tuple[EntityTerm, ...] | str = ANY
    targets: tuple[EntityTerm, ...] = ()
    tense: str | None = None


@dataclass(frozen=True)
class Filter:
    action: ActionTerm | None = None
    entities: tuple[EntityTerm, ...] = ()
    search_terms: tuple[str, ...] = ()
    time_range: tuple[date, date | None] | None = None


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = ()
    question: str = ""
    extended: bool = False  # also use what the plain form ignores: action targets
    extra: dict = field(default_factory=dict, hash=False, compare=False)


def terms(query: Query) -> list[str]:
    """All terms of a query, lower case, each once, in order: entities, then actions, then search terms, filter by filter."""
    found: list[str] = []
    for f in query.filters:
        for e in f.entities:
            found += e.terms()
        if f.action:
            found += f.action.verbs
            if f.action.actors != ANY:
                for e in f.action.actors:
                    found += e.terms()
            if query.extended:
                for e in f.action.targets:
                    found += e.terms()
        found += f.search_terms
    return list(dict.fromkeys(t.lower() for t in found if t))


def of_terms(asked: list[str]) -> Query:
    return Query((Filter(search_terms=tuple(asked)),), " ".join(asked))


def time_range(query: Query) -> tuple[date, date | None] | None:
    """The last structured range counts."""
    return next((f.time_range for f in reversed(query.filters) if f.time_range), None)
