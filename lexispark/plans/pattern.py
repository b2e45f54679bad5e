"""Search patterns to column predicates.

A query is blank-separated terms; each term is a word pattern (`govern*`), a lemma pattern (`[have]`), a tag
pattern (`_N*|V*`), or lemma and tag together (`[have]_V*`).  `*` matches anything.  Patterns become plain
comparisons where their shape allows, a regular expression only otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.semantics import LEMMA_TERM_RE, TAG_TERM_RE


def regex_quote(text: str) -> str:
    """Text as a literal for Java's and RE2's dialects alike."""
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII)


def wildcard(column: Column, pattern: str) -> Column:
    """Full match of a `*` pattern."""
    body = pattern.strip("*")
    if "*" not in body:
        if pattern == body:
            return column == body
        if not body:
            return column.isNotNull()
        if pattern.strip("*") and re.fullmatch(r"\*+[^*]+\*+", pattern):
            return column.contains(body)
        if pattern.startswith("*"):
            return column.endswith(body)
        return column.startswith(body)
    return column.rlike(r"(?s)\A" + ".*".join(regex_quote(p) for p in pattern.split("*")) + r"\z")


def any_of(column: Column, patterns: str) -> Column:
    """`|`-separated wildcard patterns."""
    out = F.lit(False)
    for p in (x.strip() for x in patterns.split("|")):
        if p:
            out = out | wildcard(column, p)
    return out


def filter_pattern(column: Column, pattern: str) -> Column:
    """Collocate filters: `*`, `|` and `.` (any one character), full match."""
    quoted = "".join({"*": ".*", "|": "|", ".": "."}.get(c, regex_quote(c)) for c in pattern)
    return column.rlike(r"(?s)\A(?:" + quoted + r")\z")


@dataclass(frozen=True)
class Term:
    word: str | None = None
    lemma: str | None = None
    tag: str | None = None

    @property
    def structural(self) -> bool:
        return self.word is None

    def matches(self, low: Column, tag: Column, lemma: Column) -> Column:
        if self.word is not None:
            return wildcard(low, self.word)
        out = F.lit(True)
        if self.lemma:
            out = out & wildcard(F.lower(lemma), self.lemma)
        if self.tag:
            out = out & any_of(tag, self.tag)
        return out


def parse_term(term: str) -> Term:
    lemma = re.search(LEMMA_TERM_RE, term)
    tag = re.search(TAG_TERM_RE, term[lemma.end() :] if lemma else term)
    lemma_text = lemma.group(1).strip().lower() if lemma else ""
    if lemma_text or tag:
        return Term(lemma=lemma_text or None, tag=tag.group(1) if tag else None)
    return Term(word=term.lower())


def parse(query: str) -> list[Term]:
    return [parse_term(t) for t in query.split()]


def at(terms: list[Term], raw: bool) -> Callable[[Column, Callable[[str, int], Column]], Column]:
    """A predicate for 'the terms match from index i on'.  `get(name, k)` reads array `name` at i + k."""

    def predicate(_: Column, get: Callable[[str, int], Column]) -> Column:
        if raw and any(t.structural for t in terms):
            return F.lit(False)
        out = None
        for k, t in enumerate(terms):
            one = t.matches(get("low", k), get("tag", k), get("lemma", k))
            out = one if out is None else out & one
        return F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)

    return predicate
