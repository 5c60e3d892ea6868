"""Word lists as data: one entry a line, # starts a comment. Each is read once a process."""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files

from sprachwerk.resources.fixed import DOMAINS, SYNONYMS


@lru_cache(None)
def lines(name: str) -> tuple[str, ...]:
    text = (files(__name__) / name).read_text(encoding="utf-8")
    return tuple(x for x in text.split("\n") if x and not x.startswith("#"))


def words(name: str) -> frozenset[str]:
    return frozenset(lines(name))


def synonyms() -> dict[str, tuple[str, ...]]:
    return dict(SYNONYMS)


def terms(domain: str | None = None) -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """(domain, preferred, aliases) of one pack or of all."""
    return tuple((name, preferred, aliases) for name, _, _, own in DOMAINS if domain in (None, name) for preferred, aliases in own)


def domains() -> tuple[str, ...]:
    return tuple(name for name, *_ in DOMAINS)


def document_types(domain: str) -> tuple[str, ...]:
    """Kinds of documents that a pack is for."""
    return next(kinds for name, _, kinds, _ in DOMAINS if name == domain)
