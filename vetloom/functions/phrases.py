"""Patterns from plain word lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = ".^$|()[]{}*+?\\"


def literal(text: str) -> str:
    """A pattern that matches ``text`` itself in every regex dialect used here."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def any_of(choices: Iterable[str]) -> str:
    """One of the choices, longer ones first; blanks inside a choice match any blanks."""
    ordered = sorted(dict.fromkeys(choices), key=lambda w: (-len(w), w))
    return "(?:" + "|".join(r"\s+".join(literal(part) for part in w.split(" ")) for w in ordered) + ")"


def bare_heading(line: Column) -> Column:
    """A line as headings are listed: lower case, single blanks, without a colon or dash at its end."""
    return F.lower(F.regexp_replace(F.regexp_replace(line, r"^\s+|\s*[:-]?\s*$", ""), r"\s+", " "))
