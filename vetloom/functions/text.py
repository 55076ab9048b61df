"""Text expressions: boundaries, folding, lines, masks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word boundary over ASCII letters, digits and underscore (the engine's own is Unicode aware).
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NO_BREAK_SPACE = "\u00a0"
ZERO_WIDTH = r"[\u200b-\u200d\u2060\ufeff]"
ZERO_WIDTHS = "\u200b\u200c\u200d\u2060\ufeff"


_WORD_CLASS = re.compile(r"\[(?:A-Z|a-z|0-9|[A-Za-z0-9_])+\]")


_ATOM = re.compile(r"\\.|\[\^?.[^\]]*\]|.", re.DOTALL)


def _begins_with_word(pattern: str) -> bool:
    """Whether all that ``pattern`` matches surely begins with a word character; False if that is not plain to see."""
    if not pattern.startswith("("):
        first = re.match(r"[A-Za-z0-9_]|\\[dw]", pattern) or _WORD_CLASS.match(pattern)
        return first is not None and not re.match(r"[?*]|\{[0,]", pattern[first.end() :])
    choices, depth, end = [3 if pattern.startswith("(?:") else 1], 0, 0
    for atom in _ATOM.finditer(pattern):
        depth += {"(": 1, ")": -1}.get(atom[0], 0)
        if atom[0] == "|" and depth == 1:
            choices.append(atom.end())
        if not depth:
            end = atom.end()
            break
    rest = pattern[end:]
    skipped = re.match(r"[?*]|\{[0,]", rest) is not None
    plain = end > 0 and all(_begins_with_word(pattern[c:end]) for c in choices)
    return plain and (not skipped or (rest[0] != "{" and _begins_with_word(rest[1:])))


def regex(pattern: str) -> str:
    """A pattern written with plain ``\\b`` in the form Spark needs for ASCII boundaries.

    Before what begins with a word character, a boundary is where no word character stands before: one look instead of four.
    """
    first, *others = pattern.split(r"\b")
    return first + "".join((r"(?<!\w)" if _begins_with_word(o) else ASCII_BOUNDARY) + o for o in others)


def has_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether some of ``parts`` occurs in the text: a plain search, many times cheaper than a pattern."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in dict.fromkeys(parts)])


def without(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(""))


def found(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(regex(pattern)))


def all_matches(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(regex(pattern)), F.lit(group))


def swap(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, F.lit(regex(pattern)), F.lit(replacement))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable; keeps long chains small enough to compile."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_all(col: Column) -> Column:
    """Trim every kind of ASCII blank, not only spaces."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def squash(col: Column) -> Column:
    """Trim and collapse runs of blanks to one space."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalise_key_text(col: Column, case: str = "upper") -> Column:
    folded = squash(col)
    return F.upper(folded) if case == "upper" else F.lower(folded)


def number_text(col: Column) -> Column:
    """A double the way a cell shows it: no trailing ``.0``."""
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def canonical_answer(col: Column) -> Column:
    number = F.trim(col).try_cast("double")
    plain = F.regexp_like(F.trim(col), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"))
    return F.when(plain, F.concat(F.lit("number:"), number_text(number))).otherwise(
        F.concat(F.lit("text:"), normalise_key_text(col, "lower"))
    )


REFERENCE_CODE = r"^[A-Za-z]{2,6}-?\d{1,6}[A-Za-z]?"
LISTED_CODE = r"\b[A-Z]{2,}-\d+\b"


def parse_reference(col: Column) -> Column:
    """Upper-case document code, or null when the text is not a single code."""
    packed = F.regexp_replace(col, r"\s+", "")
    return F.when(F.regexp_like(packed, F.lit(REFERENCE_CODE + r"\z")), F.upper(packed))


def reference_key(col: Column) -> Column:
    return F.regexp_replace(F.upper(col), "[^A-Z0-9]", "")


def split_references(col: Column) -> Column:
    """Reference codes and the plain parts between them, in order, nothing lost."""
    marked = F.regexp_replace(col, F.lit(regex("(" + LISTED_CODE + ")")), F.lit("\u0001$1\u0001"))
    return F.filter(F.split(marked, "\u0001"), lambda part: part != "")


def _compatible() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form is one other character, and those forms."""
    pairs = [(c, unicodedata.normalize("NFKC", c)) for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)])]
    single = [(c, f) for c, f in pairs if f != c and len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single)


COMPATIBLE = _compatible()
# Ligatures and the ellipsis, which stand for several characters (fixed values).
SPELT_OUT = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "№": "No", "™": "TM", "½": "1⁄2"}


def compatible(col: Column) -> Column:
    """Full-width letters, ligatures, ring digits and the like in their plain form; combining marks stay apart."""
    out = F.translate(col, *COMPATIBLE)
    for one, several in SPELT_OUT.items():
        out = F.replace(out, F.lit(one), F.lit(several))
    return out


def fold_text(col: Column) -> Column:
    dashes = F.translate(compatible(col), "‒–—", "---")
    return F.lower(squash(dashes))


WORD = r"[a-zà-ɏ][a-zà-ɏ0-9'’]*"


def words(col: Column) -> Column:
    return F.regexp_extract_all(fold_text(col), F.lit(WORD), F.lit(0))


PROTECTED = (
    r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+|(?:R|ZAR|USD|GBP|EUR|\$|€|£)\s*\d[\d\s,.]*%?"
    r"|\b\d[\d,.]*%?|\b[A-Z]{2,}[A-Z0-9+/_-]*\b"
)


def protected_tokens(col: Column) -> Column:
    """Links, addresses, amounts, numbers and capital codes that an edit must keep."""
    return all_matches(col, PROTECTED)


def mask_id(col: Column) -> Column:
    return F.concat(F.substring(col, 1, 6), F.lit("***"), F.right(col, F.lit(4)))


def mask_contact(col: Column, prefix: str = "+27") -> Column:
    digits = F.regexp_replace(F.coalesce(col, F.lit("")), r"\D", "")
    return F.when(
        F.length(digits) >= 4, F.concat(F.lit(prefix + "•" * 5), F.right(digits, F.lit(4)))
    ).otherwise("Not recorded")


def mask_email(col: Column) -> Column:
    local = F.substring_index(col, "@", 1)
    return F.when(col.contains("@"), F.concat(F.substring(local, 1, 2), F.lit("***@***"))).otherwise("***@***")


def mask_phone(col: Column) -> Column:
    digits = F.regexp_replace(col, r"\D", "")
    return F.when(F.length(digits) < 4, F.lit("***")).otherwise(
        F.concat(F.substring(digits, 1, 3), F.lit("***"), F.right(digits, F.lit(2)))
    )


def escape_html(col: Column) -> Column:
    out = col
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def initials(col: Column) -> Column:
    parts = F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), "")


def title_case(col: Column) -> Column:
    """Capital after the start, a space, a dash or a slash; lower case elsewhere."""
    marked = F.regexp_replace(F.lower(col), r"([\s/-])", "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001")
    lifted = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.array_join(lifted, "")


def capital_first(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, F.lit(2), F.length(col)))


def file_slug(col: Column, suffix: str, fallback: str = "Document") -> Column:
    kept = F.regexp_replace(F.regexp_replace(col, r"[^a-zA-Z0-9\s-]", ""), r"\s+", "_")
    stem = F.regexp_replace(F.substring(kept, 1, 50), r"_+$", "")
    return F.concat(F.when(F.trim(col) == "", F.lit(fallback)).otherwise(stem), F.lit("_" + suffix))


BULLET = r"^[-•●▪◦⁃∙*+–—▫➢✓>]\s+"


def tidy_lines(col: Column) -> Column:
    lines = F.filter(F.transform(F.split(col, "\n"), trim_all), lambda line: line != "")
    return F.array_join(lines, "\n")


def tidy_bullets(lines: Column) -> Column:
    """Fragments without bullet, doubled blanks or closing mark; longer than three characters; capital first."""
    bare = F.transform(
        lines, lambda b: F.regexp_replace(squash(F.regexp_replace(b, BULLET, "")), r"[.;,]+$", "")
    )
    return F.transform(F.filter(bare, lambda b: F.length(b) > 3), capital_first)


def clip_text(col: Column, limit: int) -> Column:
    return F.substring(trim_all(F.replace(col, F.lit("\r\n"), F.lit("\n"))), 1, limit)


def yes_no(col: Column) -> Column:
    value = F.lower(F.trim(col))
    return (
        F.when(value.isin("y", "yes", "true"), "Yes")
        .when(value.isin("n", "no", "none", "false"), "No")
        .otherwise(F.trim(col))
    )


# Street words that never appear in a suburb-and-city location (fixed values).
STREET_WORDS = "street|road|avenue|drive|lane|close|crescent|boulevard|way|unit|flat|apartment|erf|plot"


def area_only(col: Column) -> Column:
    parts = F.filter(F.transform(F.split(col, "[,\n]"), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.filter(
        parts,
        lambda p: ~F.regexp_like(p, F.lit(r"^\d")) & ~F.regexp_like(p, F.lit(regex(rf"(?i)\b({STREET_WORDS})\b"))),
    )
    chosen = F.when(F.size(kept) > 0, kept).otherwise(parts)
    last_two = F.slice(chosen, F.greatest(F.size(chosen) - 1, F.lit(1)), F.lit(2))
    return F.array_join(last_two, ", ")
