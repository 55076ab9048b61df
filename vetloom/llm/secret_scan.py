"""Secret scans: fixed forms, and credential values whose cheapest guess is expensive.

Three forms are found anywhere: assignments to password-like names, access ids and long hex strings. A value that stands
in a credential's place (behind a wider list of names and any blanks, quoted or not, with or without the name of an
authorization scheme, behind such a name alone, or as the password of a URL, with or without a user) is judged by dynamic
programming over its code points: the cheapest way to cut it into dictionary words, dates, repeats, keyboard walks and
brute-force spans gives the bits of guessing it takes. From ``bits`` on the value is a span of kind ``guess``, unless it
lies inside a span of a fixed form.

A null or empty text has no spans, an empty table no rows; repeated rows get equal results, and a null id stays null. Only
the id and the text are read, so columns of any other name do no harm. Whole texts are scanned, in time linear in the text
but for the sorting of its spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import date
from itertools import accumulate
from math import comb, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.llm.bpe import load_ranks
from vetloom.llm.shared import LOWER, bounded_batches, id_and_bytes

KINDS = ("assign", "access", "hex", "guess")


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WIDER = "|".join(
    [NAMES, *map(_any_case, ("passphrase", "passcode", "pwd", "credential", "authorization", "bearer"))]
    + [_any_case(a) + "[ _-]?" + _any_case("key") for a in ("access", "private", "client", "api")]
)
SCHEMES = "|".join(map(_any_case, ("bearer", "basic", "token")))
NAMED = rf"(?:(?:{SCHEMES})[ \t]+)?"
SIGN = r"\s?[ \t]*(?::=|=>|[:=])\s?[ \t]*"
VALUE = re.compile(rf"""(?:{WIDER})["']?{SIGN}(?:"{NAMED}([^"\n]+)"|'{NAMED}([^'\n]+)'|{NAMED}([^\s"'<>,;]+))""")
SCHEME_VALUE = re.compile(rf"\b(?:{SCHEMES})[ \t]+([A-Za-z0-9+/_.~=-]+)")
URL_PASSWORD = re.compile(r"://[^\s/:@]*:([^\s/@]+)@")

#: A text without any of these has no span of that sort; bytes in lower case.
HINTS = (b"passw", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"credential", b"authorization", b"bearer", b"basic", b"key", b"akia")
#: Hex digits as ``h``, every other byte as a space.
HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
LONG_HEX = b"h" * LEAST["hex"]

#: The passwords that leak most often, in that order, and the keys of a keyboard by rows.
COMMON = (
    "123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey "
    "letmein shadow master 666666 qwertyuiop 123321 mustang 1234567890 michael 654321 superman 1qaz2wsx 7777777 121212 "
    "000000 qazwsx 123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster soccer harley batman andrew tigger "
    "sunshine iloveyou 2000 charlie robert thomas hockey ranger daniel starwars klaster 112233 george computer michelle "
    "jessica pepper 1111 zxcvbn 555555 11111111 131313 freedom 777777 pass maggie 159753 aaaaaa ginger princess joshua "
    "cheese amanda summer love ashley nicole chelsea matthew access yankees 987654321 dallas austin thunder taylor matrix "
    "admin root user guest test example changeme default secret token welcome login your here placeholder sample dummy"
).split()
KEY_ROWS = ("`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LEET = str.maketrans("4@30157$!8", "aaeoistsib")


def _neighbours() -> dict[str, set[str]]:
    place = {c: (x + y / 2, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row) if c != " "}
    return {a: {b for b, (u, v) in place.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1} for a, (x, y) in place.items()}


NEAR_KEYS = _neighbours()
LONGEST_WORD = 24
LONGEST_UNIT = 8


def _char_bits(c: str) -> float:
    if c.isascii():
        return log2(10) if c.isdigit() else log2(26) if c.isalpha() else log2(33)
    return log2(100)


def ranked_words(path: str) -> dict[str, int]:
    """Guess rank per word: common passwords, then the words of a public vocabulary file in the order of its ranks."""
    words = list(COMMON)
    for token, _ in sorted(load_ranks(path).items(), key=lambda item: item[1]):
        text = token.decode("utf-8", "ignore").strip().lower()
        if 3 <= len(text) <= LONGEST_WORD and text.isalpha():
            words.append(text)
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}


def _word_bits(text: str, ranks: dict[str, int]) -> float | None:
    lower = text.lower()
    plain = lower.translate(LEET)
    rank = min((r for r in (ranks.get(lower), ranks.get(plain)) if r), default=None)
    if rank is None:
        return None
    upper = sum(c.isupper() for c in text)
    case = 0 if not upper else 1 if upper == len(text) or upper == 1 and text[0].isupper() else log2(sum(comb(len(text), k) for k in range(1, upper + 1)))
    return log2(rank + 1) + case + sum(a != b for a, b in zip(lower, plain))


YEAR = re.compile(r"(?:19|20)[0-9]{2}")
#: Dates with the year first or last, of four or of two digits; the separator is the same in both places, or there is none.
DATES = tuple(
    (re.compile(form.replace("Y", f"([0-9]{{{digits}}})")), bits)
    for digits, bits in ((4, log2(365 * 200)), (2, log2(365 * 100)))
    for form in (r"Y([-/._]?)([0-9]{1,2})\2([0-9]{1,2})", r"([0-9]{1,2})([-/._]?)([0-9]{1,2})\2Y")
)


def _is_date(day: str, month: str, year: str) -> bool:
    if len(year) not in (2, 4):
        return False
    try:  # the year 2000 was a leap year, so a two-digit year of either century is covered
        return 1900 <= date(int(year) + (2000 if len(year) == 2 else 0), int(month), int(day)).year < 2100
    except ValueError:
        return False


def _date_ends(text: str, at: int) -> list[tuple[int, float]]:
    """Ends of dates that start at ``at``, with their bits."""
    ends = []
    if (m := YEAR.match(text, at)) is not None:
        ends.append((m.end(), log2(200)))
    for form, bits in DATES:
        if (m := form.match(text, at)) is not None:
            a, b, c = m[1], m[3], m[4]
            if any(_is_date(*x) for x in ((c, b, a), (b, c, a), (a, b, c), (b, a, c))):
                ends.append((m.end(), bits + (2 if m[2] else 0)))
    return ends


WALK_BITS = log2(47) + log2(6)


class _Repeats:
    """Cheapest covers that end with a unit of ``size`` code points written twice or more.

    Starts of one residue inside one periodic stretch write the same unit, so they compete by the cost of what lies before
    them and by the logarithm of the times. Another repetition adds less to the longer of two repeats, so a start that an
    earlier one has beaten stays beaten and leaves.
    """

    def __init__(self, size: int):
        self.size, self.run = size, 0
        self.starts: list[list[tuple[int, float]]] = [[] for _ in range(size)]

    def cheapest(self, text: str, end: int, best: list[float], ranks: dict[str, int]) -> float:
        size = self.size
        if end <= size or text[end - 1] != text[end - 1 - size]:
            if self.run:
                self.run = 0
                self.starts = [[] for _ in range(size)]
            return float("inf")
        self.run += 1
        if self.run < size:
            return float("inf")
        start = end - 2 * size
        part = text[start : start + size]
        unit = min(sum(map(_char_bits, part)), _word_bits(part, ranks) or float("inf"))
        waiting = self.starts[end % size]
        waiting.append((start, best[start] + (1 if start else 0) + unit))
        cheapest, left = float("inf"), []
        for start, cost in waiting:
            times = (end - start) // size
            if cost + log2(times) < cheapest:
                left.append((start, cost))
                if times * size >= 3:
                    cheapest = cost + log2(times)
        self.starts[end % size] = left
        return cheapest


def guess_bits(text: str, ranks: dict[str, int]) -> float:
    """Bits of the cheapest segmentation of ``text``; each further segment costs one bit.

    Words, dates, every part of a keyboard walk of three keys or more, every part of a repeat and brute-force spans may be
    segments; words have at most ``LONGEST_WORD`` code points and repeated units ``LONGEST_UNIT``.
    """
    n = len(text)
    keys = text.lower().translate(SHIFTED)
    never = float("inf")
    best = [never] * (n + 1)  # cheapest cover that ends here
    best[0] = 0.0
    brute = never  # cheapest cover that ends here with a brute-force span
    two = three = never  # the same with a walk of two keys, and of three or more
    repeats = [_Repeats(size) for size in range(1, LONGEST_UNIT + 1)]
    for i in range(n):
        here = best[i] + (1 if i else 0)
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            if (bits := _word_bits(text[i:j], ranks)) is not None:
                best[j] = min(best[j], here + bits)
        if text[i].isdigit():
            for j, bits in _date_ends(text, i):
                best[j] = min(best[j], here + bits)
        end = i + 1
        brute = min(brute, here) + _char_bits(text[i])
        if i and keys[i] in NEAR_KEYS.get(keys[i - 1], ()):
            turn = 2 * (i >= 2 and keys[i - 2] == keys[i])
            two, three = best[i - 1] + (1 if i > 1 else 0) + WALK_BITS, min(two, three) + 1 + turn
        else:
            two = three = never
        best[end] = min(best[end], brute, three, *(r.cheapest(text, end, best, ranks) for r in repeats))
    return best[n]


def spans(text: str, ranks: dict[str, int], bits: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the fixed forms, and all spans, by start and then kind; code points, end exclusive."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, form in (("access", ACCESS), ("hex", HEX)):
        base += [(kind, *m.span()) for m in form.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base.sort(key=order)
    starts = [s for _, s, _ in base]
    furthest = list(accumulate((e for _, _, e in base), max))  # a span that starts no later reaches this far
    more = set()
    for form in (VALUE, SCHEME_VALUE, URL_PASSWORD):
        for m in form.finditer(text):
            a, b = m.span(m.lastindex)
            before = bisect_right(starts, a)
            if (not before or furthest[before - 1] < b) and ("guess", a, b) not in more and guess_bits(text[a:b], ranks) >= bits:
                more.add(("guess", a, b))
    return base, sorted([*base, *more], key=order)


def _may_have_spans(data: bytes) -> bool:
    if LONG_HEX in data.translate(HEX_BYTES):
        return True
    lower = data.translate(LOWER)
    return any(hint in lower for hint in HINTS) or b"://" in data and b"@" in data


def scan(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", bits: float = 35.0) -> DataFrame:
    """Per document: spans of each kind, the digest of those of fixed forms, and all of them as text."""
    bounded_batches(docs.sparkSession)
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    ranks = docs.sparkSession.sparkContext.broadcast(ranked_words(vocabulary_path))  # as large as the vocabulary file at most
    write = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, texts = [], []
            for data in batch.column(1):
                data = data.as_py()
                base, found = spans(data.decode("utf-8", "replace"), ranks.value, bits) if _may_have_spans(data) else ([], [])
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in found))
                digests.append(hashlib.sha256(write(base).encode()).hexdigest())
                texts.append(write(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
