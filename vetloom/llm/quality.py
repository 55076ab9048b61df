"""Quality rules as a short-circuit cascade.

A rule reads some measures of a text and rejects it or not. ``estimate`` times every rule on a bounded sample of texts
and counts its rejections; ``cascade`` then tries the rules in order of rejections per second, and a text that one rule
has rejected is not measured further. The order decides the time only: a text stays if no rule rejects it.

A null text counts as empty; the empty text has no words and is rejected by ``few_words``. Repeated rows are judged
alike. Measures are taken of whole texts, in memory linear in the text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.llm.shared import bounded_batches, id_and_bytes, steps

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: The second and later bytes of a code point.
LATER_BYTES = bytes(range(0x80, 0xC0))
WINDOW = 8
#: Odd factors of the window sums, by place in the window.
FACTORS = np.random.default_rng(8).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Measured:
    """One text; each measure is taken when a rule first asks for it."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes split at exactly the six white-space characters of the word rule

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, SPACES + LATER_BYTES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.uint64)
    if len(numbers) == len(words):
        return 0
    sums = np.zeros(n, dtype=np.uint64)
    for place in range(width):
        sums += ids[place : place + n] * FACTORS[place]
    order = np.argsort(sums, kind="stable")
    ordered = sums[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if all(np.array_equal(ids[a + place], ids[b + place]) for place in range(width)):
        starts = np.zeros(n, dtype=bool)
        starts[a] = starts[b] = True
    else:  # different windows with one sum: count the windows themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(words[i : i + width]), []).append(i)
        starts = np.zeros(n, dtype=bool)
        starts[[i for found in seen.values() if len(found) > 1 for i in found]] = True
    change = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


def few_words(m: Measured) -> bool:
    return m.n_words < 20


def repeats_itself(m: Measured) -> bool:
    return 100 * m.n_repeat_words > 30 * m.n_words


def symbol_heavy(m: Measured) -> bool:
    return 10 * m.n_symbols > 3 * m.n_words


def repeats_lines(m: Measured) -> bool:
    return 2 * m.n_dup_lines > len(m.lines)


def odd_word_lengths(m: Measured) -> bool:
    return not 2 * m.n_words <= m.word_chars <= 20 * m.n_words


#: The rules that the digest calls base, and those that the cascade adds.
BASE_RULES = (Rule("few_words", few_words), Rule("repeats_itself", repeats_itself))
OWN_RULES = (Rule("symbol_heavy", symbol_heavy), Rule("repeats_lines", repeats_lines), Rule("odd_word_lengths", odd_word_lengths))
RULES = BASE_RULES + OWN_RULES


def estimate(docs: DataFrame, text_col: str, rules: Sequence[Rule], sample_rows: int = 500) -> list[Rule]:
    """The rules by rejections per second, from ``sample_rows`` texts; measured in a task, so no text reaches the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = list(rules)
    texts_only = docs.select(F.lit(0).alias("none"), F.col(text_col).alias("text"))
    sample = id_and_bytes(texts_only, "none", "text").where(F.rand(5) < 0.2).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = [0.0] * len(chosen), [0] * len(chosen)
        for _, texts in steps(batches):
            for data in texts:
                for i, rule in enumerate(chosen):
                    fresh = Measured(data)
                    start = time.perf_counter()
                    rejected[i] += rule.rejects(fresh)
                    spent[i] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict(
            {"rule": pa.array(range(len(chosen)), pa.int32()), "spent": pa.array(spent, pa.float64()), "rejected": pa.array(rejected, pa.int64())}
        )

    measured = sample.mapInArrow(run, "rule int, spent double, rejected long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"))
    rate = {r["rule"]: (-r["rejected"] / max(r["spent"], 1e-9), r["spent"]) for r in measured.collect()}
    return [chosen[i] for i in sorted(range(len(chosen)), key=lambda i: (*rate.get(i, (0.0, 0.0)), i))]


def passes(m: Measured, rules: Sequence[Rule]) -> bool:
    """False at the first rule that rejects; the rest are not asked."""
    return not any(rule.rejects(m) for rule in rules)


def keep(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 500) -> DataFrame:
    """The rows of ``docs``, every column as it is, whose text no rule rejects."""
    ordered = estimate(docs, text_col, rules, sample_rows)

    @F.pandas_udf("boolean")
    def stays(data):
        return data.map(lambda d: passes(Measured(bytes(d)), ordered))

    return docs.where(stays(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: Sequence[Rule] = OWN_RULES, sample_rows: int = 500) -> DataFrame:
    """The digest of every document: the base counts, whether a base rule rejects it, and the cascade's verdict."""
    ordered = estimate(docs, text_col, own, sample_rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {n: [] for n in names}
            failed, kept = [], []
            for data in batch.column(1):
                m = Measured(data.as_py())
                for n in names:
                    found[n].append(getattr(m, n))
                failed.append(not passes(m, BASE_RULES))
                kept.append(not failed[-1] and passes(m, ordered))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[n], pa.int64()) for n in names), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=["doc_id", *names, "base_failed", "kept"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean")
