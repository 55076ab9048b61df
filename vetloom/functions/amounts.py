"""Amounts as people type them, cell values and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetloom.functions.text import let, number_text

# Whole numbers accepted as words (fixed values).
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
]
CURRENCY = "(?:zar|rands?|r)"


def _is(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(pattern + r"\z"))


def parse_amount(col: Column) -> Column:
    """Double for an amount in any accepted spelling, else null. Expects NFKC text."""
    return let(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), _amount_or_word)


def _amount_or_word(text: Column) -> Column:
    word = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), F.regexp_replace(text, r"[.!]$", ""))
    return F.when(word > 0, (word - 1).cast("double")).otherwise(_signed_amount(text))


def _signed_amount(text: Column) -> Column:
    bracketed = _is(text, r"^\(.*\)")
    inner = F.when(bracketed, F.trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    marks = rf"^((?:(?:-\s*)?(?:{CURRENCY}\s*)?){{0,3}})"

    def without_marks(parts: Column) -> Column:
        """Currency marks and minus signs off both ends; a second sign is refused."""
        text, head = parts["text"], parts["head"]
        body = F.trim(F.substring(text, F.length(head) + 1, F.length(text)))
        tail = F.regexp_replace(F.regexp_replace(body, rf"(?:\s*{CURRENCY}){{0,3}}$", ""), r"\s+$", "")
        closed = F.regexp_replace(tail, r"[.,]-$", "")
        signs = F.length(F.regexp_replace(head, "[^-]", "")) + closed.endswith("-").cast("int") + parts["signs"]
        digits = F.regexp_replace(F.regexp_replace(closed, r"-$", ""), r"[\s'‘’ʼ`]", "")
        return F.struct(F.regexp_replace(digits, r"[.,]$", "").alias("digits"), signs.alias("signs"))

    opened = let(
        F.translate(inner, "−‒–—", "----"),
        lambda t: F.struct(t.alias("text"), F.regexp_extract(t, marks, 1).alias("head"), bracketed.cast("int").alias("signs")),
    )
    value = let(let(opened, without_marks), lambda p: F.struct(_grouped_number(p["digits"]).alias("v"), p["signs"].alias("signs")))
    return let(value, lambda p: F.when(p["signs"] == 0, p["v"]).when(p["signs"] == 1, -p["v"]))


def _grouped_number(s: Column) -> Column:
    """Digits with thousands and decimal marks: the last mark decides when both kinds occur."""
    plain = (
        F.when(_is(s, r"^\d+"), s)
        .when(_is(s, r"^\d{1,3}(,\d{3})+\.\d+"), F.replace(s, F.lit(","), F.lit("")))
        .when(
            _is(s, r"^\d{1,3}(\.\d{3})+,\d+"),
            F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
        )
        .when(_is(s, r"^\d{1,3}((\.\d{3})+|(,\d{3})+)"), F.regexp_replace(s, "[.,]", ""))
        .when(
            _is(s, r"^(\d+[.,]\d*|[.,]\d+)"),
            F.concat(F.lit("0"), F.replace(s, F.lit(","), F.lit(".")), F.lit("0")),
        )
    )
    return plain.try_cast("double")


def parse_loose_number(col: Column) -> Column:
    text = F.trim(col)
    return F.when(
        _is(text, r"^-?(\d+(\.\d+)?|\d{1,3}(,\d{3})+(\.\d+)?)"), F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    )


def numeric_cell(col: Column) -> Column:
    """Stored cell text to ``struct<kind, num, txt, err>``."""
    text = F.coalesce(col, F.lit(""))
    cleaned = F.trim(F.replace(text, F.lit(","), F.lit("")))
    number = F.when(_is(cleaned, r"^-?\d+(\.\d+)?"), cleaned.try_cast("double"))
    truth = F.upper(text)
    kind = (
        F.when(text == "", "blank")
        .when(text.startswith("#"), "error")
        .when(number.isNotNull(), "number")
        .when(truth.isin("TRUE", "FALSE"), "boolean")
        .otherwise("text")
    )
    num = F.when(kind == "number", number).when(kind == "boolean", (truth == "TRUE").cast("double"))
    return F.struct(
        kind.alias("kind"),
        num.alias("num"),
        F.when(kind == "text", text).alias("txt"),
        F.when(kind == "error", F.substring_index(text, " ", 1)).alias("err"),
    )


def cell_text(cell: Column) -> Column:
    return (
        F.when(cell["kind"] == "blank", "")
        .when(cell["kind"] == "number", number_text(cell["num"]))
        .when(cell["kind"] == "boolean", F.when(cell["num"] == 1, "TRUE").otherwise("FALSE"))
        .otherwise(cell["txt"])
    )


def cell_number(cell: Column) -> Column:
    """Number a cell counts as: blank 0, TRUE 1, numeric text its value, other text null (``#VALUE!``)."""
    return F.when(cell["kind"] == "blank", F.lit(0.0)).otherwise(cell["num"])


def cell_error(*cells: Column) -> Column:
    """First error among the cells, if any."""
    return F.coalesce(*[c["err"] for c in cells], F.lit(None).cast("string"))


def cell_equal(a: Column, b: Column) -> Column:
    textual = (a["kind"] == "text") | (b["kind"] == "text")
    logical = (a["kind"] == "boolean") | (b["kind"] == "boolean")
    return (
        F.when((a["kind"] == "blank") & (b["kind"] == "blank"), True)
        .when(textual, F.upper(cell_text(a)) == F.upper(cell_text(b)))
        .when(logical, (a["kind"] == b["kind"]) & (a["num"] == b["num"]))
        .otherwise(cell_number(a) == cell_number(b))
    )


def cell_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; text order when either side is text, else numeric order."""
    textual = (a["kind"] == "text") | (b["kind"] == "text")
    x, y = F.upper(cell_text(a)), F.upper(cell_text(b))
    p, q = cell_number(a), cell_number(b)
    as_text = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(textual, as_text).otherwise(F.when(p < q, -1).when(p > q, 1).otherwise(0))


MAX_JOINED_TEXT = 2000


def cell_arith(op: str, a: Column, b: Column | None = None) -> Column:
    """``struct<num, txt, err>`` of one spreadsheet operation (``+ - * / & abs neg``)."""
    b = a if b is None else b
    err = cell_error(a, b)
    x, y = cell_number(a), cell_number(b)
    if op == "&":
        joined = F.concat(cell_text(a), cell_text(b))
        err = F.when(err.isNotNull(), err).when(F.length(joined) > MAX_JOINED_TEXT, F.lit("#VALUE!"))
        num, txt = F.lit(None).cast("double"), F.when(err.isNull(), joined)
    else:
        err = F.coalesce(err, F.when(x.isNull() | y.isNull(), F.lit("#VALUE!")))
        if op == "/":
            err = F.coalesce(err, F.when(y == 0, F.lit("#DIV/0!")))
        raw = {
            "+": x + y,
            "-": x - y,
            "*": x * y,
            "/": F.try_divide(x, y),
            "abs": F.abs(x),
            "neg": -x,
        }[op]
        num, txt = F.when(err.isNull(), raw), F.lit(None).cast("string")
    return F.struct(num.alias("num"), txt.alias("txt"), err.alias("err"))


def if_value(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    """Chosen cell text for IF: blank is false, numbers are true unless 0, text is ``#VALUE!``."""
    other = F.lit("FALSE") if otherwise is None else otherwise
    truth = F.coalesce(cell_number(condition), F.lit(0.0)) != 0
    return (
        F.when(condition["kind"] == "error", condition["err"])
        .when(condition["kind"] == "text", F.lit("#VALUE!"))
        .when(truth, then)
        .otherwise(other)
    )


def if_error(value: Column, fallback: Column) -> Column:
    return F.when(value.startswith("#"), fallback).otherwise(value)


def half_up(col: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(col + F.lit(0.5))


def round_digits(col: Column, digits: Column) -> Column:
    factor = F.pow(F.lit(10.0), F.least(F.greatest(digits, F.lit(0)), F.lit(10)).cast("double"))
    return half_up(col * factor) / factor


def within_tolerance(a: Column, b: Column, tolerance: Column) -> Column:
    return F.abs(a - b) <= tolerance + F.lit(1e-9)


def percent_1dp(earned: Column, maximum: Column) -> Column:
    return F.when(maximum != 0, half_up(earned / maximum * 1000) / 10).otherwise(F.lit(0.0))


def percent_2dp_clamped(col: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(col * 100) / 100)), F.lit(0.0))


def percent_int(value: Column, maximum: Column) -> Column:
    raw = F.when(maximum > 0, F.greatest(F.lit(0), F.least(F.lit(100), half_up(value / maximum * 100))))
    return F.coalesce(raw, F.lit(0)).cast("bigint")


def feedback_band(percent: Column) -> Column:
    return F.when(percent >= 75, "strong").when(percent >= 50, "reasonable").otherwise("practice")


def format_amount(text: Column) -> Column:
    """Two decimals with comma groups and a typographic minus; non-numbers unchanged."""
    number = F.trim(text).try_cast("double")
    shown = F.format_number(F.abs(number), 2)
    return F.when(number.isNull(), text).when(number < 0, F.concat(F.lit("−"), shown)).otherwise(shown)
