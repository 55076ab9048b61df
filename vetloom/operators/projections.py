"""Projections, layers and append or upsert rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import text as X
from vetloom.plans import scans

def readable_text(df: DataFrame, column: str) -> DataFrame:
    """Keep text of at least 20 characters of which more than 35 % are letters."""
    letters = F.length(F.regexp_replace(F.col(column), "[^A-Za-z]", ""))
    sized = F.length(X.trim_all(F.col(column))) >= 20
    return df.filter(sized & (letters / F.length(F.col(column)) > 0.35))


def clean_text(col: Column) -> Column:
    """Unix line ends, plain spaces, no zero-width marks, no trailing blanks, at most one blank line."""
    out = F.regexp_replace(col, "\r\n?", "\n")
    out = F.regexp_replace(F.translate(out, X.NO_BREAK_SPACE, " "), X.ZERO_WIDTH, "")
    out = F.regexp_replace(out, "[ \t]+\n", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return X.trim_all(F.regexp_replace(out, "[ \t]+\n", "\n"))


def normalise_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, clean_text(F.col(column)))


# Named entities and the characters they stand for (fixed values); the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
NUMERIC_ENTITY = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def decode_entities(col: Column) -> Column:
    """Five named entities and decimal or hexadecimal code points."""

    def one(text: Column, entity: Column) -> Column:
        digits = F.regexp_replace(entity, "[&#;]", "")
        is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
        code = F.when(is_hex, F.conv(F.regexp_replace(digits, "[xX]", ""), 16, 10)).otherwise(digits)
        point = code.cast("bigint")
        ok = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, point).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.replace(text, entity, char)

    out = col
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    numeric = F.array_distinct(F.regexp_extract_all(out, F.lit(NUMERIC_ENTITY), F.lit(0)))
    out = F.aggregate(numeric, out, one)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def markup_to_text(
    df: DataFrame,
    column: str,
    para_tags: Sequence[str] = ("p", "div", "h1", "h2", "h3", "h4", "tr", "ul", "ol", "title"),
    break_tags: Sequence[str] = ("br",),
    list_tags: Sequence[str] = ("li",),
    tab_tags: Sequence[str] = ("td", "th"),
    dropped: Sequence[str] = ("script", "style"),
) -> DataFrame:
    """Paragraph markup to lines: breaks and tabs mapped, list items get a bullet, entities decoded."""
    text = F.col(column)
    for tag in dropped:
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    text = F.regexp_replace(text, rf"(?i)<(?:{'|'.join(list_tags)})(?:\s[^>]*)?>", "\n• ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join([*para_tags, *break_tags])})(?:\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, rf"(?i)</(?:{'|'.join(tab_tags)})>", "\t")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return df.withColumn(column, clean_text(decode_entities(text)))


def overlay_cells(source: DataFrame, user: DataFrame) -> DataFrame:
    """Candidate cells over source cells; a blank candidate cell still wins."""
    keys = ["workbook_id", "sheet", "row_no", "col"]
    left = source.select(*keys, F.col("text").alias("source_text"))
    right = user.select(*keys, F.col("text").alias("user_text"), F.lit(True).alias("touched"))
    return left.join(right, keys, "full_outer").select(
        *keys,
        F.when(F.col("touched"), F.col("user_text")).otherwise(F.col("source_text")).alias("text"),
        F.coalesce("touched", F.lit(False)).alias("touched"),
    )


def explode_answers(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """One row per answer of a JSON answer map; unreadable JSON is an empty map."""
    answers = F.coalesce(F.from_json(json_column, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    return df.select(id_column, F.explode(answers).alias("item_id", "value"))


def public_projection(df: DataFrame, id_column: str, sections: str) -> DataFrame:
    """Only listed fields of nested content survive; keys and weights cannot be reached from the output."""

    def public_item(item: Column) -> Column:
        return F.struct(
            item["id"].alias("id"),
            item["type"].alias("type"),
            item["prompt"].alias("prompt"),
            F.transform(item["options"], lambda o: F.struct(o["id"].alias("id"), o["text"].alias("text"))).alias("options"),
        )

    shown = F.transform(
        F.col(sections),
        lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"), F.transform(s["items"], public_item).alias("items")),
    )
    return df.select(id_column, shown.alias(sections))


def rewrite_display_text(df: DataFrame, term: str, replacement: str, display: Sequence[str]) -> DataFrame:
    """Replace a withheld term in display columns; every other column is evidence and stays as it is."""
    return df.withColumns({c: F.regexp_replace(F.col(c), rf"(?i)\Q{term}\E", replacement) for c in display})


def needs_term_review(df: DataFrame, term: str, replacement: str, display: Sequence[str]) -> DataFrame:
    """Rows that still hold the withheld term after the display columns were rewritten."""
    shown = rewrite_display_text(df, term, replacement, display)
    return shown.filter(F.lower(F.to_json(F.struct("*"))).contains(term.lower()))


def append_first_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows plus the first incoming row of every key that is not there yet."""
    first = scans.latest_row(incoming, keys, [F.col(o) for o in order])
    fresh = first.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(fresh)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key over both inputs."""
    return scans.latest_row(existing.unionByName(incoming), keys, [F.col(o).desc() for o in order])


def masked_screening(df: DataFrame) -> DataFrame:
    """Screening answers without contact number or identity number."""
    masked = F.col("id_masked")
    return df.select(
        "candidate_id",
        X.mask_contact(F.col("phone")).alias("contact_masked"),
        F.when(F.regexp_like(masked, F.lit(r"^\d{6}\*{3}\d{4}\z")), masked).otherwise("Not recorded").alias("id_masked"),
        F.col("start_at").cast("date").cast("string").alias("start_date"),
        F.coalesce("day_confirmed", F.lit(False)).alias("day_confirmed"),
        "travel_mode",
        F.coalesce("travel_note", F.lit("")).alias("travel_note"),
        "own_transport",
        F.col("available").alias("assignment_available"),
    )
