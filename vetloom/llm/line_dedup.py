"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line that isn't blank goes if an earlier line of the corpus, by document id and line number, equals it, or if both have
``edit_chars`` code points or more and are one edit apart (a code point replaced, put in or taken out). In shorter lines a
single edit makes another word or number, so only equality counts there. Blank lines stay.

1. Equal lines become one row per line, with its first place.
2. For lines of ``edit_chars`` code points or more: one edit leaves either the first or the second half of a line as it was, so a line can only have a partner if another
   line has an equal half (halves by its own length and by one less). The other lines leave here, whatever the data.
3. The rest emit their deletion neighbourhood: a key for every text with one code point taken out, and one for the line
   itself. A key is an exclusive-or of hashes of code points with their places, so the keys of a line come from running
   sums over its code points, and a line of any length costs time in proportion to it.
4. Lines that share a key with the same place deleted differ in that place only; a line that equals a shortened one
   differs by one insertion. Both give the earliest partner by a minimum, never all pairs; the edit distance of the two
   texts then confirms it.
5. The places of the lines that stay are gathered per document, as one byte per line.

A null text has no lines, an empty text one empty line. A null id comes after all others. Rows of one id and one text
have equal places and keep the same lines; rows of one id and different texts are ordered by a hash of the text. An empty
table gives an empty one. Only the id and the text are read, and other columns keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetloom.llm.shared import cut

#: Bits of the filter that is broadcast before candidate texts are fetched (2 MB); more candidates only make it pass more.
FILTER_BITS = 24
ROW = ("none", "id", "version")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every document as ``none, id, version`` (its place in the order) and its lines."""
    return docs.select(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"),
        F.split(F.col(text_col), "\n", -1).alias("lines"),
    )


def _eligible(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def _lines(rows: DataFrame) -> DataFrame:
    exploded = rows.select(*ROW, F.posexplode_outer("lines").alias("at", "line"))
    return exploded.where(_eligible(F.col("line"))).withColumn("h1", F.xxhash64("line"))


def _half_keys(line: Column) -> Column:
    """Keys of the halves of a line, cut as for its own length and as for one less."""
    keys = []
    for size in (F.length(line), F.length(line) - 1):
        half = F.floor(size / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), size, F.substr(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), size, F.substr(line, F.length(line) - size + half + 1)))
    return F.array(*keys)


def _distinct(lines: DataFrame, edit_chars: int) -> DataFrame:
    """One row per different line: hashes, first place, keys of its halves (null for a line too short for edits)."""
    halves = F.when(F.length("line") >= edit_chars, _half_keys(F.col("line")))
    described = lines.select("h1", F.xxhash64(F.lit(2), "line").alias("h2"), F.struct(*ROW, "at", halves.alias("halves")).alias("first"))
    return described.groupBy("h1", "h2").agg(F.min("first").alias("first")).select("h1", "h2", "first.*")


def _candidates(distinct: DataFrame) -> DataFrame:
    """Lines that share a half with another line."""
    halves = distinct.select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    found = halves.join(shared, "half", "left_semi").select("h1").distinct()
    return distinct.drop("halves").join(found, "h1", "left_semi")


def _may_hold(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines whose hash is in a bitmap of the wanted ones: all of those, and few others while the bitmap is thin."""
    number = F.expr(f"h1 & {(1 << FILTER_BITS) - 1}")
    bits = wanted.select(number.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    bitmap = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    asked = lines.withColumn("bucket", F.bitmap_bucket_number(number)).withColumn("bit", F.bitmap_bit_position(number))
    held = asked.join(F.broadcast(bitmap), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int").alias("byte")
    return held.select(*lines.columns, "bit", byte).where("shiftright(byte, cast(bit % 8 as int)) & 1 = 1").drop("bit", "byte")


def _neighbourhoods(texts: DataFrame) -> DataFrame:
    """``key, cut, h1``: a key per text with the code point at ``cut`` taken out; for the line itself ``cut`` is -1."""
    points = F.transform(
        F.sequence(F.lit(0), F.length("line") - 1),
        lambda i: F.struct(
            F.xxhash64(F.substr("wide", 4 * i + 1, F.lit(4)), i).alias("here"),
            F.xxhash64(F.substr("wide", 4 * i + 1, F.lit(4)), i - 1).alias("moved"),
        ),
    )
    spread = texts.select("h1", F.length("line").alias("size"), F.encode("line", "UTF-32").alias("wide"), "line").select("h1", "size", points.alias("points"))

    def total(part: str) -> Column:
        return F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(p[part]))

    whole = spread.select(F.xxhash64("size", total("here")).alias("key"), F.lit(-1).alias("cut"), "h1")
    ordered = Window.partitionBy("h1").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the total in a step of its own: beside the generator it would be taken again for every code point
    summed = spread.select("h1", "size", "points", total("moved").alias("all_moved"))
    each = summed.select("h1", "size", "all_moved", F.posexplode_outer("points").alias("cut", "point"))
    left = F.bit_xor("point.here").over(ordered).bitwiseXOR(F.col("point.here"))
    right = F.bit_xor("point.moved").over(ordered).bitwiseXOR(F.col("all_moved"))
    shorter = each.select(F.xxhash64(F.col("size") - 1, left.bitwiseXOR(right)).alias("key"), "cut", "h1")
    return shorter.union(whole)


def _near(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """``h1, h2`` of the lines that have an earlier line one edit away."""
    key = Window.partitionBy("key")
    emitted = _neighbourhoods(texts).withColumn("low", F.min("h1").over(key)).withColumn("high", F.max("h1").over(key))
    met = emitted.where("low <> high").select("key", "cut", "h1")
    placed = met.join(candidates.select("h1", "h2", F.struct(*ROW, "at", "h1", "h2").alias("place")), "h1")
    same_cut = F.min("place").over(Window.partitionBy("key", "cut"))
    itself = F.min(F.when(F.col("cut") == -1, F.col("place"))).over(key)
    partner = F.when(F.col("cut") == -1, F.min("place").over(key)).otherwise(F.least(same_cut, itself))
    pairs = placed.withColumn("partner", partner).where("partner < place")
    pairs = pairs.select("h1", "h2", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2")).distinct()
    mine, other = texts.select("h1", "h2", "line"), texts.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("earlier"))
    close = pairs.join(mine, ["h1", "h2"]).join(other, ["p1", "p2"]).where(F.levenshtein("line", "earlier", 1) >= 0)
    return close.select("h1", "h2").distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = 20) -> DataFrame:
    """``none, id, version, flags`` of the documents that keep an eligible line: byte ``1`` at the places of those lines."""
    lines = _lines(_rows(docs, id_col, text_col))
    distinct = cut(_distinct(lines, edit_chars))
    candidates = cut(_candidates(distinct))
    fetched = _may_hold(lines.where(F.length("line") >= edit_chars), candidates).select(*ROW, "at", "line")
    texts = cut(_same_place(fetched, candidates).select("h1", "h2", "line"))
    stays = distinct.join(_near(candidates, texts), ["h1", "h2"], "left_anti")
    places = stays.groupBy(*ROW).agg(F.sort_array(F.collect_list("at")).alias("at"))
    gap = F.transform("at", lambda a, i: F.concat(F.repeat(F.lit("0"), F.when(i == 0, a).otherwise(a - F.get("at", i - 1) - 1)), F.lit("1")))
    return places.select(*ROW, F.array_join(gap, "").cast("binary").alias("flags"))


def _same_place(left: DataFrame, right: DataFrame) -> DataFrame:
    on = left["none"] == right["none"]
    on &= left["id"].eqNullSafe(right["id"]) & (left["version"] == right["version"]) & (left["at"] == right["at"])
    return left.select("*").join(right, on)


def _stays(line: Column, at: Column) -> Column:
    return ~_eligible(line) | (F.coalesce(F.substr("flags", at + 1, F.lit(1)), F.lit(b"")) == F.lit(b"1"))


def _with_flags(rows: DataFrame, kept: DataFrame) -> DataFrame:
    right = kept.select(*[F.col(c).alias(f"kept_{c}") for c in ROW], "flags")
    on = (F.col("none") == F.col("kept_none")) & F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version"))
    return rows.join(right, on, "left")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = 20) -> DataFrame:
    """Per document: its lines, how many go, and their numbers from 0 on, comma-joined."""
    rows = _rows(docs, id_col, text_col)
    light = rows.select(*ROW, F.size(F.coalesce("lines", F.array().cast("array<string>"))).alias("n_lines"), F.filter(
        F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x, i: F.when(_eligible(x), i)), lambda i: i.isNotNull()
    ).alias("eligible"))
    judged = _with_flags(light, kept_lines(docs, id_col, text_col, edit_chars))
    gone = F.filter("eligible", lambda i: F.coalesce(F.substr("flags", i + 1, F.lit(1)), F.lit(b"")) != F.lit(b"1"))
    out = judged.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), gone.alias("gone"))
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = 20, size_col: str | None = None) -> DataFrame:
    """``docs`` with every column as it is, but ``text_col`` without the lines that go; ``size_col`` gets the new length."""
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("body"))
    rows = whole.select("row", F.col("key").isNull().alias("none"), F.col("key").alias("id"), F.xxhash64("body").alias("version"), "body")
    judged = _with_flags(rows, kept_lines(docs, id_col, text_col, edit_chars))
    left = F.filter(F.split("body", "\n", -1), lambda x, i: _stays(x, i))
    text = F.when(F.col("body").isNotNull(), F.array_join(left, "\n"))
    made = judged.select("row", text.alias("text"))
    out = {text_col: F.col("text")} | ({size_col: F.length("text").cast(docs.schema[size_col].dataType)} if size_col else {})
    return made.select(*[out.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
