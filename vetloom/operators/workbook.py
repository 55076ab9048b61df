"""Spreadsheet operators over long cell tables ``(workbook_id, sheet, row_no, col, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetloom.functions import amounts as A
from vetloom.functions.text import trim_all
from vetloom.plans import scans
from vetloom.plans.spread import looked_up

COLUMNS = list("ABCDEFGHIJ")
LAST_ROW = 40
MAX_CELL_TEXT = 200
MAX_RANGE_CELLS = 400
#: Names or first errors, a few dozen bytes each, that are broadcast rather than shuffled with the rows they meet.
BROADCAST_ROWS = 200_000
#: Cells and keys of one type in one workbook that are scanned in one task.
WHOLE_ROWS = 100_000
# One cell reference: optional sheet, optional dollar marks, column A to J, row 1 to 40.
CELL = r"(?:([A-Za-z][A-Za-z0-9_]{0,15})!)?\$?([A-Ja-j])\$?(40|[1-3][0-9]|[1-9])"


def column_number(col: Column) -> Column:
    return F.ascii(F.upper(col)) - 64


def split_cell_ref(ref: Column) -> Column:
    """``struct<sheet, col, row>`` of a reference such as ``Data!b3``."""
    pattern = rf"^{CELL}$"
    return F.struct(
        F.regexp_extract(ref, pattern, 1).alias("sheet"),
        F.upper(F.regexp_extract(ref, pattern, 2)).alias("col"),
        F.regexp_extract(ref, pattern, 3).try_cast("int").alias("row"),
    )


def canonical_cell_ref(ref: Column) -> Column:
    """Sheet in lower case, cell in upper case, dollar marks dropped."""
    parts = split_cell_ref(ref)
    sheet = F.when(parts["sheet"] == "", "").otherwise(F.concat(F.lower(parts["sheet"]), F.lit("!")))
    return F.concat(sheet, parts["col"], parts["row"].cast("string"))


def column_letters(number: Column) -> Column:
    """``A`` to ``Z``, then ``AA`` to ``ZZ``."""
    first, second = ((number - 1) / 26).cast("int"), (number - 1) % 26
    return F.concat(F.when(first > 0, F.char(first + 64)).otherwise(""), F.char(second + 65))


def cells_to_lines(cells: DataFrame) -> DataFrame:
    """Tab-joined line per sheet row (blank cells and empty rows dropped) under a banner line 0 per sheet."""
    filled = cells.filter(F.trim("text") != "")
    cols = F.array_sort(F.collect_list(F.struct("col", "text")))
    lines = filled.groupBy("workbook_id", "sheet", "row_no").agg(
        F.array_join(F.transform(cols, lambda c: c["text"]), "\t").alias("line")
    )
    banner = lines.select("workbook_id", "sheet").distinct().select(
        "workbook_id", "sheet", F.lit(0).alias("row_no"), F.concat(F.lit("--- Sheet: "), "sheet", F.lit(" ---")).alias("line")
    )
    return banner.unionByName(lines.withColumn("row_no", F.col("row_no").cast("int")))


def block_to_cells(df: DataFrame, id_column: str, anchor: Column, text: Column) -> DataFrame:
    """A pasted block to cells from its anchor on; ``fits`` tells whether a cell lies on the grid and its text is short enough."""
    block = F.regexp_replace(F.regexp_replace(text, "\r", ""), r"\n\z", "")
    at = split_cell_ref(anchor)
    placed = df.select(id_column, at.alias("at"), block.alias("block"))
    rows = placed.select(id_column, "at", F.posexplode(F.split("block", "\n")).alias("r", "line"))
    cells = rows.select(id_column, "at", "r", F.posexplode(F.split("line", "\t")).alias("c", "item"))
    row_no, col_no = F.col("at.row") + F.col("r"), column_number(F.col("at.col")) + F.col("c")
    fits = (row_no <= LAST_ROW) & (col_no <= len(COLUMNS)) & (F.length("item") <= MAX_CELL_TEXT)
    return cells.select(id_column, row_no.alias("row_no"), column_letters(col_no).alias("col"), F.col("item").alias("text"), fits.alias("fits"))


def layout_two_sided(left: DataFrame, right: DataFrame, scenario: str, key: str, amount: str, rows: int | None = None) -> DataFrame:
    """Statement into A/B and ledger into D/E under a header row; every line, or the first ``rows`` a side."""

    def side(df: DataFrame, key_col: str, amount_col: str, key_head: str, amount_head: str) -> DataFrame:
        ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(scenario).orderBy(key, amount)))
        ranked = ranked if rows is None else ranked.filter(F.col("rn") <= rows)
        cells = F.array(
            F.struct(F.lit(key_col).alias("col"), F.col(key).cast("string").alias("text")),
            F.struct(F.lit(amount_col).alias("col"), F.col(amount).cast("decimal(18,2)").cast("string").alias("text")),
        )
        heads = F.array(
            F.struct(F.lit(key_col).alias("col"), F.lit(key_head).alias("text")),
            F.struct(F.lit(amount_col).alias("col"), F.lit(amount_head).alias("text")),
        )
        body = ranked.select(scenario, (F.col("rn") + 1).alias("row_no"), F.inline(cells))
        top = df.select(scenario).distinct().select(scenario, F.lit(1).alias("row_no"), F.inline(heads))
        return top.unionByName(body)

    return side(left, "A", "B", "Statement reference", "Statement amount").unionByName(
        side(right, "D", "E", "Ledger reference", "Ledger amount")
    )


def range_cells(cells: DataFrame, sheet: str, first: str, last: str) -> DataFrame:
    """Cells inside a rectangular range; at most 400 per workbook by the limits of the grid."""
    c1, r1, c2, r2 = first[0], int(first[1:]), last[0], int(last[1:])
    if (abs(r2 - r1) + 1) * (abs(ord(c2) - ord(c1)) + 1) > MAX_RANGE_CELLS:
        raise ValueError("#REF! the range is too large")
    return cells.filter(
        (F.lower("sheet") == sheet.lower())
        & F.col("row_no").between(min(r1, r2), max(r1, r2))
        & F.col("col").between(min(c1, c2), max(c1, c2))
    )


def range_to_table(cells: DataFrame, sheet: str, first: str, last: str) -> DataFrame:
    """Rows of a range with one column per letter; first row marked as header, blank body rows dropped."""
    letters = [c for c in COLUMNS if first[0] <= c <= last[0]]
    inside = range_cells(cells, sheet, first, last)
    wide = inside.groupBy("workbook_id", "row_no").agg(
        *[F.coalesce(F.max(F.when(F.col("col") == c, F.col("text"))), F.lit("")).alias(c) for c in letters]
    )
    header = F.col("row_no") == int(first[1:])
    filled = F.trim(F.concat(*letters)) != ""
    return wide.filter(header | filled).withColumn("is_header", header)


def range_stats(cells: DataFrame, sheet: str, first: str, last: str) -> DataFrame:
    """SUM, MIN and MAX over the numbers of a range; the first error cell wins over all three."""
    typed = range_cells(cells, sheet, first, last).withColumn("v", A.numeric_cell(F.col("text")))
    number = F.when(F.col("v.kind") == "number", F.col("v.num"))
    found = typed.groupBy("workbook_id").agg(
        F.coalesce(F.sum(number), F.lit(0.0)).alias("total"),
        F.coalesce(F.min(number), F.lit(0.0)).alias("low"),
        F.coalesce(F.max(number), F.lit(0.0)).alias("high"),
        F.min(F.when(F.col("v.kind") == "error", F.struct("row_no", "col", F.col("v.err").alias("err"))))["err"].alias("err"),
    )
    fine = F.col("err").isNull()
    return found.select("workbook_id", *[F.when(fine, F.col(c)).alias(c) for c in ("total", "low", "high")], "err")


def criteria_holds(text: Column, criteria: str) -> Column:
    """Whether a shown cell text meets a criteria string such as ``>=10``, ``<>x`` or ``note``."""
    wanted = criteria.strip()
    op = next((o for o in ("<>", "<=", ">=", "<", ">", "=") if wanted.startswith(o)), "")
    operand = wanted[len(op):].strip()
    op = op or "="
    shown = F.trim(text)
    try:
        target = float(operand.replace(",", ""))
    except ValueError:
        same = F.upper(shown) == operand.upper()
        return ~same if op == "<>" else same
    number = F.replace(shown, F.lit(","), F.lit("")).try_cast("double")
    tests = {
        "=": number == target, "<": number < target, ">": number > target,
        "<=": number <= target, ">=": number >= target,
    }
    if op == "<>":
        return number.isNull() | (number != target)
    return F.coalesce(tests[op], F.lit(False))


def _criteria_rows(cells: DataFrame, sheet: str, tested: str, summed: str, rows: tuple[int, int]) -> DataFrame:
    """Tested and summed cell of every row, typed."""
    inside = cells.filter((F.lower("sheet") == sheet.lower()) & F.col("row_no").between(*rows) & F.col("col").isin(tested, summed))
    pair = inside.groupBy("workbook_id", "row_no").agg(
        F.max(F.when(F.col("col") == tested, F.col("text"))).alias("t"),
        F.max(F.when(F.col("col") == summed, F.col("text"))).alias("s"),
    )
    return pair.withColumn("tv", A.numeric_cell(F.col("t"))).withColumn("sv", A.numeric_cell(F.col("s")))


def sum_if(cells: DataFrame, sheet: str, tested: str, summed: str, rows: tuple[int, int], criteria: str) -> DataFrame:
    """SUMIF over two aligned columns; an error in the tested range, or in a summed cell that counts, wins."""
    typed = _criteria_rows(cells, sheet, tested, summed, rows)
    holds = criteria_holds(A.cell_text(F.col("tv")), criteria) & (F.col("tv.kind") != "error")
    error = F.coalesce(F.col("tv.err"), F.when(holds, F.col("sv.err")))
    found = typed.groupBy("workbook_id").agg(
        F.coalesce(F.sum(F.when(holds & (F.col("sv.kind") == "number"), F.col("sv.num"))), F.lit(0.0)).alias("total"),
        F.min(F.when(error.isNotNull(), F.struct("row_no", error.alias("err"))))["err"].alias("err"),
    )
    return found.select("workbook_id", F.when(F.col("err").isNull(), F.col("total")).alias("total"), "err")


def count_if_criteria(cells: DataFrame, sheet: str, tested: str, rows: tuple[int, int], criteria: str) -> DataFrame:
    typed = _criteria_rows(cells, sheet, tested, tested, rows)
    holds = criteria_holds(A.cell_text(F.col("tv")), criteria) & (F.col("tv.kind") != "error")
    found = typed.groupBy("workbook_id").agg(
        F.count_if(holds).alias("n"),
        F.min(F.when(F.col("tv.err").isNotNull(), F.struct("row_no", F.col("tv.err").alias("err"))))["err"].alias("err"),
    )
    return found.select("workbook_id", F.when(F.col("err").isNull(), F.col("n")).alias("n"), "err")


def range_rows(cells: DataFrame, sheet: str, first_col: str, value_col: str) -> DataFrame:
    """``(workbook_id, row_no, k, v)``: the rows of each workbook's two-column table."""
    inside = cells.filter((F.lower("sheet") == sheet.lower()) & F.col("col").isin(first_col, value_col) & F.col("workbook_id").isNotNull())
    return inside.groupBy("workbook_id", "row_no").agg(
        F.max(F.when(F.col("col") == first_col, F.col("text"))).alias("k"),
        F.max(F.when(F.col("col") == value_col, F.col("text"))).alias("v"),
    )


def _hit(table: DataFrame) -> DataFrame:
    """Rows of a table with their typed key ``__cell`` and what a search returns of them."""
    return table.select("workbook_id", F.struct("row_no", "k", "v").alias("__hit"), A.numeric_cell(F.col("k")).alias("__cell"))


def _with_errors(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` with ``__error``, the first error of its workbook's rows; few are broadcast."""
    errors = scans.stored(rows.where(F.col("__cell.kind") == "error").groupBy("workbook_id").agg(F.min("__hit").alias("__error")))
    if errors.count() > BROADCAST_ROWS:
        return looked_up(scans.stored(found), errors, ["workbook_id"])
    named = errors.withColumnRenamed("workbook_id", "__of")
    return found.join(F.broadcast(named), found["workbook_id"].eqNullSafe(named["__of"]), "left").drop("__of")


def _equal_form(cell: Column) -> Column:
    """Two cells are equal if their forms are: text in upper case, numbers as shown (a blank counts as 0), TRUE or FALSE; errors have none."""
    number = A.number_text(F.coalesce(cell["num"], F.lit(0.0)) + F.lit(0.0))
    return F.when(cell["kind"].isin("number", "blank"), number).when(cell["kind"] != "error", F.upper(A.cell_text(cell)))


def _shown(hit: Column, value: Column) -> Column:
    """The value of a hit, the error the search ran into, or ``#N/A``."""
    error = F.coalesce(hit["k"], F.lit("")).startswith("#")
    return F.when(hit.isNull(), "#N/A").when(error, hit["k"]).otherwise(F.coalesce(value, F.lit("")))


def _first_exact(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``__hit``: the first row that equals the key, or the first error before it.

    First rows per form and first errors are partial aggregates; the keys meet one row each. The table is read once.
    """
    rows = scans.stored(_hit(table))
    filled = rows.where(~F.col("__cell.kind").isin("blank", "error")).select("workbook_id", "__hit", _equal_form(F.col("__cell")).alias("__form"))
    first = filled.groupBy("workbook_id", "__form").agg(F.min("__hit").alias("__first"))
    asked = keys.withColumn("__form", _equal_form(A.numeric_cell(F.col(key))))
    found = _with_errors(looked_up(scans.stored(asked), first, ["workbook_id", "__form"]), rows)
    return found.withColumn("__hit", F.least("__first", "__error")).drop("__form", "__first", "__error")


def _last_not_above(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``__hit``: the last row in table order that doesn't exceed the key; an error anywhere in the column comes first.

    An as-of join: cells and keys are sorted together by workbook, type and value, and a key takes the greatest row number
    so far. Neither a large workbook nor a value is gathered. The table is read once.
    """
    rows = scans.stored(_hit(table))
    typed = ["workbook_id", "__kind", "__num", "__text"]

    def placed(df: DataFrame, cell: Column, asks: bool, hit: Column, row: Column) -> DataFrame:
        text = F.when(cell["kind"] == "text", F.upper(cell["txt"]))
        return df.select(
            "workbook_id", cell["kind"].alias("__kind"), (cell["num"] + F.lit(0.0)).alias("__num"), text.alias("__text"), F.lit(asks).alias("__asks"),
            F.xxhash64(row if asks else hit).alias("__tie"), hit.alias("__hit"), row.alias("__row"),
        )

    row = F.struct(*[F.col(c) for c in keys.columns])
    kind, whole = rows.schema["__hit"].dataType, keys.select(row.alias("r")).schema["r"].dataType
    cells = placed(rows.where(~F.col("__cell.kind").isin("blank", "error")), F.col("__cell"), False, F.col("__hit"), F.lit(None).cast(whole))
    asked = placed(keys, A.numeric_cell(F.col(key)), True, F.lit(None).cast(kind), row)
    scanned = scans.prefix_max(cells.unionByName(asked), typed[:2], [*typed[2:], "__asks", "__tie"], "__hit", "__last", WHOLE_ROWS)
    found = scanned.where("__asks").select("__row.*", "__last")
    return _with_errors(found, rows).withColumn("__hit", F.coalesce("__error", "__last")).drop("__last", "__error")


def _lookup(found: DataFrame, col_no: int) -> DataFrame:
    shown = _shown(F.col("__hit"), F.col("__hit")["k" if col_no == 1 else "v"]) if 1 <= col_no <= 2 else F.lit("#REF!")
    return found.withColumn("found", shown).drop("__hit")


def lookup_exact(keys: DataFrame, table: DataFrame, key: str, col_no: int = 2) -> DataFrame:
    """Value beside the first row whose first column equals the key; ``table`` as of ``range_rows``."""
    return _lookup(_first_exact(keys, table, key), col_no)


def lookup_approx(keys: DataFrame, table: DataFrame, key: str, col_no: int = 2) -> DataFrame:
    """Value beside the last row, in table order, whose first column has the key's type and does not exceed it."""
    return _lookup(_last_not_above(keys, table, key), col_no)


def match_position(keys: DataFrame, table: DataFrame, key: str, kind: int = 1) -> DataFrame:
    """1-based position of the first equal entry (kind 0) or the last entry not above the key (kind 1)."""
    if kind not in (0, 1):
        return keys.withColumn("found", F.lit("#VALUE!"))
    found = (_last_not_above if kind else _first_exact)(keys, table, key)
    return found.withColumn("found", _shown(F.col("__hit"), F.col("__hit")["row_no"].cast("string"))).drop("__hit")


def index_cell(cells: DataFrame, wanted: DataFrame, sheet: str, first: str, last: str) -> DataFrame:
    """Cell at a 1-based row and column of a range; outside it ``#REF!``, an empty place is blank."""
    c1, r1, c2, r2 = ord(first[0]) - 64, int(first[1:]), ord(last[0]) - 64, int(last[1:])
    placed = range_cells(cells, sheet, first, last).select(
        "workbook_id",
        (F.col("row_no") - r1 + 1).alias("r"),
        (column_number(F.col("col")) - c1 + 1).alias("c"),
        "text",
    )
    joined = wanted.join(placed, ["workbook_id", "r", "c"], "left")
    inside = F.col("r").between(1, r2 - r1 + 1) & F.col("c").between(1, c2 - c1 + 1)
    return joined.withColumn("found", F.when(inside, F.coalesce("text", F.lit(""))).otherwise("#REF!")).drop("text")


def cell_reference_edges(cells: DataFrame) -> DataFrame:
    """``(workbook_id, from_ref, to_ref)`` for every reference in a formula; ranges are expanded.

    A formula is cut into whole names first, with the bracket of a call: ``A41``, ``RATE1`` and ``LOG10(`` hold no reference.
    The references of a cell to a sheet are a set of rows per column, one bit a row; so a cell meets its repeats as one row,
    and references are expanded after that, each once.
    """
    formulas = cells.filter(F.substring(F.trim("text"), 1, 1) == "=")
    body = F.regexp_replace(F.trim("text"), '"[^"]*"', " ")
    name = r"[A-Za-z0-9_.$!]+\(?"
    tokens = formulas.select(
        "workbook_id",
        "sheet",
        F.concat(F.lower("sheet"), F.lit("!"), F.upper("col"), F.col("row_no").cast("string")).alias("from_ref"),
        F.explode(F.regexp_extract_all(body, F.lit(rf"{name}(?:\s*:\s*{name})?"), F.lit(0))).alias("token"),
    )
    plain = tokens.withColumn("token", F.translate("token", " \t\n\x0b\f\r", ""))
    ends = [F.substring_index("token", ":", 1), F.when(F.contains("token", F.lit(":")), F.substring_index("token", ":", -1))]
    a, b = (F.when(F.regexp_like(e, F.lit(rf"^{CELL}\z")), e) for e in ends)
    # a range of two references, or the one that is a reference
    pairs = plain.select("workbook_id", "sheet", "from_ref", F.coalesce(a, b).alias("a"), F.coalesce(b, a).alias("b")).where("a is not null")

    def place(ref: str) -> tuple[Column, Column]:
        cell = F.translate(F.substring_index(ref, "!", -1), "$", "")
        return column_number(cell), F.substring(cell, 2, 2).cast("int")

    (c1, r1), (c2, r2) = place("a"), place("b")
    span = pairs.select(
        "workbook_id",
        "from_ref",
        F.lower(F.when(F.contains("a", F.lit("!")), F.substring_index("a", "!", 1)).otherwise(F.col("sheet"))).alias("to_sheet"),
        F.least(c1, c2).alias("c1"),
        F.greatest(c1, c2).alias("c2"),
        F.least(r1, r2).alias("r1"),
        F.greatest(r1, r2).alias("r2"),
    )
    rows = F.expr("shiftleft(shiftleft(1L, r2 - r1 + 1) - 1L, r1)")
    rows = F.when(F.col("to_sheet").isNull(), F.lit(2).cast("long")).otherwise(rows)  # no name: one reference, to nothing
    marked = span.select("workbook_id", "from_ref", "to_sheet", rows.alias("rows"), *[F.when(F.col("to_sheet").isNull(), i == 1).otherwise(F.lit(i).between(F.col("c1"), F.col("c2"))).alias(c) for i, c in enumerate(COLUMNS, 1)])
    sets = marked.groupBy("workbook_id", "from_ref", "to_sheet").agg(*[F.bit_or(F.when(F.col(c), F.col("rows")).otherwise(F.lit(0).cast("long"))).alias(c) for c in COLUMNS])
    columns = sets.select("workbook_id", "from_ref", "to_sheet", F.inline(F.array(*[F.struct(F.lit(c).alias("letter"), F.col(c).alias("rows")) for c in COLUMNS])))
    lowest, highest = F.expr("bit_count((rows & -rows) - 1)"), F.length(F.bin("rows")) - 1
    filled = columns.where("rows <> 0").select("*", F.explode(F.sequence(lowest, highest)).alias("r")).where("shiftright(rows, r) & 1 = 1")
    return filled.select("workbook_id", "from_ref", F.concat("to_sheet", F.lit("!"), "letter", F.col("r").cast("string")).alias("to_ref"))


def _shared_names(edges: DataFrame) -> DataFrame | None:
    """``name``: the cells that hold and get references, of whatever workbook; None if too many to be broadcast."""
    names = edges.select(F.col("to_ref").alias("name")).distinct().join(edges.select(F.col("from_ref").alias("name")).distinct(), "name", "left_semi")
    names = scans.stored(names)
    return names if names.count() <= BROADCAST_ROWS else None


def cell_cycles(edges: DataFrame, peels: int = 8) -> DataFrame:
    """Cells that reach themselves, over cycles of any length.

    Cells without a reference in or out of the rest can lie on no cycle. Most go by name alone: where no workbook has both a
    formula in a cell and a reference to it, a broadcast of the names drops the edge without a shuffle. The others are peeled off,
    for ``peels`` rounds or until nothing changes. What is left is closed by doubling path lengths until no new pair
    appears. Edges and every round are stored as compressed tables, whose few bytes on disk say little of their rows: the
    rounds are joined by merging, so that no table of them is sent to the driver to be broadcast.
    """
    left = scans.stored(edges.select("workbook_id", "from_ref", "to_ref").dropna())
    names = _shared_names(left)
    if names is not None:
        for end in ("to_ref", "from_ref"):
            left = left.join(F.broadcast(names.withColumnRenamed("name", end)), end, "left_semi")
    left = scans.stored(left.select("workbook_id", "from_ref", "to_ref").distinct())
    size = left.count()
    for _ in range(peels):
        sources = left.select("workbook_id", F.col("from_ref").alias("to_ref")).distinct()
        targets = left.select("workbook_id", F.col("to_ref").alias("from_ref")).distinct()
        fed = left.join(sources.hint("merge"), ["workbook_id", "to_ref"], "left_semi")
        rest = scans.stored(fed.join(targets.hint("merge"), ["workbook_id", "from_ref"], "left_semi"))
        before, size, left = size, rest.count(), rest
        if size == before:
            break
    reach = left.select("workbook_id", "from_ref", "to_ref")
    while size:
        first = reach.select("workbook_id", "from_ref", F.col("to_ref").alias("via"))
        second = reach.select("workbook_id", F.col("from_ref").alias("via"), "to_ref")
        step = first.join(second.hint("merge"), ["workbook_id", "via"]).select("workbook_id", "from_ref", "to_ref")
        reach = scans.stored(reach.unionByName(step).distinct())
        before, size = size, reach.count()
        if size == before:
            break
    return reach.filter(F.col("from_ref") == F.col("to_ref")).select("workbook_id", F.col("from_ref").alias("cell"))
