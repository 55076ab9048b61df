"""Scalar functions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetloom.catalog.registry import query
from vetloom.catalog.sqltext import MONTH_LIST, amount_ctes, cell_ctes, number_text, tenure_case
from vetloom.functions import amounts as A
from vetloom.functions import dates as D
from vetloom.functions import identity as I
from vetloom.functions import text as X
from vetloom.sources.views import NOW_ORDERS

HASH_KEY = b"sample key for checks only 32 by"


@query("parse_amount", f"with {amount_ctes('amounts_v', 'amount_text')} select l_orderkey, l_linenumber, amount_text, amount from am")
def _(t):
    return t.amounts_v.select("l_orderkey", "l_linenumber", "amount_text", A.parse_amount(F.col("amount_text")).alias("amount"))


@query(
    "parse_loose_number",
    r"""select l_orderkey, l_linenumber, case when regexp_matches(trim(amount_text), '^-?(\d+(\.\d+)?|\d{1,3}(,\d{3})+(\.\d+)?)$')
    then try_cast(replace(trim(amount_text), ',', '') as double) end as amount from amounts_v""",
)
def _(t):
    return t.amounts_v.select("l_orderkey", "l_linenumber", A.parse_loose_number(F.col("amount_text")).alias("amount"))


@query(
    "numeric_cell",
    f"""with {cell_ctes('cells_v', 'text', 'c', 'c_')} select workbook_id, row_no, col, c_kind as kind, c_num as num,
    case when c_kind = 'text' then text end as txt, case when c_kind = 'error' then split_part(text, ' ', 1) end as err from c""",
)
def _(t):
    cell = t.cells_v.withColumn("v", A.numeric_cell(F.col("text")))
    return cell.select("workbook_id", "row_no", "col", "v.kind", "v.num", "v.txt", "v.err")


def cell_pairs(t):
    """Two cells of one row side by side; each cell is read once, before the pairs are made."""
    names = [(a, b) for a in "ABC" for b in "BCD" if a <= b]
    read = t.wide_v.select("workbook_id", "row_no", *[A.numeric_cell(F.col(c)).alias(c) for c in "abcd"])
    sides = [F.struct(F.lit(a).alias("lc"), F.lit(b).alias("rc"), F.col(a.lower()).alias("a"), F.col(b.lower()).alias("b")) for a, b in names]
    return read.select("workbook_id", "row_no", F.inline(F.array(*sides)))


PAIR_SQL = f"""
    pairs as (select workbook_id, row_no, unnest(['A', 'A', 'A', 'B', 'B', 'B', 'C', 'C']) as lc, unnest([a, a, a, b, b, b, c, c]) as lt,
      unnest(['B', 'C', 'D', 'B', 'C', 'D', 'C', 'D']) as rc, unnest([b, c, d, b, c, d, c, d]) as rt from wide_v),
    {cell_ctes('pairs', 'lt', 'pa', 'a_')}, {cell_ctes('pa', 'rt', 'pb', 'b_')}"""
PAIR_COLS = ["workbook_id", "row_no", "lc", "rc"]


@query(
    "cell_equal",
    f"""with {PAIR_SQL} select workbook_id, row_no, lc, rc, case when a_kind = 'blank' and b_kind = 'blank' then true
    when a_kind = 'text' or b_kind = 'text' then upper(a_txt) = upper(b_txt)
    when a_kind = 'boolean' or b_kind = 'boolean' then a_kind = b_kind and a_num = b_num
    else coalesce(a_num, 0) = coalesce(b_num, 0) end as same from pb where b_kind <> 'error'""",
)
def _(t):
    return cell_pairs(t).filter("b.kind <> 'error'").select(*PAIR_COLS, A.cell_equal(F.col("a"), F.col("b")).alias("same"))


@query(
    "cell_compare",
    f"""with {PAIR_SQL} select workbook_id, row_no, lc, rc, case when a_kind = 'text' or b_kind = 'text'
    then case when upper(a_txt) < upper(b_txt) then -1 when upper(a_txt) > upper(b_txt) then 1 else 0 end
    when coalesce(a_num, 0) < coalesce(b_num, 0) then -1 when coalesce(a_num, 0) > coalesce(b_num, 0) then 1 else 0 end as ord
    from pb where b_kind <> 'error'""",
)
def _(t):
    return cell_pairs(t).filter("b.kind <> 'error'").select(*PAIR_COLS, A.cell_compare(F.col("a"), F.col("b")).alias("ord"))


_X, _Y = (
    "case a_kind when 'blank' then 0.0 else a_num end",
    "case b_kind when 'blank' then 0.0 else b_num end",
)
_ERR = f"case when b_kind = 'error' then rt when {_X} is null or {_Y} is null then '#VALUE!' end"


@query(
    "cell_arith",
    f"""with {PAIR_SQL}, e as (select *, {_ERR} as err, {_X} as x, {_Y} as y from pb)
    select workbook_id, row_no, lc, rc, case when err is null then x + y end as plus, case when err is null then x - y end as minus,
      case when err is null then x * y end as times, round(case when err is null and y <> 0 then x / y end, 6) as ratio,
      coalesce(err, case when y = 0 then '#DIV/0!' end) as ratio_err, err as plus_err,
      case when err is null then abs(x) end as size, case when err is null then 0 - y end as neg,
      case when b_kind = 'error' then null else a_txt || b_txt end as joined from e""",
)
def _(t):
    a, b = F.col("a"), F.col("b")
    ratio, plus = A.cell_arith("/", a, b), A.cell_arith("+", a, b)
    return cell_pairs(t).select(
        *PAIR_COLS,
        plus["num"].alias("plus"),
        A.cell_arith("-", a, b)["num"].alias("minus"),
        A.cell_arith("*", a, b)["num"].alias("times"),
        F.round(ratio["num"], 6).alias("ratio"),
        ratio["err"].alias("ratio_err"),
        plus["err"].alias("plus_err"),
        F.when(plus["err"].isNull(), A.cell_arith("abs", a)["num"]).alias("size"),
        F.when(plus["err"].isNull(), F.lit(0.0) + A.cell_arith("neg", b)["num"]).alias("neg"),
        A.cell_arith("&", a, b)["txt"].alias("joined"),
    )


@query(
    "if_value",
    f"""with {cell_ctes("(select * from cells_v where col = 'D')", 'text', 'c', 'c_')} select workbook_id, row_no,
    case when c_kind = 'error' then text when c_kind = 'text' then '#VALUE!' when coalesce(c_num, 0) <> 0 then 'yes' else 'FALSE' end
    as picked from c""",
)
def _(t):
    cells = t.cells_v.filter("col = 'D'").withColumn("v", A.numeric_cell(F.col("text")))
    return cells.select("workbook_id", "row_no", A.if_value(F.col("v"), F.lit("yes")).alias("picked"))


@query(
    "if_error",
    "select workbook_id, row_no, case when text like '#%' then 'none' else text end as shown from cells_v where col = 'D'",
)
def _(t):
    return t.cells_v.filter("col = 'D'").select("workbook_id", "row_no", A.if_error(F.col("text"), F.lit("none")).alias("shown"))


@query(
    "round_digits",
    """select l_orderkey, l_linenumber, l_linenumber - 2 as digits, floor(-l_extendedprice / 7 * pow(10.0, greatest(l_linenumber - 2, 0)) + 0.5)
    / pow(10.0, greatest(l_linenumber - 2, 0)) as rounded from line_v""",
)
def _(t):
    digits = F.col("l_linenumber") - 2
    return t.line_v.select(
        "l_orderkey", "l_linenumber", digits.alias("digits"), A.round_digits(-F.col("l_extendedprice") / 7, digits).alias("rounded")
    )


@query(
    "within_tolerance",
    "select l_orderkey, l_linenumber, abs(l_quantity - 25) <= l_linenumber + 1e-9 as near from line_v",
)
def _(t):
    near = A.within_tolerance(F.col("l_quantity"), F.lit(25.0), F.col("l_linenumber"))
    return t.line_v.select("l_orderkey", "l_linenumber", near.alias("near"))


@query(
    "percent_1dp",
    """select l_orderkey, l_linenumber, case when l_linenumber <> 7 then floor(l_quantity / ((7 - l_linenumber) * 9.0) * 1000 + 0.5) / 10
    else 0 end as percent from line_v""",
)
def _(t):
    percent = A.percent_1dp(F.col("l_quantity"), (7 - F.col("l_linenumber")) * F.lit(9.0))
    return t.line_v.select("l_orderkey", "l_linenumber", percent.alias("percent"))


@query(
    "percent_2dp_clamped",
    """select l_orderkey, l_linenumber, coalesce(greatest(0, least(100, floor((l_extendedprice / 700 - 10) * 100 + 0.5) / 100)), 0) as percent
    from line_v""",
)
def _(t):
    percent = A.percent_2dp_clamped(F.col("l_extendedprice") / 700 - 10)
    return t.line_v.select("l_orderkey", "l_linenumber", percent.alias("percent"))


@query(
    "percent_int",
    """select l_orderkey, l_linenumber, cast(case when l_linenumber < 7 then greatest(0, least(100,
    floor(l_quantity / ((7 - l_linenumber) * 20.0) * 100 + 0.5))) else 0 end as bigint) as percent from line_v""",
)
def _(t):
    percent = A.percent_int(F.col("l_quantity"), (7 - F.col("l_linenumber")) * F.lit(20.0))
    return t.line_v.select("l_orderkey", "l_linenumber", percent.alias("percent"))


@query(
    "feedback_band",
    """select l_orderkey, l_linenumber, case when l_quantity * 2 >= 75 then 'strong' when l_quantity * 2 >= 50 then 'reasonable'
    else 'practice' end as band from line_v""",
)
def _(t):
    return t.line_v.select("l_orderkey", "l_linenumber", A.feedback_band(F.col("l_quantity") * 2).alias("band"))


@query(
    "duration_seconds",
    """select attempt_id, cast(least(1000000, greatest(0, round((epoch_us(closed_at) - epoch_us(started_at)) / 1e6))) as bigint) as seconds
    from attempts_v where closed_at is not null""",
)
def _(t):
    seconds = D.duration_seconds(F.col("started_at"), F.col("closed_at"), 1_000_000)
    return t.attempts_v.filter("closed_at is not null").select("attempt_id", seconds.alias("seconds"))


@query(
    "seconds_remaining",
    f"""select attempt_id, cast(greatest(0, ceil((epoch_ms(expires_at) - epoch_ms(timestamp '{NOW_ORDERS}')) / 1000.0)) as bigint) as seconds
    from attempts_v""",
)
def _(t):
    return t.attempts_v.select("attempt_id", D.seconds_remaining(F.col("expires_at"), F.lit(NOW_ORDERS).cast("timestamp")).alias("seconds"))


@query(
    "expiry_for_start",
    """select attempt_id, case when attempt_id % 9000 between 60 and 7200 then epoch_ms(started_at) + attempt_id % 9000 * 1000 end
    as expires_ms from attempts_v""",
)
def _(t):
    expires = D.expiry_for_start(F.unix_millis("started_at"), F.col("attempt_id") % 9000)
    return t.attempts_v.select("attempt_id", expires.alias("expires_ms"))


@query(
    "normalise_key_text",
    r"""select p_partkey, upper(trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || chr(10), '\s+', ' ', 'g'))) as folded from part""",
)
def _(t):
    raw = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit("\n"))
    return t.part.select("p_partkey", X.normalise_key_text(raw).alias("folded"))


@query(
    "canonical_answer",
    f"""select p_partkey, 'number:' || {number_text('p_retailprice')} as price_key, 'text:' || lower(p_name) as name_key from part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        X.canonical_answer(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" "))).alias("price_key"),
        X.canonical_answer(F.concat(F.upper("p_name"), F.lit("  "))).alias("name_key"),
    )


@query(
    "parse_reference",
    r"""select l_orderkey, l_linenumber, code, case when regexp_matches(replace(code, ' ', ''), '^[A-Za-z]{2,6}-?\d{1,6}[A-Za-z]?$')
      then upper(replace(code, ' ', '')) end as parsed, regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') as code_key
    from (select attempt_id as l_orderkey, item_id as l_linenumber, case when item_id = 6 then code || 'xy' else code end as code from answers_v) x""",
)
def _(t):
    code = F.when(F.col("item_id") == 6, F.concat("code", F.lit("xy"))).otherwise(F.col("code"))
    src = t.answers_v.select(F.col("attempt_id").alias("l_orderkey"), F.col("item_id").alias("l_linenumber"), code.alias("code"))
    return src.select("*", X.parse_reference(F.col("code")).alias("parsed"), X.reference_key(F.col("code")).alias("code_key"))


@query("reference_key", "select s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') as code_key from supplier")
def _(t):
    return t.supplier.select("s_suppkey", X.reference_key(F.col("s_name")).alias("code_key"))


@query(
    "split_references",
    r"""select doc_id, array_to_string(regexp_extract_all(text, '\b[A-Z]{2,}-\d+\b'), '|') as codes,
      array_to_string(list_filter(string_split(regexp_replace(text, '(\b[A-Z]{2,}-\d+\b)', chr(1) || '\1' || chr(1), 'g'), chr(1)),
        lambda p: p <> ''), '|') as parts from briefs_v""",
)
def _(t):
    return t.briefs_v.select(
        "doc_id",
        F.array_join(X.all_matches(F.col("text"), X.LISTED_CODE), "|").alias("codes"),
        F.array_join(X.split_references(F.col("text")), "|").alias("parts"),
    )


@query(
    "fold_text",
    r"select conv_id, turn, lower(trim(regexp_replace(translate(text, '‒–—', '---'), '\s+', ' ', 'g'))) as folded from conversations",
)
def _(t):
    return t.conversations.select("conv_id", "turn", X.fold_text(F.col("text")).alias("folded"))


@query(
    "words",
    r"""select conv_id, turn, array_to_string(regexp_extract_all(lower(trim(regexp_replace(translate(text, '‒–—', '---'), '\s+', ' ', 'g'))),
    '[a-zà-ɏ][a-zà-ɏ0-9''’]*'), ' ') as words from conversations""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(X.words(F.col("text")), " ").alias("words"))


@query(
    "protected_tokens",
    r"""select doc_id, array_to_string(regexp_extract_all(text,
    'https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+|(?:R|ZAR|USD|GBP|EUR|\$|€|£)\s*\d[\d\s,.]*%?|\b\d[\d,.]*%?|\b[A-Z]{2,}[A-Z0-9+/_-]*\b'),
    '|') as tokens from briefs_v""",
)
def _(t):
    return t.briefs_v.select("doc_id", F.array_join(X.protected_tokens(F.col("text")), "|").alias("tokens"))


@query(
    "normalise_identity",
    r"""select candidate_id, trim(first_name) as first, trim(regexp_replace(surname, '\s+', ' ', 'g')) as last, lower(trim(email)) as email,
      case when not (length(trim(first_name)) between 2 and 100 and length(trim(surname)) between 2 and 100
        and regexp_matches(lower(trim(email)), '^[^\s@]+@[^\s@]+\.[^\s@]+$') and length(trim(email)) <= 254) then 'invalid'
      when not consent then 'no consent' else 'ok' end as verdict from customer_v""",
)
def _(t):
    who = I.normalise_identity(F.col("first_name"), F.col("surname"), F.col("email"), F.col("consent"))
    return t.customer_v.select("candidate_id", who.alias("w")).select("candidate_id", "w.*")


@query(
    "mask_id",
    "select candidate_id, substr(id_number, 1, 6) || '***' || right(id_number, 4) as masked from customer_v",
)
def _(t):
    return t.customer_v.select("candidate_id", X.mask_id(F.col("id_number")).alias("masked"))


@query(
    "mask_contact",
    r"""select candidate_id, case when length(regexp_replace(phone, '\D', '', 'g')) >= 4
    then '+27•••••' || right(regexp_replace(phone, '\D', '', 'g'), 4) else 'Not recorded' end as masked from customer_v""",
)
def _(t):
    return t.customer_v.select("candidate_id", X.mask_contact(F.col("phone")).alias("masked"))


@query(
    "mask_email",
    """select candidate_id, case when email like '%@%' then substr(split_part(email, '@', 1), 1, 2) || '***@***' else '***@***' end as masked
    from (select candidate_id, trim(email) as email from customer_v) x""",
)
def _(t):
    return t.customer_v.select("candidate_id", X.mask_email(F.trim("email")).alias("masked"))


@query(
    "mask_phone",
    r"""select candidate_id, case when length(d) < 4 then '***' else substr(d, 1, 3) || '***' || right(d, 2) end as masked
    from (select candidate_id, regexp_replace(phone, '\D', '', 'g') as d from customer_v) x""",
)
def _(t):
    return t.customer_v.select("candidate_id", X.mask_phone(F.col("phone")).alias("masked"))


@query("sha256_token", "select c_custkey, sha256(c_name) as token from customer")
def _(t):
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("token"))


_INNER, _OUTER = I.hmac_pads(HASH_KEY)


@query(
    "identity_hash",
    f"""select candidate_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('assessment-id-v1:'
      || cast(candidate_id % 5 as varchar) || ':' || id_number)))) as id_hash from customer_v""",
)
def _(t):
    return t.customer_v.select(
        "candidate_id", I.identity_hash(F.col("candidate_id") % 5, F.col("id_number"), HASH_KEY).alias("id_hash")
    )


@query("encrypt_identity", "select candidate_id, 'v1.' as form, id_number as opened from customer_v")
def _(t):
    sealed = t.customer_v.select("candidate_id", I.encrypt_identity(F.col("id_number"), HASH_KEY).alias("sealed"))
    return sealed.select(
        "candidate_id", F.substring("sealed", 1, 3).alias("form"), I.decrypt_identity(F.col("sealed"), HASH_KEY).alias("opened")
    )


@query(
    "canonical_cell_ref",
    r"""select workbook_id, row_no, col, lower(sheet) || '!' || upper(col) || cast(row_no as varchar) as canon, 'Data' as sheet_part,
      upper(col) as col_part, row_no as row_part from cells_v""",
)
def _(t):
    from vetloom.operators.workbook import canonical_cell_ref, split_cell_ref

    raw = F.concat(F.lit("Data!"), F.lower("col"), F.col("row_no").cast("string"))
    parts = split_cell_ref(raw)
    return t.cells_v.select(
        "workbook_id", "row_no", "col", canonical_cell_ref(raw).alias("canon"), parts["sheet"].alias("sheet_part"),
        parts["col"].alias("col_part"), parts["row"].alias("row_part"),
    )


@query(
    "format_amount",
    """select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'n/a' when l_quantity < 25 then
      '−' || format('{:,.2f}', l_extendedprice) else format('{:,.2f}', l_extendedprice) end as shown from line_v""",
)
def _(t):
    raw = (
        F.when(F.col("l_linenumber") == 1, "n/a")
        .when(F.col("l_quantity") < 25, F.concat(F.lit("-"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
        .otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    )
    return t.line_v.select("l_orderkey", "l_linenumber", A.format_amount(raw).alias("shown"))


@query("format_date", "select o_orderkey, strftime(o_orderdate, '%-d %b %Y') as shown from orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "d MMM yyyy").alias("shown"))


@query(
    "escape_html",
    """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')
    as safe from pages""",
)
def _(t):
    return t.pages.select("page_id", X.escape_html(F.col("html")).alias("safe"))


@query(
    "initials",
    r"""select p_partkey, array_to_string(list_transform(regexp_split_to_array(p_name, '\s+'), lambda w: upper(substr(w, 1, 1)) || '.'), '')
    as initials from part""",
)
def _(t):
    return t.part.select("p_partkey", X.initials(F.col("p_name")).alias("initials"))


@query(
    "title_case",
    r"""select p_partkey, array_to_string(list_transform(regexp_split_to_array(regexp_replace(lower(p_name || '-' || p_type), '([\s/-])',
      chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') as titled from part""",
)
def _(t):
    return t.part.select("p_partkey", X.title_case(F.concat_ws("-", "p_name", "p_type")).alias("titled"))


@query(
    "file_slug",
    r"""select p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(p_name || ' ' || p_brand || '!', '[^a-zA-Z0-9\s-]', '', 'g'),
    '\s+', '_', 'g'), 1, 50), '_+$', '') || '_Spec' as slug from part""",
)
def _(t):
    return t.part.select("p_partkey", X.file_slug(F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("!")), "Spec").alias("slug"))


@query(
    "tidy_lines",
    r"""select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')),
    lambda l: l <> ''), chr(10)) as tidy from documents""",
)
def _(t):
    return t.documents.select("doc_id", X.tidy_lines(F.col("text")).alias("tidy"))


@query(
    "tidy_bullets",
    r"""select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(trim(
    regexp_replace(regexp_replace(l, '^[-•●▪◦⁃∙*+–—▫➢✓>]\s+', ''), '\s+', ' ', 'g')), '[.;,]+$', '')), lambda l: length(l) > 3),
    lambda l: upper(substr(l, 1, 1)) || substr(l, 2)), chr(10)) as tidy from cvs_v""",
)
def _(t):
    return t.cvs_v.select("doc_id", F.array_join(X.tidy_bullets(F.split("text", "\n")), "\n").alias("tidy"))


@query(
    "clip_text",
    r"""select conv_id, turn, substr(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g'), 1, 200) as clipped
    from conversations""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", X.clip_text(F.col("text"), 200).alias("clipped"))


@query(
    "valid_id_number",
    r"""with d as (select candidate_id, id_number, '19' || substr(id_number, 1, 2) || '-' || substr(id_number, 3, 2) || '-' || substr(id_number, 5, 2)
      as this_c, '18' || substr(id_number, 1, 2) || '-' || substr(id_number, 3, 2) || '-' || substr(id_number, 5, 2) as last_c,
      list_sum(list_transform(range(1, 14), lambda i: case when i % 2 = 1 then cast(substr(id_number, i, 1) as int)
        when cast(substr(id_number, i, 1) as int) > 4 then cast(substr(id_number, i, 1) as int) * 2 - 9
        else cast(substr(id_number, i, 1) as int) * 2 end)) as luhn from customer_v)
    select candidate_id, id_number, regexp_matches(id_number, '^\d{13}$') and try_cast(case when this_c > '1998-07-01' then last_c else this_c end
      as date) is not null and substr(id_number, 11, 1) in ('0', '1') and luhn % 10 = 0 as valid from d""",
)
def _(t):
    return t.customer_v.select("candidate_id", "id_number", D.valid_id_number(F.col("id_number"), NOW_ORDERS[:10]).alias("valid"))


@query(
    "birth_date_from_id",
    f"""select candidate_id, case when cast(substr(id_number, 3, 2) as int) between 1 and 12 and cast(substr(id_number, 5, 2) as int) between 1 and 31
    then cast(cast(substr(id_number, 5, 2) as int) as varchar) || ' ' || {MONTH_LIST}[cast(substr(id_number, 3, 2) as int)] || ' ' ||
      case when cast(substr(id_number, 1, 2) as int) > 30 then '19' else '20' end || substr(id_number, 1, 2) end as born from customer_v""",
)
def _(t):
    return t.customer_v.select("candidate_id", D.birth_date_from_id(F.col("id_number")).alias("born"))


@query(
    "normalise_phone",
    r"""select candidate_id, phone, case when regexp_matches(p, '^0[1-9]\d{8}$') then '+27' || substr(p, 2)
      when regexp_matches(p, '^\+27[1-9]\d{8}$') then p end as dial
    from (select candidate_id, phone, regexp_replace(phone, '[\s()-]', '', 'g') as p from customer_v) x""",
)
def _(t):
    return t.customer_v.select("candidate_id", "phone", D.normalise_phone(F.col("phone")).alias("dial"))


@query(
    "local_today",
    "select event_id, cast(cast(ts + interval '2' hour as date) as varchar) as day from events",
)
def _(t):
    return t.events.select("event_id", D.local_today(F.col("ts")).cast("string").alias("day"))


@query(
    "valid_start_date",
    """select candidate_id, cast(start_at as date) between date '1998-07-02' and date '1998-09-29' and isodow(start_at) < 6 as valid
    from customer_v""",
)
def _(t):
    ok = D.valid_start_date(F.col("start_at").cast("date"), F.lit(NOW_ORDERS).cast("timestamp").cast("date"))
    return t.customer_v.select("candidate_id", ok.alias("valid"))


@query(
    "tidy_date",
    f"""select o_orderkey, case o_orderkey % 4 when 2 then strftime(o_orderdate, '%b %Y') when 3 then '13/13/99'
    else cast(day(o_orderdate) as varchar) || ' ' || {MONTH_LIST}[month(o_orderdate)] || ' ' ||
      case when o_orderkey % 4 = 0 then case when year(o_orderdate) % 100 > 30 then '19' else '20' end
        || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') else cast(year(o_orderdate) as varchar) end end as tidy from orders""",
)
def _(t):
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "d/MM/yy"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "MMM yyyy"))
        .otherwise("13/13/99")
    )
    return t.orders.select("o_orderkey", D.tidy_date(raw).alias("tidy"))


def range_lines(t):
    """A role line per order with its dates in one of six spellings."""
    start, end = F.col("o_orderdate"), F.expr("o_orderdate + interval '1' day * cast(o_orderkey % 900 as int)")
    k = F.col("o_orderkey") % 6
    shown = (
        F.when(k == 0, F.concat(F.date_format(start, "MMM yyyy"), F.lit(" - "), F.date_format(end, "MMM yyyy")))
        .when(k == 1, F.concat(F.date_format(start, "MM/yyyy"), F.lit(" to "), F.date_format(end, "yyyy-MM")))
        .when(k == 2, F.concat(F.date_format(start, "MMMM yyyy"), F.lit(" – present")))
        .when(k == 3, F.concat(F.date_format(start, "yyyy"), F.lit(" - "), F.date_format(end, "yyyy")))
        .when(k == 4, F.concat(F.date_format(start, "MMM-yy"), F.lit(" until "), F.date_format(end, "MMM yyyy"), F.lit(" (2 yrs 3 mos)")))
        .otherwise("no dates at all")
    )
    return t.orders.select("o_orderkey", F.concat(F.lit("Clerk, "), shown).alias("line"))


@query(
    "parse_date_range",
    """with o as (select *, o_orderdate + interval '1' day * cast(o_orderkey % 900 as int) as e, o_orderkey % 6 as k from orders),
    m as (select *, strftime(o_orderdate, '%B %Y') as sm, case when k = 2 then 'Present' else strftime(e, '%B %Y') end as em from o)
    select o_orderkey, case when k = 3 then strftime(o_orderdate, '%Y') || ' – ' || strftime(e, '%Y') when k < 5 then
      case when k = 4 then strftime(o_orderdate, '%B ') || case when year(o_orderdate) % 100 > 30 then '19' else '20' end
        || strftime(o_orderdate, '%y') else sm end || ' – ' || em end as range_text,
      case when k = 3 then 'year' when k < 5 then 'month' end as precision from m""",
)
def _(t):
    read = range_lines(t).withColumn("r", D.parse_date_range(F.col("line")))
    return read.select("o_orderkey", F.col("r.text").alias("range_text"), F.col("r.precision").alias("precision"))


@query(
    "widen_range",
    """select person_id, min(from_month) as from_month, case when count(*) = count(to_month) then max(to_month) end as to_month
    from spans_v group by person_id""",
)
def _(t):
    from vetloom.operators.records import widen_range

    return widen_range(t.spans_v, "person_id")


_TENURE = """with stated as (select o_orderkey as role_id, year(o_orderdate) as y1, case when o_orderstatus = 'O' then null
      else year(o_orderdate) + o_orderkey % 3 end as y2 from orders),
    derived as (select l_orderkey as role_id, min(year(l_shipdate) * 12 + month(l_shipdate) - 1) as m1,
      max(year(l_shipdate) * 12 + month(l_shipdate) - 1) as m2 from lineitem group by 1)"""


@query(
    "derive_tenure",
    _TENURE
    + """ select role_id, y1, y2, case when ok then m1 end as from_month, case when ok then m2 end as to_month,
      case when ok then 'month' else 'year' end as precision
    from (select *, coalesce(m1 // 12 = y1 and m2 // 12 = y2, false) as ok from stated left join derived using (role_id)) x""",
)
def _(t):
    from vetloom.operators.records import derive_tenure

    stated = t.orders.select(
        F.col("o_orderkey").alias("role_id"),
        F.year("o_orderdate").alias("y1"),
        F.when(F.col("o_orderstatus") != "O", F.year("o_orderdate") + F.col("o_orderkey") % 3).alias("y2"),
    )
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    titles = t.lineitem.select(F.col("l_orderkey").alias("role_id"), month.alias("from_month"), month.alias("to_month"))
    return derive_tenure(stated, titles, "role_id")


@query(
    "tenure_band",
    f"""select span_id, {tenure_case('greatest(0, coalesce(to_month, 1998 * 12 + 6) - from_month)')} as band from spans_v""",
)
def _(t):
    band = D.tenure_band(F.col("from_month"), F.col("to_month"), F.lit(1998 * 12 + 6))
    return t.spans_v.select("span_id", band.alias("band"))


@query(
    "age_band",
    """with a as (select o_orderkey, date_part('year', age(date '1998-07-01', cast(o_orderdate - interval '1' month * cast(o_orderkey % 1300 as int) as date))) as y,
      cast(o_orderdate - interval '1' month * cast(o_orderkey % 1300 as int) as date) as born from orders),
    b as (select o_orderkey, year(date '1998-07-01') - year(born) - case when strftime(born, '%m%d') > '0701' then 1 else 0 end as y from a)
    select o_orderkey, case when y between 0 and 100 then cast(y // 5 * 5 as varchar) || ' – ' || cast(y // 5 * 5 + 5 as varchar) end as band from b""",
)
def _(t):
    born = F.add_months(F.col("o_orderdate").cast("date"), -(F.col("o_orderkey") % 1300).cast("int"))
    return t.orders.select("o_orderkey", D.age_band(born, F.lit("1998-07-01").cast("date")).alias("band"))


@query(
    "area_only",
    """select s_suppkey, case when s_suppkey % 3 = 2 then '5 Main Road' else 'Suburb ' || cast(s_suppkey % 7 as varchar) || ', ' || n_name end as area
    from supplier join nation on s_nationkey = n_nationkey""",
)
def _(t):
    where = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    suburb = F.concat(F.lit("Suburb "), (F.col("s_suppkey") % 7).cast("string"))
    address = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(", ", F.lit("12 Long Street"), suburb, "n_name", F.lit("8001")))
        .when(F.col("s_suppkey") % 3 == 1, F.concat_ws(" , ", F.lit("Unit 4"), suburb, "n_name"))
        .otherwise("5 Main Road")
    )
    return where.select("s_suppkey", X.area_only(address).alias("area"))


@query(
    "yes_no",
    """select l_orderkey, l_linenumber, case l_returnflag when 'N' then 'No' when 'R' then 'Yes' else 'A' end as answer from line_v""",
)
def _(t):
    raw = F.when(F.col("l_returnflag") == "R", " yEs ").otherwise(F.col("l_returnflag"))
    return t.line_v.select("l_orderkey", "l_linenumber", X.yes_no(raw).alias("answer"))


@query("value_at_path", "select event_id, props->>'$.k' as value, true as allowed, cast(null as varchar) as refused from events")
def _(t):
    from vetloom.operators.suggestions import path_allowed, value_at_path

    return t.events.select(
        "event_id",
        value_at_path(F.col("props"), "k").alias("value"),
        path_allowed(F.lit("experience[2].titles[0].title"), F.lit("agency")).alias("allowed"),
        F.when(path_allowed(F.lit("personal.email"), F.lit("agency")), "open").alias("refused"),
    )
