"""Candidate records: reading, merging, standardising and redacting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import dates as D
from vetloom.functions import patterns as R
from vetloom.functions import text as X
from vetloom.functions.phrases import bare_heading
from vetloom.operators.review import MARK, sections_of


def widen_range(spans: DataFrame, key: str) -> DataFrame:
    """Earliest start and latest end per key; an open end (null) wins."""
    return spans.groupBy(key).agg(
        F.min("from_month").alias("from_month"),
        F.when(F.count("*") == F.count("to_month"), F.max("to_month")).alias("to_month"),
    )


def derive_tenure(stated: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Replace a years-only tenure by the span of its titles where both name the same years."""
    spans = titles.groupBy(key).agg(F.min("from_month").alias("m1"), F.max("to_month").alias("m2"))
    joined = stated.join(spans, key, "left")
    same = F.coalesce(
        (F.floor(F.col("m1") / 12) == F.col("y1")) & (F.floor(F.col("m2") / 12) == F.col("y2")), F.lit(False)
    )
    return joined.select(
        key,
        "y1",
        "y2",
        F.when(same, F.col("m1")).alias("from_month"),
        F.when(same, F.col("m2")).alias("to_month"),
        F.when(same, "month").otherwise("year").alias("precision"),
    )


# ---- reading CV text ---------------------------------------------------------------------------------

def split_lines(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, line_no, line)`` with line ends trimmed."""
    rows = docs.select(key, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace("line", r"\s+$", ""))


def heading_label(line: Column) -> Column:
    """A heading line without bullet, numbering and closing marks, in lower case."""
    bare = F.regexp_replace(X.trim_all(line), r"^[•●*\-–—▪▫➢✓+>#|~]+\s*", "")
    bare = F.regexp_replace(bare, r"^(?:\d{1,2}\.?|[A-Za-z]\.|\([A-Za-z0-9]+\))\s+", "")
    return F.lower(X.trim_all(F.regexp_replace(bare, r"[:\s|~]+$", "")))


def _named(label: Column, names: dict[str, Sequence[str]]) -> Column:
    """The first name that lists the label, or null."""
    out = F.lit(None).cast("string")
    for name, labels in reversed(names.items()):
        out = F.when(label.isin(list(labels)), name).otherwise(out)
    return out


def heading_name(line: Column, headings: dict[str, Sequence[str]] = R.CV_SECTIONS, fields: dict[str, Sequence[str]] = R.CV_FIELDS) -> Column:
    """Section a line opens, or null. Long lines, sentences and field labels open none."""
    raw = X.trim_all(line)

    def named(label: Column) -> Column:
        field = label.isin([f for labels in fields.values() for f in labels])
        return F.when(~field & (F.size(F.split(label, " ")) <= 6), _named(label, headings))

    usable = (raw != "") & (F.length(raw) <= 75) & ~F.regexp_like(raw, F.lit("[.!?]$"))
    return F.when(usable, X.let(bare_heading(heading_label(line)), named))


def segment_sections(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, part_no, section, lines)``; lines above the first heading belong to ``head``."""
    lines = F.transform(F.split(F.translate(F.col(column), MARK, ""), "\n"), lambda l: F.regexp_replace(l, r"\s+$", ""))
    parts = sections_of(lines, heading_name, "head")
    return docs.select(key, F.posexplode_outer(parts).alias("part_no", "s")).select(key, "part_no", F.col("s.title").alias("section"), "s.lines")


def labelled_fields(sections: DataFrame, key: str, fields: dict[str, Sequence[str]] = R.CV_FIELDS) -> DataFrame:
    """First value per field from ``label: value``, ``label<tab>value`` or a label above its value."""
    source = sections.filter(F.col("section").isin("head", "personal"))
    any_label = [f for labels in fields.values() for f in labels]

    def read(line: Column, i: Column) -> Column:
        l = X.trim_all(line)
        shape = r"^([^:\t]{2,40})[:\t]\s*(.+)$"
        inline = X.trim_all(F.regexp_extract(l, shape, 2))
        after = X.trim_all(F.coalesce(F.get(F.col("lines"), i + 1), F.lit("")))
        below = F.when((after != "") & ~bare_heading(after).isin(any_label), after).otherwise("")
        return F.struct(
            F.when(inline != "", bare_heading(F.regexp_extract(l, shape, 1))).otherwise(bare_heading(l)).alias("label"),
            F.when(inline != "", inline).otherwise(below).alias("value"),
        )

    rows = source.select(key, "part_no", F.posexplode_outer(F.transform("lines", read)).alias("n", "r"))
    found = rows.withColumn("field", _named(F.col("r.label"), fields)).filter(F.col("field").isNotNull() & (F.col("r.value") != ""))
    first = found.groupBy(key, "field").agg(F.min_by("r.value", F.struct("part_no", "n")).alias("value"))
    clean = F.trim(F.regexp_replace("value", r"^[\s:–—-]+", ""))
    value = (
        F.when(F.col("field") == "dateOfBirth", D.tidy_date(clean))
        .when(F.col("field").isin("driversLicence", "ownTransport"), X.yes_no(clean))
        .otherwise(clean)
    )
    return first.withColumn("value", value)


def first_contact(docs: DataFrame, key: str, column: str) -> DataFrame:
    """First e-mail address and first phone of a document; a 13-digit identity number is no phone."""
    email = F.regexp_extract(column, R.RECORD_EMAIL, 0)
    hits = F.filter(F.transform(F.split(column, "\n"), lambda l: F.regexp_extract(l, R.CV_PHONE, 0)), lambda m: m != "")
    phone = F.trim(F.coalesce(F.get(hits, F.lit(0)), F.lit("")))
    kept = F.when(F.length(F.regexp_replace(phone, r"\D", "")) == 13, "").otherwise(phone)
    return docs.select(key, email.alias("email"), kept.alias("phone"))


def drop_contact_by_mode(records: DataFrame) -> DataFrame:
    """Agency records lose contact details and say so; direct records keep them."""
    p = F.col("personal")
    drop = F.col("meta.mode") != "direct"
    had = drop & ((F.trim(p["email"]) != "") | (F.trim(p["phone"]) != ""))
    blank = F.lit("")
    personal = p.withField("email", F.when(drop, blank).otherwise(p["email"])).withField("phone", F.when(drop, blank).otherwise(p["phone"]))
    return records.withColumn("contact_gap", had).withColumn("personal", personal)


ITEM_MARKS = r"[,;|\t•●▪▫➢✓+>]"


def skill_items(sections: DataFrame, key: str) -> DataFrame:
    """``(key, line_no, group, item)``: items of 2 to 45 characters with a letter; ungrouped ones once each, ignoring case."""
    lines = sections.filter("section = 'skills'").select(key, "part_no", F.posexplode_outer("lines").alias("n", "raw"))
    line = X.trim_all(F.regexp_replace("raw", X.BULLET, ""))
    head = lines.withColumn("line", line).filter(F.col("line") != "")
    shape = r"^([A-Za-z0-9\s&/\\-]+)[:\t]\s*(.+)$"
    label, rest = F.regexp_extract("line", shape, 1), F.regexp_extract("line", shape, 2)
    grouped = (rest != "") & (F.length(label) < 35) & ~rest.startswith("http")
    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, r"^[\s\-–—:]+", ""), r"[.\s]+$", "")
    split = head.select(
        key, F.struct("part_no", "n").alias("line_no"), F.when(grouped, F.trim(label)).otherwise("").alias("group"),
        F.posexplode(F.transform(F.split(F.when(grouped, rest).otherwise(F.regexp_replace("line", r"\s{3,}", ",")), ITEM_MARKS), tidy)).alias("i", "item"),
    )
    kept = split.filter(F.length("item").between(2, 45) & F.regexp_like("item", F.lit("[A-Za-z]")))
    once = kept.filter("`group` = ''").groupBy(key, F.lower("item").alias("k")).agg(F.min(F.struct("line_no", "i", "group", "item")).alias("f"))
    return kept.filter("`group` <> ''").select(key, "line_no", "group", "item").unionByName(once.select(key, "f.line_no", "f.group", "f.item"))


def study_year(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Last year from 1950 to 2049 in every line that has one."""
    years = X.all_matches(F.col("line"), R.CV_YEAR)
    return split_lines(docs, key, column).select(key, "line_no", F.try_element_at(years, F.lit(-1)).alias("year")).filter("year is not null")


def rewrap(lines: Column) -> Column:
    """Trimmed lines with wrapped sentences joined; blank lines break a sentence and then drop out."""

    def add(done: Column, raw: Column) -> Column:
        line = X.trim_all(raw)
        last = F.substring_index(done, "\n", -1)
        bullet, closed = F.regexp_like(line, F.lit(X.BULLET)), F.regexp_like(last, F.lit("[.!?:]$"))
        goes_on = (last != "") & ~bullet & ~closed & F.regexp_like(line, F.lit("^[a-z(,]"))
        return F.concat(done, F.when(goes_on, F.lit(" ")).otherwise(F.lit("\n")), line)

    text = F.aggregate(lines, F.lit(""), add)
    return F.filter(F.split(text, "\n"), lambda l: l != "")


def _sub_heading(line: Column) -> Column:
    listed = {"achievements": R.ACHIEVEMENT_HEADINGS, "responsibilities": R.DUTY_HEADINGS, "context": R.CONTEXT_HEADINGS}
    return F.coalesce(_named(bare_heading(line), listed), F.when(F.regexp_like(line, F.lit(R.LEAVING_LINE)), "leaving"))


def _may_head(line: Column) -> Column:
    return (
        F.coalesce(line, F.lit("")) != ""
    ) & (F.length(line) <= 90) & ~F.regexp_like(line, F.lit(X.BULLET)) & _sub_heading(line).isNull() & ~F.regexp_like(line, F.lit("[.!?]$"))


def _may_date(line: Column) -> Column:
    """A cheap look before the full range is read: no bullet, and a digit or an open-end word."""
    hint = F.regexp_like(line, F.lit(r"(?i)\d|present|current|to date|ongoing|now"))
    return ~F.regexp_like(line, F.lit(X.BULLET)) & hint


def role_anchors(sections: DataFrame, key: str) -> DataFrame:
    """Role blocks of the experience section: ``(key, role_no, heading, dates, precision, body)``.

    Every line with a date range that is no bullet anchors a role; up to three heading lines above
    it belong to it, and everything down to the next role's heading is its body.
    """
    own = sections.filter("section = 'experience'").select(key, "part_no", rewrap(F.col("lines")).alias("lines"))
    marked = own.withColumn(
        "marks",
        F.transform("lines", lambda l: F.struct(l.alias("line"), F.when(_may_date(l), D.parse_date_range(l)).alias("range"), _may_head(l).alias("head"))),
    )
    at = marked.withColumn("anchors", F.filter(F.transform("marks", lambda m, i: F.when(m["range"].isNotNull(), i)), lambda i: i.isNotNull()))

    def start(place: Column, before: Column) -> Column:
        """First line of a block: back over heading lines, three at most, never past the anchor before."""
        one = (place - 1 > before) & F.get("marks", place - 1)["head"]
        two = one & (place - 2 > before) & F.get("marks", place - 2)["head"]
        three = two & (place - 3 > before) & F.get("marks", place - 3)["head"]
        up = F.when(F.coalesce(three, F.lit(False)), 3).when(F.coalesce(two, F.lit(False)), 2).when(F.coalesce(one, F.lit(False)), 1).otherwise(0)
        return place - up

    spans = at.withColumn(
        "blocks",
        F.transform(
            "anchors",
            lambda place, i: F.struct(
                place.alias("at"),
                start(place, F.coalesce(F.get("anchors", i - 1), F.lit(-1))).alias("first"),
                F.coalesce(start(F.get("anchors", i + 1), place), F.size("marks")).alias("stop"),
            ),
        ),
    )
    # The outer form spares the planner a copy of the whole chain in a "not empty" filter.
    rows = spans.select(key, "part_no", "lines", "marks", F.posexplode_outer("blocks").alias("role_no", "b")).filter("b is not null")
    dates = F.get("marks", F.col("b.at"))["range"]
    return rows.select(
        key, "role_no",
        F.slice("lines", F.col("b.first") + 1, F.col("b.at") - F.col("b.first")).alias("heading"),
        dates["text"].alias("dates"), dates["precision"].alias("precision"),
        F.slice("lines", F.col("b.at") + 2, F.greatest(F.col("b.stop") - F.col("b.at") - 1, F.lit(0))).alias("body"),
    )


def body_buckets(roles: DataFrame, key: str) -> DataFrame:
    """Bullets of a role body by bucket; bullets under a context heading count as responsibilities."""

    def opened(line: Column) -> Column:
        kind = _sub_heading(line)
        return F.when(kind != "leaving", kind)

    parts = roles.select(key, "role_no", F.explode_outer(sections_of(F.col("body"), opened, "responsibilities")).alias("s"))
    lines = parts.select(key, "role_no", F.col("s.title").alias("bucket"), F.explode_outer("s.lines").alias("line"))
    bullets = lines.filter(F.regexp_like("line", F.lit(X.BULLET)))
    bucket = F.when(F.col("bucket") == "context", "responsibilities").otherwise(F.col("bucket"))
    return bullets.select(key, "role_no", bucket.alias("bucket"), F.trim(F.regexp_replace("line", X.BULLET, "")).alias("bullet"))


# ---- records -------------------------------------------------------------------------------------------

def _calm_title(title: Column) -> Column:
    return F.when((title == F.upper(title)) & (F.length(title) > 4), X.title_case(title)).otherwise(title)


def _en_dash(duration: Column) -> Column:
    return F.trim(F.regexp_replace(duration, r"\s+[-–—]+\s+", " – "))


def _fragments(items: Column) -> Column:
    trimmed = F.filter(F.transform(items, X.trim_all), lambda b: b != "")
    return F.transform(trimmed, lambda b: X.capital_first(F.regexp_replace(b, "[.;,]+$", "")))


def standardise_records(records: DataFrame) -> DataFrame:
    """House style: en-dash ranges, capitals, bullet and sentence punctuation, calm titles, trimmed chips."""

    def sentence(raw: Column) -> Column:
        s = X.capital_first(X.trim_all(raw))
        return F.when(F.regexp_like(s, F.lit("[.!?]$")), s).otherwise(F.concat(s, F.lit(".")))

    def role(r: Column) -> Column:
        titles = F.transform(r["titles"], lambda t: t.withField("title", _calm_title(t["title"])).withField("duration", _en_dash(t["duration"])))
        return (
            r.withField("duration", _en_dash(r["duration"])).withField("titles", titles)
            .withField("responsibilities", _fragments(r["responsibilities"])).withField("achievements", _fragments(r["achievements"]))
        )

    chips = lambda items: F.filter(F.transform(items, lambda s: F.regexp_replace(X.trim_all(s), "[.,;]+$", "")), lambda s: s != "")
    return records.withColumns(
        {
            "meta": F.col("meta").withField("targetRole", _calm_title(F.col("meta.targetRole"))),
            "professionalSummary": F.transform(F.filter("professionalSummary", lambda b: X.trim_all(b) != ""), sentence),
            "experience": F.transform("experience", role),
            "earlyCareer": F.transform("earlyCareer", lambda r: r.withField("duration", _en_dash(r["duration"]))),
            "technicalSkills": F.transform("technicalSkills", lambda g: g.withField("items", chips(g["items"]))),
        }
    )


def redact_records(records: DataFrame, today: str) -> DataFrame:
    """Seven independent flags; the input rows stay as they are."""
    f, p = F.col("redact"), F.col("personal")
    now_month = int(today[:4]) * 12 + int(today[5:7]) - 1
    alias = lambda value: F.when(F.trim(value) != "", F.trim(value)).otherwise("")
    shown = F.when(F.trim("meta.reference") != "", F.trim("meta.reference")).otherwise(
        F.coalesce(F.nullif(X.initials(p["fullName"]), F.lit("")), F.lit("Candidate profile"))
    )
    born = F.try_to_date(p["dateOfBirth"], "d MMMM yyyy")
    band = F.coalesce(D.age_band(born, F.lit(today).cast("date")), F.lit(""))
    blank = F.lit("")

    def when(flag: str, value: Column, other: Column) -> Column:
        return F.when(f[flag], value).otherwise(other)

    banded = lambda d: F.coalesce(D.tenure_band_of_range(d, now_month), d)
    personal = (
        p.withField("fullName", when("candidateName", shown, p["fullName"]))
        .withField("email", when("candidateName", blank, p["email"]))
        .withField("phone", when("candidateName", blank, p["phone"]))
        .withField("dateOfBirth", when("dateOfBirth", blank, p["dateOfBirth"]))
        .withField("ageBand", when("dateOfBirth", band, F.lit(None).cast("string")))
        .withField("areaOfResidence", when("areaOfResidence", alias(p["areaAlias"]), p["areaOfResidence"]))
    )

    def role(r: Column) -> Column:
        titles = F.transform(r["titles"], lambda t: t.withField("duration", when("dates", banded(t["duration"]), t["duration"])))
        return early(r).withField("titles", titles)

    def early(r: Column) -> Column:
        named = r.withField("employer", when("employerNames", alias(r["alias"]), r["employer"]))
        return named.withField("duration", when("dates", banded(r["duration"]), r["duration"]))

    study = lambda q: q.withField("institution", when("institutions", alias(q["institutionAlias"]), q["institution"])).withField(
        "year", when("qualificationYears", blank, q["year"])
    )
    return records.withColumns(
        {
            "personal": personal,
            "experience": F.transform("experience", role),
            "earlyCareer": F.transform("earlyCareer", early),
            "qualifications": F.transform("qualifications", study),
        }
    )


def flatten_fields(records: DataFrame, key: str = "record_id") -> DataFrame:
    """``(key, path, value)`` for every text field; contact paths only in direct mode."""

    def pair(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"))

    def indexed(base: Column, items: Column) -> Column:
        return F.transform(items, lambda v, i: pair(F.concat(base, F.lit("["), i.cast("string"), F.lit("]")), v))

    def fields(base: str, items: Column, names: list[str]) -> Column:
        return F.flatten(
            F.transform(
                items,
                lambda s, i: F.array(*[pair(F.concat(F.lit(f"{base}["), i.cast("string"), F.lit(f"].{n}")), s[n]) for n in names]),
            )
        )

    def nested(base: str, items: Column, name: str, inner=None) -> Column:
        def one(s: Column, i: Column) -> Column:
            start = F.concat(F.lit(f"{base}["), i.cast("string"), F.lit(f"].{name}"))
            if inner is None:
                return indexed(start, s[name])
            return F.flatten(
                F.transform(s[name], lambda x, j: F.array(*[pair(F.concat(start, F.lit("["), j.cast("string"), F.lit(f"].{n}")), x[n]) for n in inner]))
            )

        return F.flatten(F.transform(items, one))

    p = F.col("personal")
    personal = ["fullName", "citizenship", "languages", "dateOfBirth", "areaOfResidence", "availability"]
    contact = F.when(F.col("meta.mode") == "direct", F.array(*[pair(F.lit(f"personal.{n}"), p[n]) for n in ("email", "phone")]))
    exp = F.col("experience")
    rows = F.concat(
        F.array(pair(F.lit("meta.targetRole"), F.col("meta.targetRole"))),
        F.array(*[pair(F.lit(f"personal.{n}"), p[n]) for n in personal]),
        F.coalesce(contact, F.array().cast("array<struct<path:string,value:string>>")),
        indexed(F.lit("professionalSummary"), F.col("professionalSummary")),
        fields("qualifications", F.col("qualifications"), ["year", "name", "institution", "institutionAlias"]),
        fields("technicalSkills", F.col("technicalSkills"), ["group"]),
        nested("technicalSkills", F.col("technicalSkills"), "items"),
        fields("experience", exp, ["employer", "duration", "alias", "context", "reasonForLeaving"]),
        nested("experience", exp, "titles", ["title", "duration"]),
        nested("experience", exp, "responsibilities"),
        nested("experience", exp, "achievements"),
        fields("earlyCareer", F.col("earlyCareer"), ["title", "employer", "duration", "alias"]),
    )
    # the outer form: the inner one copies the whole chain into a filter below the projection
    return records.select(key, F.explode_outer(rows).alias("r")).filter("r is not null").select(key, "r.path", "r.value")


def merge_records(base: DataFrame, incoming: DataFrame, key: str = "record_id") -> DataFrame:
    """Fill empty fields, match employers by equality or containment, add what is new; ``notes`` name each change.

    Both inputs hold one row per record, so the merge is one equi-join and array work inside the row.
    """
    both = base.alias("b").join(incoming.alias("i"), key, "left")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    names = ["fullName", "citizenship", "languages", "dateOfBirth", "areaOfResidence", "availability", "email", "phone"]
    bp, ip = F.col("b.personal"), F.col("i.personal")
    personal, notes = bp, []
    for n in names:
        take = ~filled(bp[n]) & filled(ip[n])
        personal = personal.withField(n, F.when(take, ip[n]).otherwise(bp[n]))
        notes.append(F.when(take, F.concat(F.lit(f"filled {n}: "), ip[n])))

    def near(a: Column, b: Column) -> Column:
        x, y = F.lower(a), F.lower(b)
        return (a != "") & (b != "") & ((x == y) | x.contains(y) | y.contains(x))

    none = F.array().cast("array<string>")
    bx, ix = F.col("b.experience"), F.coalesce(F.col("i.experience"), F.array().cast(base.schema["experience"].dataType))
    # An incoming role belongs to the first base role it matches.
    placed = F.transform(ix, lambda r: F.struct(r.alias("r"), F.array_position(F.transform(bx, lambda e: near(e["employer"], r["employer"])), True).alias("at")))

    def merged_role(e: Column, i: Column) -> Column:
        mine = F.transform(F.filter("__placed", lambda p: p["at"] == i + 1), lambda p: p["r"])
        titles = F.flatten(F.transform(mine, lambda r: r["titles"]))
        fresh = F.filter(titles, lambda t: ~F.exists(e["titles"], lambda o: F.lower(o["title"]) == F.lower(t["title"])))
        once = F.filter(fresh, lambda t, n: F.array_position(F.transform(fresh, lambda o: F.lower(o["title"])), F.lower(t["title"])) == n + 1)
        add = lambda own, field: F.concat(own, F.array_except(F.flatten(F.transform(mine, lambda r: r[field])), own))
        first = lambda field: F.get(F.filter(F.transform(mine, lambda r: r[field]), filled), F.lit(0))
        loose = ~filled(e["duration"]) | F.regexp_like(F.coalesce(e["duration"], F.lit("")), F.lit(r"^\d{4}"))
        return (
            e.withField("titles", F.concat(e["titles"], once))
            .withField("duration", F.when(loose, F.coalesce(first("duration"), e["duration"])).otherwise(e["duration"]))
            .withField("responsibilities", add(e["responsibilities"], "responsibilities"))
            .withField("achievements", add(e["achievements"], "achievements"))
            .withField("context", F.when(filled(e["context"]), e["context"]).otherwise(F.coalesce(first("context"), e["context"])))
        )

    new_roles = F.transform(F.filter("__placed", lambda p: (p["at"] == 0) & (filled(p["r"]["employer"]) | (F.size(p["r"]["titles"]) > 0))), lambda p: p["r"])
    bq, iq = F.col("b.qualifications"), F.col("i.qualifications")
    same_name = lambda a, b: F.lower(a["name"]) == F.lower(b["name"])
    studied = F.transform(
        bq,
        lambda q: X.let(
            F.get(F.filter(iq, lambda o: same_name(o, q)), F.lit(0)),
            lambda o: q.withField("year", F.when(filled(q["year"]), q["year"]).otherwise(F.coalesce(o["year"], q["year"]))).withField(
                "institution", F.when(filled(q["institution"]), q["institution"]).otherwise(F.coalesce(o["institution"], q["institution"]))
            ),
        ),
    )
    new_study = F.filter(iq, lambda q: filled(q["name"]) & ~F.exists(bq, lambda o: same_name(o, q)))
    known = F.transform(F.flatten(F.transform(F.col("b.technicalSkills"), lambda g: g["items"])), F.lower)
    offered = F.flatten(F.transform(F.col("i.technicalSkills"), lambda g: g["items"]))
    prepared = both.select(
        key, F.col("b.meta").alias("meta"), personal.alias("personal"), bx.alias("__bx"), placed.alias("__placed"),
        F.concat(studied, F.coalesce(new_study, F.array().cast(base.schema["qualifications"].dataType))).alias("qualifications"),
        F.col("b.technicalSkills").alias("technicalSkills"), F.coalesce(offered, none).alias("__offered"), known.alias("__known"),
        F.filter(F.array(*notes), lambda n: n.isNotNull()).alias("__filled"),
        F.transform(F.coalesce(new_study, F.array().cast(base.schema["qualifications"].dataType)), lambda q: F.concat(F.lit("added study: "), q["name"])).alias("__study"),
    )
    skilled = prepared.withColumn("new_skills", F.filter(F.array_distinct("__offered"), lambda s: filled(s) & ~F.array_contains("__known", F.lower(s))))
    role_notes = F.transform(new_roles, lambda r: F.concat(F.lit("added role: "), r["employer"]))
    skill_note = F.when(F.size("new_skills") > 0, F.array(F.concat(F.lit("added skills: "), F.size("new_skills").cast("string")))).otherwise(none)
    return skilled.select(
        key, "meta", "personal", F.concat(F.transform("__bx", merged_role), new_roles).alias("experience"), "qualifications", "technicalSkills", "new_skills",
        F.concat("__filled", role_notes, "__study", skill_note).alias("notes"),
    )


def name_tokens(name: Column) -> Column:
    """Identifying words of a name: bracketed short forms, and words of three letters on that are not generic."""
    inside = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda v: F.trim(v)), lambda v: F.length(v) >= 2)
    words = F.split(F.regexp_replace(name, r"\([^)]*\)", ""), "[^A-Za-z0-9&]+")
    return F.array_distinct(F.concat(inside, F.filter(words, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(R.GENERIC_NAME_WORDS))))


def residual_identity_scan(records: DataFrame, key: str = "record_id") -> DataFrame:
    """First surviving token of a redacted name per prose field: ``(key, path, token, what)``.

    Tokens and fields belong to the same record row, so nothing is joined or shuffled.
    """
    f = F.col("redact")
    none = F.array().cast("array<struct<token:string,what:string>>")

    def tokens(flag: str, names: Column, what: str) -> Column:
        found = F.flatten(F.transform(names, name_tokens))
        return F.when(f[flag], F.transform(found, lambda t: F.struct(t.alias("token"), F.lit(what).alias("what")))).otherwise(none)

    skills = F.flatten(F.transform(F.flatten(F.transform("technicalSkills", lambda g: g["items"])), lambda s: F.split(F.lower(s), "[^a-z0-9&]+")))
    employers = F.concat(F.transform("experience", lambda r: r["employer"]), F.transform("earlyCareer", lambda r: r["employer"]))
    schools = F.filter(tokens("institutions", F.transform("qualifications", lambda q: q["institution"]), "institution name"), lambda t: ~F.array_contains(F.col("__skills"), F.lower(t["token"])))
    named = records.withColumn("__skills", skills).withColumn(
        "__tokens",
        F.concat(tokens("employerNames", employers, "employer name"), tokens("candidateName", F.array("personal.fullName"), "candidate name"), schools),
    )
    prose = (
        r"^(?:professionalSummary\[\d+\]|meta\.targetRole|experience\[\d+\]\."
        r"(?:context|reasonForLeaving|responsibilities\[\d+\]|achievements\[\d+\]|titles\[\d+\]\.title))$"
    )
    held = named.filter(F.size("__tokens") > 0)
    fields = flatten_fields(held.withColumn("__id", F.struct(F.col(key), "__tokens")), "__id")
    kept = fields.filter(F.regexp_like("path", F.lit(prose)))
    whole = lambda t: F.concat(F.lit("(?i)" + X.ASCII_BOUNDARY + r"\Q"), t, F.lit(r"\E" + X.ASCII_BOUNDARY))
    hit = F.get(F.filter("__id.__tokens", lambda t: F.regexp_like(F.col("value"), whole(t["token"]))), F.lit(0))
    return kept.withColumn("__hit", hit).filter("__hit is not null").select(F.col(f"__id.{key}").alias(key), "path", "__hit.token", "__hit.what")
