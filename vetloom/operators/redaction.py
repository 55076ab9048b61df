"""Redaction of contact data, links, names and identifiers, with a log of every replacement.

Every step is a projection on the document row: ``log_x`` gives the entries a step would write,
``redact_x`` gives the changed text. The pipeline chains them without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import patterns as R
from vetloom.functions import text as X
from vetloom.functions.phrases import any_of, bare_heading, literal
from vetloom.functions.text import let
from vetloom.operators.mentions import CORPORATE_ENDINGS, apply_mentions, with_hits
from vetloom.operators.review import MARK, cut, cut_matches, replace_each, replaced

LOG_TYPE = "array<struct<type:string,match:string,n:bigint,replacement:string,confidence:string,category:string>>"


@dataclass(frozen=True)
class House:
    """The caller's own names and tokens."""

    contact: str = "cv@agency.example.org"
    own: str = "agency.example.org"
    keep: tuple[str, ...] = ("example.com",)
    brand: str = "Northstar"
    brand_spaced: str = r"North\s+Star"
    contact_removed: str = "[Contact details removed]"
    link_removed: str = "[Link removed]"
    name_removed: str = "[Name removed]"
    reference_removed: str = "[Reference removed]"
    location_removed: str = "[Location details removed]"
    registration_removed: str = "[Registration details removed]"
    id_removed: str = "[ID Removed]"
    industries: tuple[tuple[tuple[str, ...], str], ...] = ()
    default_descriptor: str = "Leading organisation in its sector"
    extra_hosts: tuple[str, ...] = field(default_factory=tuple)

    @property
    def apply(self) -> str:
        return f"Apply via {self.contact}"


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.lower(text).contains(word.lower())
    return out


def _entries(matches: Column, kind: str, replacement, confidence: str, category: str) -> Column:
    """One log entry per distinct match with its count, in order of first occurrence.

    Matches are numbered and sorted, so that equal ones stand together: a run's length is its count.
    """
    make = replacement if callable(replacement) else (lambda m: F.lit(replacement))

    def runs(ordered: Column) -> Column:
        heads = F.filter(
            F.transform(ordered, lambda e, i: F.struct(i.alias("i"), e["m"].alias("m"), e["at"].alias("at"))),
            lambda e: (e["i"] == 0) | (F.get(ordered, e["i"] - 1)["m"] != e["m"]),
        )
        return let(heads, lambda h: F.transform(h, lambda e, k: F.struct(
            e["at"].alias("at"), e["m"].alias("m"), (F.coalesce(F.get(h, k + 1)["i"], F.size(ordered)) - e["i"]).cast("bigint").alias("n")
        )))

    numbered = F.array_sort(F.transform(matches, lambda m, at: F.struct(m.alias("m"), at.alias("at"))))
    return F.transform(
        F.array_sort(let(numbered, runs)),
        lambda e: F.struct(
            F.lit(kind).alias("type"), e["m"].alias("match"), e["n"].alias("n"), make(e["m"]).alias("replacement"),
            F.lit(confidence).alias("confidence"), F.lit(category).alias("category"),
        ),
    )


def _quoted(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


@dataclass(frozen=True)
class Step:
    """``log(text)`` gives entries, ``apply(text)`` the changed text.

    ``due(text, lower)`` is a cheap test, on the text and the text in lower case, that holds wherever the step has
    anything to do; elsewhere the text is ``idle(text)`` and the log stays as it is. ``shared`` holds what both read of the
    text, made once, and both as functions of that.
    """

    name: str
    log: Callable[[Column], Column]
    apply: Callable[[Column], Column]
    due: Callable[[Column, Column], Column] | None = None
    idle: Callable[[Column], Column] = lambda text: X.without(text, MARK)
    shared: tuple[Callable[[Column], Column], ...] | None = None


def _sharing(name: str, make: Callable[[Column], Column], log: Callable[[Column], Column], apply: Callable[[Column], Column], *more) -> Step:
    """A step whose patterns run once, in ``make``; ``log`` and ``apply`` are functions of what it gives."""
    due, idle = (*more, Step.idle)[:2]
    return Step(name, lambda text: log(make(text)), lambda text: apply(make(text)), due, idle, (make, log, apply))


def _worded(phrases: Sequence[str]) -> Callable[[Column, Column], Column]:
    """Whether the text holds all words of some phrase, whatever blanks are between them."""
    each = list(dict.fromkeys(tuple(sorted(set(p.lower().split()), key=lambda w: (-len(w), w))) for p in phrases))
    held = [words for words in each if not any(set(other) < set(words) for other in each)]
    return lambda text, lower: reduce(or_, [reduce(and_, [lower.contains(w) for w in words]) for words in held])


def _matching(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda text, lower: F.regexp_like(text, F.lit(pattern))


def _linked(endings: Sequence[str], starts: Sequence[str] = ()) -> Callable[[Column, Column], Column]:
    return lambda text, lower: X.has_any(lower, [*starts, *(f".{e}" for e in endings)])


def _foreign(house: House, due: Callable[[Column, Column], Column], endings: Sequence[str]) -> Callable[[Column, Column], Column]:
    """``due`` on the text without the house's own contact, for steps that leave what holds the house's own site as it is.

    No other match overlaps the contact if that is a plain word before the own site and no ending ends inside it.
    """
    word, _, site = house.contact.lower().partition("@")
    own = site == house.own.lower() and re.fullmatch(r"[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+", site) and site.endswith(tuple(f".{e}" for e in endings))
    early = "www." in site or any(f".{e}{c}" in site for e in endings for c in ".-") or any(e.endswith(word) for e in endings)
    if not own or early or not re.fullmatch("[a-z]+", word):
        return due
    return lambda text, lower: due(text, F.replace(lower, F.lit(house.contact.lower()), F.lit(" ")))


def _simple(name: str, pattern: str, token: str, confidence: str, category: str, due: Callable[[Column, Column], Column] | None = None) -> Step:
    def log(text: Column) -> Column:
        return _entries(cut_matches(cut(text, pattern)), name, token, confidence, category)

    return Step(name, log, lambda text: F.regexp_replace(text, F.lit(X.regex(pattern)), F.lit(_quoted(token))), due, lambda text: text)


def _confidential_pieces(text: Column, headings: Sequence[str], after: Sequence[str]) -> Column:
    """The text in pieces that begin at a confidential heading (``H``) or at a line that ends such a section (``E``)."""
    ending = X.regex(rf"(?i)^\s*$|^\s*{any_of(after)}\b")

    def tagged(line: Column) -> Column:
        heading = F.regexp_replace(bare_heading(line), "s$", "").isin(list(headings))
        ends = F.regexp_like(line, F.lit(ending))
        return F.when(heading, F.concat(F.lit(f"{MARK}H"), line)).when(ends, F.concat(F.lit(f"{MARK}E"), line)).otherwise(line)

    lines = F.transform(F.split(X.without(text, MARK), "\n"), tagged)
    return F.split(F.concat(F.lit("E"), F.array_join(lines, "\n")), MARK)


def confidential_blocks(house: House, headings: Sequence[str] = R.CONFIDENTIAL_HEADINGS, after: Sequence[str] = R.BRIEF_HEADINGS) -> Step:
    """Internal notes of any length: from their heading up to a blank line, another known heading or the end of the text."""

    def log(pieces: Column) -> Column:
        found = F.filter(pieces, lambda p: p.startswith("H"))
        whole = F.transform(found, lambda p: X.trim_all(F.substr(p, F.lit(2))))
        return _entries(whole, "confidential_section", "[Internal section removed]", "high", "Confidential Notes")

    def apply(pieces: Column) -> Column:
        kept = F.filter(pieces, lambda p: p.startswith("E"))
        return F.array_join(F.transform(kept, lambda p: F.substr(p, F.lit(2))), "")

    return _sharing("confidential_section", lambda text: _confidential_pieces(text, headings, after), log, apply, _worded(headings))


def emails(house: House) -> Step:
    kept = [house.own, *house.keep]

    def log(parts: Column) -> Column:
        found = F.transform(F.filter(cut_matches(parts), lambda m: ~_contains_any(m, kept)), F.lower)
        return _entries(found, "email", house.contact, "high", "Contact Information")

    def apply(parts: Column) -> Column:
        return replaced(parts, lambda m: F.when(_contains_any(m, kept), m).otherwise(house.contact))

    return _sharing("email", lambda text: cut(text, R.EMAIL, "@"), log, apply, lambda text, lower: text.contains("@"))


def apply_links(house: House) -> Step:
    calls, links = _worded(R.APPLY_CALLS), _linked(R.COMPANY_ENDINGS, R.LINK_STARTS)
    return _simple("apply_link", R.APPLY_LINK, house.apply, "high", "Application Links", lambda text, lower: calls(text, lower) & links(text, lower))


def apply_phrases(house: House) -> Step:
    """Whole apply lines; the line break before one goes with it."""

    def log(parts: Column) -> Column:
        found = F.filter(cut_matches(parts), lambda m: ~_contains_any(m, [house.own]))
        return _entries(F.transform(found, X.trim_all), "apply_phrase", house.apply, "medium", "Application Links")

    def apply(parts: Column) -> Column:
        return replaced(parts, lambda m: F.when(_contains_any(m, [house.own]), m).otherwise(house.apply))

    return _sharing("apply_phrase", lambda text: cut(text, R.APPLY_PHRASE), log, apply, _worded(R.APPLY_LINES))


def urls(house: House, known_roots: Sequence[str] = ()) -> Step:
    """Application links to the contact token, other external links to the link token, own links stay."""

    def verdict(match: Column) -> Column:
        root = F.regexp_extract(F.lower(match), r"([a-z0-9\-]+)\.(?:co\.za|com|io)", 1)
        known = F.lit(False)
        for name in known_roots:
            known = known | ((root != "") & (F.lit(name).contains(root) | root.contains(name)))
        external = F.regexp_like(match, F.lit(X.regex(r"(?i)https?://|www\.|\.(?:co\.za|com|io|net|org)\b"))) & (F.length(match) > 8)
        return (
            F.when(_contains_any(match, [house.own]), F.lit(None).cast("string"))
            .when(F.regexp_like(match, F.lit(R.APPLY_URL)), F.lit(house.contact))
            .when(known | external, F.lit(house.link_removed))
        )

    def log(parts: Column) -> Column:
        found = F.transform(F.filter(cut_matches(parts), lambda m: verdict(m).isNotNull()), F.lower)
        entries = _entries(found, "url", verdict, "medium", "External Links")
        return F.transform(
            entries,
            lambda e: e.withField("category", F.when(e["replacement"] == house.contact, "Application Links").otherwise("External Links")),
        )

    due = _foreign(house, _linked(R.SITE_ENDINGS, R.LINK_STARTS), R.SITE_ENDINGS)
    return _sharing("url", lambda text: cut(text, R.URL, ".", "://"), log, lambda parts: replaced(parts, lambda m: F.coalesce(verdict(m), m)), due)


# ---- names -------------------------------------------------------------------------------------

def infer_industry(text: Column, groups: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Descriptor of the first keyword group that occurs in the text."""
    lower = F.lower(text)
    out = F.lit(default)
    for keywords, descriptor in reversed(groups):
        out = F.when(F.regexp_like(lower, F.lit("|".join(literal(k) for k in keywords))), descriptor).otherwise(out)
    return out


def _phrased(lower: Column, phrases: Sequence[str]) -> Column:
    """Whether the text in lower case holds some phrase; a pattern only where it holds the words."""
    return _worded(phrases)(lower, lower) & F.regexp_like(lower, F.lit(any_of(phrases)))


MENTION = "array<struct<mention:string,descriptor:string,confidence:string>>"


def _group_matches(text: Column, patterns: Sequence[str], due: Sequence[Column], group: int = 1) -> Column:
    """Matches of each pattern; ``due`` holds a cheap test per pattern, true of every text with a match."""
    none = F.array().cast("array<string>")
    found = [F.when(d, F.transform(X.all_matches(text, p, group), X.trim_all)).when(text.isNotNull(), none) for p, d in zip(patterns, due)]
    return found[0] if len(found) == 1 else F.concat(*found)


def _as_mentions(names: Column, text: Column, house: House) -> Column:
    return F.transform(
        names,
        lambda n: F.struct(
            n.alias("mention"),
            infer_industry(F.concat(text, F.lit(" "), n), house.industries, house.default_descriptor).alias("descriptor"),
            F.lit("medium").alias("confidence"),
        ),
    )


def declared_mentions(text: Column, house: House) -> Column:
    """Names on a client line or before "is seeking", unless they read like a role or a sentence."""
    lower = F.lower(text)
    due = [X.has_any(text, R.OWNER_WORDS), _phrased(lower, R.SEEKING), lower.contains("confidential")]
    kept = F.filter(
        F.array_distinct(_group_matches(text, R.DECLARED_NAME, due)),
        lambda n: F.length(n).between(3, 80)
        & ~F.regexp_like(n, F.lit(R.GENERIC_WORDS))
        & ~F.regexp_like(n, F.lit(R.ROLE_WORDS_DECLARED))
        & (F.size(F.split(n, r"\s+")) <= 6),
    )
    return _as_mentions(kept, text, house)


def unknown_mentions(text: Column, house: House) -> Column:
    """Names with a corporate ending that someone joins or that hire."""
    lower = F.lower(text)
    ended = X.has_any(lower, R.ENDING_WORDS)
    due = [lower.contains("join") & ended, _phrased(lower, R.HIRING) & ended]
    kept = F.filter(
        F.array_distinct(_group_matches(text, R.UNKNOWN_NAME, due)),
        lambda n: F.length(n).between(3, 60)
        & ~F.regexp_like(n, F.lit(rf"{R.GENERIC_WORDS}|{literal(house.brand.lower())}"))
        & ~F.regexp_like(n, F.lit(R.ROLE_WORDS_UNKNOWN)),
    )
    return _as_mentions(kept, text, house)


def new_mentions(found: Column, candidates: Column, contained: bool = False) -> Column:
    """Candidates that are not found yet; with ``contained`` a name inside another counts as found."""

    def same(a: Column, b: Column) -> Column:
        x, y = F.lower(a["mention"]), F.lower(b["mention"])
        return (x == y) | x.contains(y) | y.contains(x) if contained else x == y

    return F.concat(found, F.filter(candidates, lambda c: ~F.exists(found, lambda f: same(f, c))))


def with_known_mentions(docs: DataFrame, key: str, column: str, names: DataFrame, endings: Sequence[str] = CORPORATE_ENDINGS) -> DataFrame:
    """Documents with ``__known``: the dictionary names in the text, each once, in order of their first place."""
    mention = lambda h: F.struct(h["mention"].alias("mention"), h["descriptor"].alias("descriptor"), F.lit("high").alias("confidence"))
    found = with_hits(docs, key, column, names, endings)
    return found.withColumn("__known", F.array_distinct(F.transform("__hits", mention)).cast(MENTION)).drop("__hits")


# ---- identifiers -----------------------------------------------------------------------------------

def bare_domains(house: House, known_roots: Sequence[str] = ()) -> Step:
    """Known domains, and plain ones near words such as "visit" or "website"; common hosts and own ones stay.

    Every occurrence is judged by its own neighbours: 30 characters before it and 40 behind.
    """
    hosts = [*R.COMMON_HOSTS, house.own, *house.extra_hosts]

    def goes(parts: Column, i: Column) -> Column:
        match = F.get(parts, i)
        root = F.substring_index(F.lower(match), ".", 1)
        known = F.lit(False)
        for name in known_roots:
            if len(name) > 3:
                known = known | root.contains(name) | F.lit(name).contains(root)
        around = F.concat(F.right(F.get(parts, i - 1), F.lit(30)), F.lit(" "), F.left(F.get(parts, i + 1), F.lit(40)))
        near = F.regexp_like(around, F.lit(R.DOMAIN_CONTEXT))
        return (i % 2 == 1) & ~_contains_any(match, hosts) & (known | (F.regexp_like(match, F.lit(R.PLAIN_DOMAIN)) & near))

    def log(ps: Column) -> Column:
        found = F.transform(ps, lambda p, i: F.when(goes(ps, i), F.lower(p)))
        return _entries(F.filter(found, lambda m: m.isNotNull()), "bare_domain", house.link_removed, "medium", "External Links")

    def apply(ps: Column) -> Column:
        return F.array_join(F.transform(ps, lambda p, i: F.when(goes(ps, i), house.link_removed).otherwise(p)), "")

    due = _foreign(house, _linked(R.COMPANY_ENDINGS), R.COMPANY_ENDINGS)
    return _sharing("bare_domain", lambda text: cut(text, R.BARE_DOMAIN, "."), lambda ps: let(ps, log), lambda ps: let(ps, apply), due)


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\D", ""))


def phones(house: House) -> Step:
    """Local numbers of 9 to 12 digits and international ones of 9 to 15; the log holds masked numbers of 9 to 15."""

    def one(parts: Column) -> Column:
        found = F.array_distinct(F.transform(cut_matches(parts), X.trim_all))
        kept = F.filter(found, lambda m: digit_count(m).between(9, 15))
        return _entries(F.transform(kept, X.mask_phone), "phone", house.contact_removed, "high", "Contact Information")

    def log(parts: Column) -> Column:
        return F.concat(one(parts), one(cut(F.array_join(parts, ""), R.PHONE_INTERNATIONAL)))

    def apply(parts: Column) -> Column:
        local = replaced(parts, lambda m: F.when(digit_count(m).between(9, 12), house.contact_removed).otherwise(m))
        return replace_each(local, R.PHONE_INTERNATIONAL, lambda m: F.when(digit_count(m).between(9, 15), house.contact_removed).otherwise(m))

    return _sharing("phone", lambda text: cut(text, R.PHONE_LOCAL), log, apply, _matching(R.SIX_DIGITS))


def contact_names(house: House) -> Step:
    """Names after hiring manager, recruiter or contact words."""

    def first(text: Column) -> Column:
        return F.regexp_replace(text, F.lit(X.regex(R.CONTACT_NAME)), F.lit(f"$1{_quoted(house.name_removed)}$3"))

    def both(text: Column) -> Column:
        return F.struct(X.all_matches(text, R.CONTACT_NAME, 2).alias("managers"), first(text).alias("text"))

    def log(found: Column) -> Column:
        managers = _entries(found["managers"], "hiring_manager", house.name_removed, "medium", "Contact Information")
        persons = _entries(X.all_matches(found["text"], R.CONTACT_PERSON, 2), "contact_person", house.name_removed, "high", "Contact Information")
        return F.concat(managers, persons)

    def apply(found: Column) -> Column:
        return F.regexp_replace(found["text"], F.lit(X.regex(R.CONTACT_PERSON)), F.lit(f"$1{_quoted(house.name_removed)}"))

    return _sharing("contact_name", both, log, apply, _worded([*R.PERSON_LABELS, *R.NAME_LABELS]), lambda text: text)


def references(house: House) -> Step:
    return _simple("internal_ref", R.INTERNAL_REFERENCE, house.reference_removed, "high", "Internal References", _worded(R.REFERENCE_LABELS))


def addresses(house: House) -> Step:
    return _simple("address", R.ADDRESS, house.location_removed, "medium", "Location Data", _matching(r"\d{4}"))


def registration_numbers(house: House) -> Step:
    numbered = _matching("[0-9/-]{6}")
    return _simple("sensitive_number", R.REGISTRATION, house.registration_removed, "high", "Sensitive Identifiers", lambda text, lower: X.has_any(text, R.REGISTRATION_SIGNS) & numbered(text, lower))


def id_numbers(house: House) -> Step:
    """13 digits, with or without the words before them: a bare one qualifies on its own."""
    return _simple("id_number", R.ID_NUMBER, house.id_removed, "high", "Sensitive Identifiers", _matching(r"\d{13}"))


def collapse_tokens(text: Column, house: House) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    for token in (house.contact_removed, house.reference_removed, house.link_removed):
        t = literal(token)
        out = F.regexp_replace(out, rf"{t}\s*{t}", _quoted(token))
    return X.trim_all(out)


def canonical_brand(house: House) -> Step:
    return _simple("branding", rf"(?i)\b{house.brand_spaced}\b", house.brand, "high", "Branding")


def ensure_instruction(house: House) -> Step:
    """Append the apply line when the contact token is nowhere in the text."""

    def absent(text: Column) -> Column:
        return ~F.lower(text).contains(house.contact.lower())

    def log(text: Column) -> Column:
        missing = F.when(absent(text), F.array(F.lit("No application method found"))).otherwise(F.array().cast("array<string>"))
        return _entries(missing, "added_instruction", f"Added: {house.apply}", "high", "Application Method")

    line = f"\n\nTo apply, please send your CV to {house.contact}"
    return Step("added_instruction", log, lambda text: F.when(absent(text), F.concat(text, F.lit(line))).otherwise(text))


def residual_names(text: Column, house: House, listed: Sequence[str] = ()) -> Column:
    """Capitalised names with a corporate ending that are neither listed nor a descriptor."""
    due = X.has_any(F.lower(text), R.ENDING_WORDS)
    found = _group_matches(text, R.RESIDUAL_NAMES, [due, due], 0)
    generic = rf"{R.GENERIC_WORDS}|{literal(house.brand.lower())}"
    kept = F.filter(found, lambda n: ~F.regexp_like(n, F.lit(generic)) & ~n.isin(list(listed) or [""]))
    return F.array_distinct(kept)


def standard_steps(house: House, known_roots: Sequence[str] = ()) -> tuple[list[Step], list[Step]]:
    """Steps before and after the name step, in their fixed order."""
    before = [confidential_blocks(house), emails(house), apply_links(house), apply_phrases(house), urls(house, known_roots)]
    after = [
        bare_domains(house, known_roots), phones(house), contact_names(house), references(house), addresses(house),
        registration_numbers(house), id_numbers(house),
    ]
    return before, after


def run_step(docs: DataFrame, column: str, step: Step) -> DataFrame:
    """Append the step's entries to ``log`` and replace the text; patterns run only on texts for which the step is due."""
    text, due = F.col(column), F.col("__due")
    if step.due is None:
        logged = docs.withColumn("log", F.concat("log", step.log(text)))
        return logged.withColumn(column, step.apply(text))
    seen = docs.withColumn("__text", X.without(text, MARK)).withColumn("__lower", F.lower("__text"))
    marked = seen.withColumn("__due", step.due(F.col("__text"), F.col("__lower"))).drop("__text", "__lower")
    given, log, apply = text, step.log, step.apply
    if step.shared is not None:
        # A column of its own, so that patterns run once for the log and the text.
        make, log, apply = step.shared
        marked, given = marked.withColumn("__shared", F.when(due, make(text))), F.col("__shared")
    logged = marked.withColumn("log", F.when(due, F.concat("log", log(given))).when(text.isNotNull(), F.col("log")))
    return logged.withColumn(column, F.when(due, apply(given)).otherwise(step.idle(text))).drop("__due", "__shared")


def redact(docs: DataFrame, column: str, step: Step) -> DataFrame:
    """One step on its own: documents with changed text and the step's ``log``."""
    return run_step(docs.withColumn("log", F.array().cast(LOG_TYPE)), column, step)


def redact_names(docs: DataFrame, key: str, column: str, names: DataFrame, house: House) -> DataFrame:
    """Dictionary, declared and unknown names to their descriptors; appends to ``log``.

    Only a document's own mentions travel back to it, whatever the size of the dictionary.
    """
    known = with_known_mentions(docs, key, column, names)
    marked = known.withColumns({"__declared": declared_mentions(F.col(column), house), "__unknown": unknown_mentions(F.col(column), house)})
    # Columns of their own, so that no pattern runs again for every name it is compared with.
    marked = marked.withColumn("__some", new_mentions(F.col("__known"), F.col("__declared")))
    marked = marked.withColumn("__mentions", new_mentions(F.col("__some"), F.col("__unknown"), contained=True)).drop("__known", "__declared", "__unknown", "__some")
    return apply_mentions(marked, column, F.col("__mentions")).drop("__mentions")


def sanitise_documents(
    docs: DataFrame, key: str, column: str, names: DataFrame, house: House, review: Callable[[DataFrame, str], DataFrame] | None = None
) -> DataFrame:
    """The whole ordered pipeline: text, ``log`` and ``residual`` names per document."""
    before, after = standard_steps(house)
    out = docs.withColumn("log", F.array().cast(LOG_TYPE))
    for step in before:
        out = run_step(out, column, step)
    out = redact_names(out, key, column, names, house)
    for step in after:
        out = run_step(out, column, step)
    out = out.withColumn(column, collapse_tokens(F.col(column), house))
    out = run_step(out, column, canonical_brand(house))
    if review is not None:
        out = review(out, column)
    out = run_step(out, column, ensure_instruction(house))
    # Generated rows: the planner can't copy the whole rule chain into a filter on the result, once for every use of a text.
    out = out.select(F.inline(F.array(F.struct(*[F.col(c) for c in out.columns]))))
    return out.withColumn("residual", residual_names(F.col(column), house))


def redaction_log(sanitised: DataFrame, key: str) -> DataFrame:
    """One row per log entry.

    The outer form keeps the planner from copying the whole rule chain into an "array is not
    empty" filter below the projections; documents without entries drop out afterwards.
    """
    rows = sanitised.select(key, F.posexplode_outer("log").alias("position", "e"))
    return rows.filter(F.col("e").isNotNull()).select(key, "position", "e.*")


LOG_TYPES = ["company_name", "email", "phone", "apply_link", "apply_phrase", "url", "bare_domain", "internal_ref",
             "confidential_section", "address", "sensitive_number", "id_number", "hiring_manager", "contact_person"]


def redaction_stats(log: DataFrame, key: str) -> DataFrame:
    """Items removed per document and type, with the total."""
    sums = [F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(t) for t in LOG_TYPES]
    total = F.coalesce(F.sum(F.when(F.col("type").isin(LOG_TYPES), F.col("n"))), F.lit(0)).alias("total")
    return log.groupBy(key).agg(*sums, total)


def redaction_summary(log: DataFrame, key: str) -> DataFrame:
    """Distinct categories (a fixed handful) and entries by confidence."""
    return log.groupBy(key).agg(
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.count_if(F.col("confidence") == "high").alias("high"),
        F.count_if(F.col("confidence") == "medium").alias("medium"),
    )


def redaction_leaks(before: DataFrame, after: DataFrame, key: str, column: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Matches of the original text that are still in the redacted one, in any letter case."""
    original = before.select(key, X.all_matches(F.col(column), pattern).alias("__found"))
    joined = after.join(original, key)
    left = F.filter(
        F.array_distinct(F.transform("__found", F.lower)), lambda m: F.lower(F.col(column)).contains(m) & ~_contains_any(m, keep)
    )
    return joined.select(key, F.explode_outer(left).alias("leak")).filter(F.col("leak").isNotNull())
