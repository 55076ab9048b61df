"""Redaction steps, the pipeline, and reports on its log."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from vetloom.catalog.registry import SQL_VIEWS, query
from vetloom.catalog.review import LEGACY, bare, q, review_ctes, sql_cut, sql_each, sql_list
from vetloom.functions import patterns as R
from vetloom.functions.phrases import literal
from vetloom.operators import mentions as M
from vetloom.operators import redaction as D
from vetloom.operators import review as V
from vetloom.operators import windows as W
from vetloom.plans.spread import spread

HOUSE = D.House(
    industries=(
        (("retail", "store"), "National retailer"),
        (("ledger", "finance"), "Financial services provider"),
        (("machinery", "automobile"), "Manufacturer"),
    )
)
SQL_VIEWS["texts_v"] = """select doc_id, text from briefs_v union all select doc_id + 1000000000, text from documents
    union all select page_id + 2000000000, 'Visit ' || url || ' or the next page' from pages"""


def texts(t):
    """Briefs, documents and page links in one table."""
    more = spread(t.documents).select((F.col("doc_id") + 1000000000).alias("doc_id"), "text")
    links = spread(t.pages).select((F.col("page_id") + 2000000000).alias("doc_id"), F.concat(F.lit("Visit "), "url", F.lit(" or the next page")).alias("text"))
    return t.briefs_v.unionByName(more).unionByName(links)


# ---- the checker's side of every step: (log entries, changed text) over a text expression ----------

def s_matches(text: str, pattern: str) -> str:
    return f"list_filter({sql_cut(text, pattern)}, lambda p, i: i % 2 = 0)"


def s_entries(found: str, kind: str, replacement: str, confidence: str) -> str:
    """``replacement`` is an expression over the match ``x``."""
    return (
        f"list_transform(list_distinct({found}), lambda x: '{kind}|' || x || '|' || cast(len(list_filter({found}, lambda y: y = x)) as varchar) "
        f"|| '|' || {replacement} || '|{confidence}')"
    )


def s_contains(text: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def s_simple(kind, pattern, token, confidence):
    def build(text: str) -> tuple[str, str]:
        return s_entries(s_matches(text, pattern), kind, f"'{token}'", confidence), f"regexp_replace({text}, '{q(pattern)}', '{token}', 'g')"

    return build


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def s_confidential(text: str) -> tuple[str, str]:
    begins = rf"starts_with(lower(ltrim(l)), h) and not regexp_matches(substr(lower(ltrim(l)), length(h) + 1, 1), '\w')"
    ends = f"trim(l, ' ' || chr(9) || chr(13)) = '' or len(list_filter({sql_list(R.BRIEF_HEADINGS)}, lambda h: {begins})) > 0"
    line = f"""case when list_contains({sql_list(R.CONFIDENTIAL_HEADINGS)}, regexp_replace({bare('l')}, 's$', '')) then chr(1) || 'H' || l when {ends} then chr(1) || 'E' || l else l end"""
    pieces = f"string_split('E' || array_to_string(list_transform(string_split(replace({text}, chr(1), ''), chr(10)), lambda l: {line}), chr(10)), chr(1))"
    found = f"list_transform(list_filter({pieces}, lambda p: p like 'H%'), lambda p: {_STRIP.format('substr(p, 2)')})"
    kept = f"array_to_string(list_transform(list_filter({pieces}, lambda p: p like 'E%'), lambda p: substr(p, 2)), '')"
    return s_entries(found, "confidential_section", "'[Internal section removed]'", "high"), kept


_KEEP = [HOUSE.own, *HOUSE.keep]


def s_emails(text: str) -> tuple[str, str]:
    found = f"list_transform(list_filter({s_matches(text, R.EMAIL)}, lambda m: not {s_contains('m', _KEEP)}), lambda m: lower(m))"
    return s_entries(found, "email", f"'{HOUSE.contact}'", "high"), sql_each(text, R.EMAIL, f"case when {s_contains('p', _KEEP)} then p else '{HOUSE.contact}' end")


def s_phrases(text: str) -> tuple[str, str]:
    own = [HOUSE.own]
    found = f"list_transform(list_filter({s_matches(text, R.APPLY_PHRASE)}, lambda m: not {s_contains('m', own)}), lambda m: {_STRIP.format('m')})"
    return s_entries(found, "apply_phrase", f"'{HOUSE.apply}'", "medium"), sql_each(text, R.APPLY_PHRASE, f"case when {s_contains('p', own)} then p else '{HOUSE.apply}' end")


def _url_verdict(m: str) -> str:
    return (
        f"case when {s_contains(m, [HOUSE.own])} then null when regexp_matches({m}, '{R.APPLY_URL}') then '{HOUSE.contact}' "
        rf"when regexp_matches({m}, '(?i)https?://|www\.|\.(?:co\.za|com|io|net|org)\b') and length({m}) > 8 then '{HOUSE.link_removed}' end"
    )


def s_urls(text: str) -> tuple[str, str]:
    found = f"list_transform(list_filter({s_matches(text, R.URL)}, lambda m: ({_url_verdict('m')}) is not null), lambda m: lower(m))"
    return s_entries(found, "url", f"({_url_verdict('x')})", "medium"), sql_each(text, R.URL, f"coalesce({_url_verdict('p')}, p)")


def s_domains(text: str) -> tuple[str, str]:
    parts = sql_cut(text, R.BARE_DOMAIN)
    around = f"right(({parts})[i - 1], 30) || ' ' || left(({parts})[i + 1], 40)"
    goes = f"(i % 2 = 0 and not {s_contains('p', [*R.COMMON_HOSTS, HOUSE.own])} and regexp_matches(p, '{R.PLAIN_DOMAIN}') and regexp_matches({around}, '{R.DOMAIN_CONTEXT}'))"
    found = f"list_filter(list_transform({parts}, lambda p, i: case when {goes} then lower(p) end), lambda m: m is not null)"
    changed = f"array_to_string(list_transform({parts}, lambda p, i: case when {goes} then '{HOUSE.link_removed}' else p end), '')"
    return s_entries(found, "bare_domain", f"'{HOUSE.link_removed}'", "medium"), changed


_DIGITS = r"length(regexp_replace({}, '\D', '', 'g'))"
_MASK = r"(substr(regexp_replace(m, '\D', '', 'g'), 1, 3) || '***' || right(regexp_replace(m, '\D', '', 'g'), 2))"


def s_phones(text: str) -> tuple[str, str]:
    def one(pattern: str) -> str:
        kept = f"list_filter(list_distinct(list_transform({s_matches(text, pattern)}, lambda m: {_STRIP.format('m')})), lambda m: {_DIGITS.format('m')} between 9 and 15)"
        return s_entries(f"list_transform({kept}, lambda m: {_MASK})", "phone", f"'{HOUSE.contact_removed}'", "high")

    local = sql_each(text, R.PHONE_LOCAL, f"case when {_DIGITS.format('p')} between 9 and 12 then '{HOUSE.contact_removed}' else p end")
    both = sql_each(local, R.PHONE_INTERNATIONAL, f"case when {_DIGITS.format('p')} between 9 and 15 then '{HOUSE.contact_removed}' else p end")
    return f"list_concat({one(R.PHONE_LOCAL)}, {one(R.PHONE_INTERNATIONAL)})", both


def s_contacts(text: str) -> tuple[str, str]:
    first = rf"regexp_replace({text}, '{R.CONTACT_NAME}', '\1{HOUSE.name_removed}\3', 'g')"
    managers = s_entries(f"regexp_extract_all({text}, '{R.CONTACT_NAME}', 2)", "hiring_manager", f"'{HOUSE.name_removed}'", "medium")
    persons = s_entries(f"regexp_extract_all({first}, '{R.CONTACT_PERSON}', 2)", "contact_person", f"'{HOUSE.name_removed}'", "high")
    return f"list_concat({managers}, {persons})", rf"regexp_replace({first}, '{R.CONTACT_PERSON}', '\1{HOUSE.name_removed}', 'g')"


def s_instruction(text: str) -> tuple[str, str]:
    absent = f"not contains(lower({text}), '{HOUSE.contact.lower()}')"
    entry = f"case when {absent} then ['added_instruction|No application method found|1|Added: {HOUSE.apply}|high'] else cast([] as varchar[]) end"
    return entry, f"case when {absent} then {text} || chr(10) || chr(10) || 'To apply, please send your CV to {HOUSE.contact}' else {text} end"


SQL_STEPS = {
    "redact_confidential_blocks": (D.confidential_blocks, s_confidential),
    "redact_emails": (D.emails, s_emails),
    "redact_apply_links": (D.apply_links, s_simple("apply_link", R.APPLY_LINK, HOUSE.apply, "high")),
    "redact_apply_phrases": (D.apply_phrases, s_phrases),
    "redact_urls": (D.urls, s_urls),
    "redact_bare_domains": (D.bare_domains, s_domains),
    "redact_phones": (D.phones, s_phones),
    "redact_contact_names": (D.contact_names, s_contacts),
    "redact_references": (D.references, s_simple("internal_ref", R.INTERNAL_REFERENCE, HOUSE.reference_removed, "high")),
    "redact_addresses": (D.addresses, s_simple("address", R.ADDRESS, HOUSE.location_removed, "medium")),
    "redact_registration_numbers": (D.registration_numbers, s_simple("sensitive_number", R.REGISTRATION, HOUSE.registration_removed, "high")),
    "redact_id_numbers": (D.id_numbers, s_simple("id_number", R.ID_NUMBER, HOUSE.id_removed, "high")),
    "canonical_brand": (D.canonical_brand, s_simple("branding", rf"(?i)\b{HOUSE.brand_spaced}\b", HOUSE.brand, "high")),
    "ensure_instruction": (D.ensure_instruction, s_instruction),
}


def shown(df, *more):
    """Log entries as one sorted text beside the changed document."""
    entry = F.transform("log", lambda e: F.concat_ws("|", e["type"], e["match"], e["n"].cast("string"), e["replacement"], e["confidence"]))
    return df.select("doc_id", "text", F.array_join(F.array_sort(entry), ";").alias("log"), *more)


def _register(name: str) -> None:
    step, sql = SQL_STEPS[name]
    entries, changed = sql("text")

    @query(name, f"select doc_id, {changed} as text, array_to_string(list_sort({entries}), ';') as log from texts_v")
    def _(t):
        return shown(D.redact(texts(t), "text", step(HOUSE)))


for _name in SQL_STEPS:
    _register(_name)


# ---- names -----------------------------------------------------------------------------------------

_INDUSTRY = "case " + " ".join(f"when regexp_matches(lower({{0}}), '{'|'.join(k)}') then '{d}'" for k, d in HOUSE.industries) + f" else '{HOUSE.default_descriptor}' end"
_GROUPS = lambda patterns, g=1: "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(text, '{q(p)}', {g}), lambda m: {_STRIP.format('m')})" for p in patterns) + ")"


def _first_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda m, i: list_position({expr}, m) = i)"


def _struct(names: str) -> str:
    return f"list_transform({names}, lambda n: {{'mention': n, 'descriptor': {_INDUSTRY.format(chr(40) + 'text || chr(32) || n' + chr(41))}, 'confidence': 'medium'}})"


_NONE = "cast([] as struct(mention varchar, descriptor varchar, confidence varchar)[])"
_DECLARED = f"""coalesce({_struct(rf"list_filter({_first_distinct(_GROUPS(R.DECLARED_NAME))}, lambda n: length(n) between 3 and 80 and not regexp_matches(n, '{R.GENERIC_WORDS}') "
    rf"and not regexp_matches(n, '{R.ROLE_WORDS_DECLARED}') and len(regexp_split_to_array(n, '\s+')) <= 6)")}, {_NONE})"""
_UNKNOWN = f"""coalesce({_struct(rf"list_filter({_first_distinct(_GROUPS(R.UNKNOWN_NAME))}, lambda n: length(n) between 3 and 60 and not regexp_matches(n, '{R.GENERIC_WORDS}|northstar') "
    rf"and not regexp_matches(n, '{R.ROLE_WORDS_UNKNOWN}'))")}, {_NONE})"""
_TAIL = "|".join(literal(e) for e in M.CORPORATE_ENDINGS)
_PATTERN = rf"""pat as (select '(?i)\b(' || string_agg(name, '|' order by length(name) desc, name) || ')({q(_TAIL)})?\b' as pat, map_from_entries(list((lower(name), descriptor))) as dict from names_v)"""
_KNOWN_RAW = """list_transform(range(1, len(regexp_extract_all(text, pat, 0)) + 1), lambda i: {'mention': regexp_extract_all(text, pat, 0)[i],
    'descriptor': dict[lower(regexp_extract_all(text, pat, 1)[i])], 'confidence': 'high'})"""
_KNOWN = f"coalesce({_first_distinct(_KNOWN_RAW)}, {_NONE})"


def name_ctes(source: str, mentions: str, tag: str) -> str:
    """CTEs that find mentions in ``source`` and end in ``{tag}`` with changed text and a longer log."""
    ordered = "list_transform(list_sort(list_transform(ms, lambda m, i: {'size': -length(m.mention), 'i': i, 'm': m})), lambda k: k.m)"
    pat = r"('(?i)\b' || regexp_escape(m.mention) || '\b')"
    return rf"""{tag}_m as materialized (select {source}.*, {mentions} as ms from {source}, pat),
    {tag}_o as materialized (select *, {ordered} as os from {tag}_m),
    {tag}_r as materialized (select *, list_reduce(list_transform(os, lambda m: {{'text': m.mention, 'log': cast([m.descriptor, m.confidence] as varchar[])}}),
      lambda s, e: {{'text': regexp_replace(s.text, '(?i)\b' || regexp_escape(e.text) || '\b', e.log[1], 'g'), 'log': case when len(regexp_extract_all(s.text, '(?i)\b' || regexp_escape(e.text) || '\b')) > 0
        then list_append(s.log, 'company_name|' || e.text || '|' || cast(len(regexp_extract_all(s.text, '(?i)\b' || regexp_escape(e.text) || '\b')) as varchar) || '|' || e.log[1] || '|' || e.log[2]) else s.log end}},
      {{'text': text, 'log': log}}) as done from {tag}_o),
    {tag} as materialized (select doc_id, done.text as text, done.log as log from {tag}_r)"""


_NEW = "list_concat({0}, list_filter({1}, lambda c: len(list_filter({0}, lambda f: {2})) = 0))"
_SAME = "lower(f.mention) = lower(c.mention)"
_INSIDE = "contains(lower(f.mention), lower(c.mention)) or contains(lower(c.mention), lower(f.mention))"


def _names_sql(mentions: str) -> str:
    return f"""with {_PATTERN}, src as (select doc_id, text, cast([] as varchar[]) as log from texts_v),
    {name_ctes('src', mentions, 'nm')} select doc_id, text, array_to_string(list_sort(log), ';') as log from nm"""


def _with_mentions(t, mentions):
    docs = texts(t).withColumn("log", F.array().cast(D.LOG_TYPE)).withColumn("__m", mentions)
    return shown(M.apply_mentions(docs, "text", F.col("__m")))


@query("redact_dictionary_names", _names_sql(_KNOWN))
def _(t):
    docs = D.with_known_mentions(texts(t).withColumn("log", F.array().cast(D.LOG_TYPE)), "doc_id", "text", t.names_v)
    return shown(M.apply_mentions(docs, "text", F.col("__known")))


@query("redact_declared_names", _names_sql(_DECLARED))
def _(t):
    return _with_mentions(t, D.declared_mentions(F.col("text"), HOUSE))


@query("redact_unknown_names", _names_sql(_UNKNOWN))
def _(t):
    return _with_mentions(t, D.unknown_mentions(F.col("text"), HOUSE))


@query("infer_industry", f"select doc_id, {_INDUSTRY.format('text')} as descriptor from texts_v")
def _(t):
    return texts(t).select("doc_id", D.infer_industry(F.col("text"), HOUSE.industries, HOUSE.default_descriptor).alias("descriptor"))


def _collapsed(text: str) -> str:
    out = rf"regexp_replace(regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"
    for token in (HOUSE.contact_removed, HOUSE.reference_removed, HOUSE.link_removed):
        t = literal(token)
        out = rf"regexp_replace({out}, '{t}\s*{t}', '{token}', 'g')"
    return _STRIP.format(out)


_DOUBLED = "replace(replace(text, ' or ', ' [Link removed]  [Link removed] '), chr(10), chr(10) || chr(10) || chr(10))"


@query("collapse_tokens", f"select doc_id, {_collapsed(_DOUBLED)} as text from texts_v")
def _(t):
    doubled = F.replace(F.replace("text", F.lit(" or "), F.lit(" [Link removed]  [Link removed] ")), F.lit("\n"), F.lit("\n\n\n"))
    return texts(t).select("doc_id", D.collapse_tokens(doubled, HOUSE).alias("text"))


_RESIDUAL = f"""list_filter({_first_distinct(_GROUPS(R.RESIDUAL_NAMES, 0))}, lambda n: not regexp_matches(n, '{R.GENERIC_WORDS}|northstar'))"""


@query("residual_names", f"select doc_id, array_to_string({_RESIDUAL}, '|') as names, len({_RESIDUAL}) > 0 as flagged from texts_v")
def _(t):
    found = texts(t).select("doc_id", D.residual_names(F.col("text"), HOUSE).alias("found"))
    return found.select("doc_id", F.array_join("found", "|").alias("names"), (F.size("found") > 0).alias("flagged"))


# ---- the pipeline ------------------------------------------------------------------------------------

def all_names(source: str) -> list[str]:
    """The CTEs of the name step over ``source``; the last one is ``nm``."""
    return [
        f"nk as materialized (select {source}.*, {_KNOWN} as k, {_DECLARED} as d, {_UNKNOWN} as u from {source}, pat)",
        f"nd as materialized (select * exclude (k, d), {_NEW.format('k', 'd', _SAME)} as kd from nk)",
        f"na as materialized (select doc_id, text, log, {_NEW.format('kd', 'u', _INSIDE)} as found from nd)",
        name_ctes("na", "na.found", "nm").replace("na.*", "na.doc_id, na.text, na.log"),
    ]


def pipeline_ctes() -> str:
    ctes, last = [_PATTERN, "p0 as (select doc_id, text, cast([] as varchar[]) as log from texts_v)"], "p0"

    def add(name: str) -> None:
        nonlocal last
        entries, changed = SQL_STEPS[name][1]("text")
        tag = f"p{len(ctes)}"
        ctes.append(f"{tag} as materialized (select doc_id, {changed} as text, list_concat(log, {entries}) as log from {last})")
        last = tag

    order = list(SQL_STEPS)
    for name in order[:5]:
        add(name)
    ctes += all_names(last)
    last = "nm"
    for name in order[5:12]:
        add(name)
    ctes.append(f"pc as materialized (select doc_id, {_collapsed('text')} as text, log from {last})")
    last = "pc"
    add("canonical_brand")
    chain, end = review_ctes(last)
    ctes.append(chain)
    last = end
    add("ensure_instruction")
    ctes.append(f"sanitised as (select doc_id, text, log, {_RESIDUAL} as residual from {last})")
    return ",\n".join(ctes)


def sanitised(t):
    review = partial(V.review_text, legacy=LEGACY)
    return D.sanitise_documents(texts(t), "doc_id", "text", t.names_v, HOUSE, review=lambda df, c: review(df, c))


@query("sanitise_documents", f"with {pipeline_ctes()} select doc_id, text, array_to_string(list_sort(log), ';') as log, array_to_string(residual, '|') as residual from sanitised")
def _(t):
    return shown(sanitised(t), F.array_join("residual", "|").alias("residual"))


_LOG = f"{pipeline_ctes()}, entries as (select doc_id, string_split(e, '|') as e from (select doc_id, unnest(log) as e from sanitised) x)"
_COUNTS = ", ".join(f"cast(coalesce(sum(case when e[1] = '{t}' then cast(e[3] as int) end), 0) as bigint) as {t}" for t in D.LOG_TYPES)
_LISTED = ", ".join(f"'{t}'" for t in D.LOG_TYPES)


@query("redaction_stats", f"with {_LOG} select doc_id, {_COUNTS}, cast(coalesce(sum(case when e[1] in ({_LISTED}) then cast(e[3] as int) end), 0) as bigint) as total from entries group by 1")
def _(t):
    return D.redaction_stats(D.redaction_log(sanitised(t), "doc_id"), "doc_id")


_CATEGORY = f"""case when e[1] in ('email', 'phone', 'hiring_manager', 'contact_person') then 'Contact Information' when e[1] in ('apply_link', 'apply_phrase') then 'Application Links'
    when e[1] = 'url' then case when e[4] = '{HOUSE.contact}' then 'Application Links' else 'External Links' end when e[1] = 'bare_domain' then 'External Links' when e[1] = 'company_name' then 'Client Identity'
    when e[1] = 'internal_ref' then 'Internal References' when e[1] = 'confidential_section' then 'Confidential Notes' when e[1] = 'address' then 'Location Data'
    when e[1] in ('sensitive_number', 'id_number') then 'Sensitive Identifiers' when e[1] = 'branding' then 'Branding' else 'Application Method' end"""


@query(
    "redaction_summary",
    f"""with {_LOG} select doc_id, array_to_string(list_sort(list(distinct {_CATEGORY})), '|') as categories, count(*) filter (e[5] = 'high') as high,
    count(*) filter (e[5] = 'medium') as medium from entries group by 1""",
)
def _(t):
    summary = D.redaction_summary(D.redaction_log(sanitised(t), "doc_id"), "doc_id")
    return summary.withColumn("categories", F.array_join("categories", "|"))


@query(
    "top_per_category",
    f"""with {_LOG}, c as (select doc_id, e[2] as match, {_CATEGORY} as category from entries)
    select category, doc_id, match, row_number() over (partition by category order by doc_id, match) as position, count(*) over (partition by category) as total from c qualify position <= 5""",
)
def _(t):
    log = D.redaction_log(sanitised(t), "doc_id").select("doc_id", "match", "category")
    return W.top_per_category(log, "category", ["doc_id", "match"]).select("category", "doc_id", "match", "position", "total")


@query(
    "redaction_leaks",
    f"""with o as (select doc_id, text, list_distinct(list_transform(regexp_extract_all(text, '{q(R.EMAIL)}'), lambda m: lower(m))) as found from texts_v)
    select doc_id, unnest(list_filter(found, lambda m: contains(lower({s_emails('text')[1]}), m))) as leak from o""",
)
def _(t):
    docs = texts(t)
    after = D.redact(docs, "text", D.emails(HOUSE)).drop("log")
    return D.redaction_leaks(docs, after, "doc_id", "text", R.EMAIL)
