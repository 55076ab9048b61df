"""Candidate records, one nested row per customer, from one description for both engines."""

from __future__ import annotations

_K = "cast(c_custkey as string)"
_MONTHS = "'January', 'March', 'May', 'July', 'September', 'November'"


def _pick(n: str, values: str, count: int) -> str:
    whens = " ".join(f"when {i} then {v.strip()}" for i, v in enumerate(values.split(",")))
    return f"case ({n}) % {count} {whens} end"


def _span(offset: int, dash: str = "–", closing: str = "end") -> str:
    """A date range whose months and years follow the customer key."""
    start = f"{_pick(f'c_custkey + {offset}', _MONTHS, 6)} || ' ' || cast(2016 - {offset} * 3 + c_custkey % 3 as string)"
    end = f"{_pick(f'c_custkey + {offset} + 2', _MONTHS, 6)} || ' ' || cast(2017 - {offset} * 3 + c_custkey % 5 as string)"
    close = f"case when c_custkey % 3 = {offset} then 'Present' else {end} end" if closing == "open" else end
    return f"{start} || case when c_custkey % 11 = {offset} then ' - ' else ' {dash} ' end || {close}"


def _role(offset: int) -> dict:
    return {
        "employer": f"case when c_custkey % 7 = {offset} then '' else {_pick(f'c_custkey + {offset}', repr('Borealis Bank Group') + ',' + repr('Foschini (TFG) Ltd') + ',' + repr('Delta Mining'), 3)} end",
        "duration": _span(offset, closing="open" if offset == 0 else "end"),
        "alias": f"case when c_custkey % 2 = {offset} then 'Large employer {offset}' else '' end",
        "context": f"case when c_custkey % 4 = {offset} then 'A lender that serves shops' else 'A firm.' end",
        "reasonForLeaving": "'growth at Borealis'" if offset else "''",
        "titles": [
            {"title": f"case when c_custkey % 5 = {offset} then 'SENIOR CLERK' else 'Clerk ' || c_mktsegment end", "duration": _span(offset, closing="open" if offset == 0 else "end")},
            {"title": "'Junior clerk'", "duration": f"case when c_custkey % 6 = 1 then '' else {_span(offset + 1)} end"},
        ],
        "responsibilities": [
            f"case when c_custkey % 3 = 0 then 'responsible for the {offset} ledger at TFG.' else 'Kept the {offset} ledger' end",
            "case when c_custkey % 8 = 2 then 'Kept the 0 ledger' else ' checked invoices; ' end",
        ],
        "achievements": ["case when c_custkey % 9 = 4 then 'Call 082 555 1234 or a@b.co' else 'Saved money' end"],
    }


SPEC: dict = {
    "record_id": "c_custkey",
    "meta": {
        "targetRole": "case c_custkey % 6 when 0 then '' when 1 then 'LEDGER CLERK' else 'Ledger clerk' end",
        "mode": "case when c_custkey % 4 = 1 then 'direct' else 'agency' end",
        "reference": f"case when c_custkey % 3 = 0 then '' else 'REF' || {_K} end",
        "fileName": "case when c_custkey % 5 = 0 then '' else 'record' end",
    },
    "personal": {
        "fullName": "case when c_custkey % 13 = 0 then '' else 'Anna Maria Steyn' end",
        "citizenship": "n_name",
        "languages": "case when c_custkey % 5 = 2 then '' else 'English' end",
        "dateOfBirth": f"cast(c_custkey % 28 + 1 as string) || ' ' || {_pick('c_custkey', _MONTHS, 6)} || ' ' || cast(1960 + c_custkey % 40 as string)",
        "areaOfResidence": "case when c_custkey % 7 = 3 then '12 Long Street, Harbour' else 'Harbour, ' || n_name end",
        "areaAlias": "case when c_custkey % 2 = 0 then 'Coast' else '' end",
        "availability": "case when c_custkey % 9 = 0 then '' else 'One month' end",
        "email": f"case when c_custkey % 3 = 1 then 'c' || {_K} || '@mail.org' when c_custkey % 3 = 2 then 'not an address' else '' end",
        "phone": "case when c_custkey % 6 = 1 then '082 555 1234' when c_custkey % 6 = 2 then '12' else '' end",
    },
    "consultant": {"contactPerson": "case when c_custkey % 10 = 0 then '' else 'Pat' end", "emailAddress": "'pat@agency.org'"},
    "professionalSummary": [
        "'Careful clerk who knows Foschini.'", "case when c_custkey % 4 = 0 then 'keeps books' else 'Keeps books.' end",
        "'Reads ledgers.'", "case when c_custkey % 6 = 5 then null else 'Writes notes.' end",
    ],
    "qualifications": [
        {"year": "case when c_custkey % 4 = 0 then '09' else '2009' end", "name": "'Accounts certificate'", "institution": "'SAS Institute'", "institutionAlias": "''"},
        {"year": "case when c_custkey % 5 = 1 then '' else '2011' end", "name": "case when c_custkey % 8 = 0 then '' else 'Diploma' end", "institution": "'Harbour College'", "institutionAlias": "'A college'"},
    ],
    "technicalSkills": [
        {"group": "'Tools'", "items": ["'SAS'", "'Excel.'", "case when c_custkey % 2 = 0 then 'excel.' else 'SQL' end"]},
        {"group": "''", "items": ["case when c_custkey % 3 = 0 then 'A very long capability chip that wraps badly' else c_mktsegment end"]},
    ],
    "experience": [_role(0), _role(1)],
    "earlyCareer": [{"title": "'Packer'", "employer": "'Corner Shop'", "duration": "'2001'", "alias": "''"}],
    "redact": {
        "candidateName": "c_custkey % 3 = 0", "dateOfBirth": "c_custkey % 4 < 2", "areaOfResidence": "c_custkey % 5 < 2",
        "employerNames": "c_custkey % 2 = 0", "institutions": "c_custkey % 3 < 2", "dates": "c_custkey % 6 < 2", "qualificationYears": "c_custkey % 7 < 3",
    },
}
NULL_DROPPED = "professionalSummary"


def _render(node, dialect: str) -> str:
    if isinstance(node, dict):
        if dialect == "spark":
            return "named_struct(" + ", ".join(f"'{k}', {_render(v, dialect)}" for k, v in node.items()) + ")"
        return "{" + ", ".join(f"'{k}': {_render(v, dialect)}" for k, v in node.items()) + "}"
    if isinstance(node, list):
        inner = ", ".join(_render(v, dialect) for v in node)
        return f"array({inner})" if dialect == "spark" else f"[{inner}]"
    return node


def _columns(dialect: str) -> str:
    out = []
    for name, node in SPEC.items():
        text = _render(node, dialect)
        if name == NULL_DROPPED:
            text = f"filter({text}, x -> x is not null)" if dialect == "spark" else f"list_filter({text}, lambda x: x is not null)"
        out.append(f"{text} as {name}")
    return ", ".join(out)


def spark_sql() -> str:
    return f"select {_columns('spark')} from {{customer}} join {{nation}} on c_nationkey = n_nationkey"


def duckdb_sql() -> str:
    return f"select {_columns('duckdb')} from customer join nation on c_nationkey = n_nationkey"
