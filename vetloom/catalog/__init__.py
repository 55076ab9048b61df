"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from importlib import import_module

SECTIONS = (
    "scalars", "projections", "predicates", "joins", "scoring", "windows", "sets", "review", "redaction", "records", "rules", "streams",
)


def load_all() -> None:
    """Import every section so its queries are registered."""
    for section in SECTIONS:
        import_module(f"vetloom.catalog.{section}")
