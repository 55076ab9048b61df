"""Vetloom: assessment scoring, document redaction and candidate records as Spark jobs."""
