"""Operators of a training-data pipeline: scans, filters, deduplication, decontamination, tokens, archives."""
