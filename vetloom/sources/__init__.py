"""Readers, declared schemas and the derived input views."""
