"""Citeloom: a PySpark engine for bibliographic and document corpora."""
