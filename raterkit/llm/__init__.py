"""Operators for preparing text and vector corpora, their queries and their SQL."""
