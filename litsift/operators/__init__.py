"""Relational operators: filters, extraction, lookup joins, dedup, scoring, ranking."""
