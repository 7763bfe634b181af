"""Compositions of operators (triage, recent papers), driver bindings and the query registry."""
