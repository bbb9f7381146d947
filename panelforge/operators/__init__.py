"""Relational operators on panels and ensembles."""
