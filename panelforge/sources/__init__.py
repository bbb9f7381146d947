"""Readers and writers for panels, ensembles, reference tables and fitted pipelines."""
