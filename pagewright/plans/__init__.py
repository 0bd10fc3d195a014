"""Whole plans: the document report and the catalogue of queries."""
