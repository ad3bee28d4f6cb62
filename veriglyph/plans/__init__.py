"""Analyses of datasets, and the registered queries."""
