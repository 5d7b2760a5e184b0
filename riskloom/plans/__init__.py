"""Whole runs (scan, check, diff, history) and the registered queries."""
