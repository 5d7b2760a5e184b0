"""Relational operators over packages, findings, links, edges and snapshots."""
