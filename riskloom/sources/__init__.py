"""Readers: manifests, installed packages, registry and advisory feeds, version-control history, policies."""
