"""Operators over entry logs, change feeds, manifests and value logs."""
