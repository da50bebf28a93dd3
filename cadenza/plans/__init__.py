"""Canonical tables and the queries over them."""
