"""Operators for preparing training text, each usable alone on any DataFrame of documents."""
