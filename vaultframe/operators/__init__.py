"""Operators over archive relations."""
