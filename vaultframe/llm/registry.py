"""Queries of this subpackage and their SQL."""

from vaultframe.llm import byte_repeats, decontaminate, html_text, near_text, near_vectors, packing, preferences, quality, secrets, word_repeats

MODULES = (secrets, near_text, near_vectors, word_repeats, html_text, packing, decontaminate, preferences, byte_repeats, quality)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
