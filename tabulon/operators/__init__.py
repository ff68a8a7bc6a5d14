"""Relational operators whose semantics go beyond one DataFrame call."""
