"""Logical plans: tables and the builder that turns a QuerySpec into DataFrame operations."""
