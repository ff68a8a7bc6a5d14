"""Streaming form of the stateless part of the language."""
