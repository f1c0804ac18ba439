"""Operators that prepare a text corpus for language models."""
