"""Operators for text corpora: scoring, filtering, de-duplication, tokenising."""
