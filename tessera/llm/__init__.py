"""Operators for corpora of text. Nothing outside this subpackage imports it."""
