"""Operators for building text training data. Nothing outside this subpackage imports it."""
