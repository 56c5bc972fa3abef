"""Continuous forms of batch operators."""
