"""Assayer: streaming."""
