"""Assayer: sources."""
