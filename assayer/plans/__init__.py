"""Assayer: plans."""
