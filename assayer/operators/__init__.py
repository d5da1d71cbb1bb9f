"""Assayer: operators."""
