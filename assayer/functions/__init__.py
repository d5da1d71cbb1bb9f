"""Assayer: functions."""
