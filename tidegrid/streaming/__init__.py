"""Surveys that arrive over time."""
