"""Queries over whole tables, put together from the operators."""
