"""Queries over the tables at hand, built from the operators."""
