"""Queries composed from the operators, and SQL that gives the same rows."""
