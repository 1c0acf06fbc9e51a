"""Queries over the tables, their SQL, and command lines."""
