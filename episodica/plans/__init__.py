"""Queries over the tables, each with the SQL that must agree with it."""
