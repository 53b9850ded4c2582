"""Queries over the given tables, with SQL twins where SQL can say the same."""
