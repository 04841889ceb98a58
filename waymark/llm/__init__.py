"""Operators for preparing training data, each with the query that applies it to a whole table."""
