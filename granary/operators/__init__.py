"""Relational operators: projections, filters, joins, aggregation, windows, sorts, sets, merges."""
