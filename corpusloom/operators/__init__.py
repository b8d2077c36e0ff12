"""Relational operators on a corpus: filters, joins, aggregates, windows, sets, samples."""
