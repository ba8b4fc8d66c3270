"""Operators for preparing training text: scans, search, joins, packing, scoring and tokenisation."""
