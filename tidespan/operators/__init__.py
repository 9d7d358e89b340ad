"""Operators over measurements: scans, writes, joins, statistics, life cycle, versions."""
