"""Operators on readings: projection, levels, joins, detectors, reports' aggregates."""
