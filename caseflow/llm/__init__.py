"""Operators of a training-data pipeline. Nothing else in caseflow imports this subpackage."""
