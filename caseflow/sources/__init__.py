"""Readers and writers: logs, process graphs, models."""
