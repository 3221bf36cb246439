"""Analytical operators: functions from event logs (DataFrames) to DataFrames."""
