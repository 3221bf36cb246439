"""Compositions of operators: settings, simulation, tuning, the whole pipeline."""
