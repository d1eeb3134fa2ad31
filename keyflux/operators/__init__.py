"""Operators on keyed tables, samples and logs."""
