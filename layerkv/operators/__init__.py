"""Operators on change logs: versions, lookups, layout of levels, amplification."""
