"""Relational, diff, dependency and navigation operators over DataFrames."""
