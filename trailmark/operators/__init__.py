"""Analyses of the ledger; DataFrames in, DataFrames out."""
