"""Operators on runs, windows, labels and scores; each takes and returns DataFrames."""
