"""Operators: cut points, bins, histograms, splits, routing."""
