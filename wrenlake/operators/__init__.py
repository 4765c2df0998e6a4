"""Operators on DataFrames: segments, labels and folds, motifs, metrics, models."""
