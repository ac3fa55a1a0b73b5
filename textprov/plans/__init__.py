"""Whole jobs: detection, training, evaluation recipes."""
