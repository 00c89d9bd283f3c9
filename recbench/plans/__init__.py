"""Experiment grids and questions to their results."""
