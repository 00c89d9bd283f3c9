"""Readers of the data sets' files, and how vectors, predictions and results are kept."""
