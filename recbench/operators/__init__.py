"""Recommenders, metrics, statistics, vectorizers, graphs and geometry over DataFrames."""
