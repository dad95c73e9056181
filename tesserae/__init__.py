"""Labelled-collection analytics on Spark: sources, features, balancing, classifiers, metrics, streaming."""
