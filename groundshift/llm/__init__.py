"""Operators for training-data pipelines. Nothing outside this package and its tests imports it."""
