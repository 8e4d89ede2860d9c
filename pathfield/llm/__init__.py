"""Operators for training-data pipelines. Nothing else in pathfield imports this subpackage."""
