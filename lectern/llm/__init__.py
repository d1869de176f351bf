"""Operators for training-data pipelines: one module per operator, ``queries`` and ``oracle`` beside them."""
