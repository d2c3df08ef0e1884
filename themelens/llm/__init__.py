"""Operators of a training-data pipeline; ``QUERIES`` and ``ORACLES`` register them."""
