"""Operators of a training-data pipeline. Nothing else in loomfield imports this subpackage."""
