"""Operators of a training-data pipeline. Nothing else in tessera imports this subpackage."""
