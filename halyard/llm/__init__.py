"""Operators on text for training-data pipelines. Nothing else in halyard imports this subpackage."""
