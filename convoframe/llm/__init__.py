"""Operators of a training-data pipeline over documents, benchmark items, labels and conversations."""
