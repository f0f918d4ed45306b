"""Operators for training-data pipelines: ten corpus operators and their queries.

Nothing else in the library imports this subpackage.
"""
