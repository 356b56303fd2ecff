"""Operators of a training-data pipeline: scoring, near copies, archives, secrets, tokens.

Nothing else in the library imports this subpackage.
"""
