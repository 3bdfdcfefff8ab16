"""Operators of training-data preparation: ten operators on text tables, their queries and their SQL twins.

Nothing else in the library imports this package.
"""
