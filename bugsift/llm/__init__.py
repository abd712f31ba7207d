"""Operators for preparing training text for language models.

Nothing else in the library imports this subpackage; ``queries.py`` holds its
registered queries and their SQL.
"""
