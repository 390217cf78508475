"""Operators for preparing training data at scale.

Nothing outside this folder imports it. Each operator is a function from
DataFrame to DataFrame in a module of its own; ``queries.py`` binds them to the
tables and production parameters.
"""
