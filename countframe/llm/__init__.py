"""Operators for training-data pipelines over document tables.

One module per operator (general interface, whole texts), one ``q_*`` query
per operator in ``catalog.py``.  Nothing outside this subpackage imports it.
"""
