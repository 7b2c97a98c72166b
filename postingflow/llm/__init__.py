"""Operators for preparing training data.

One module per operator, each with a general interface of its own; the
registered queries (``queries.py``) are thin bindings over the driver tables.
Nothing else in the library imports this subpackage.
"""
