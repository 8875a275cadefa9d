"""Operators for preparing training text: nothing else in the library imports this subpackage.

``queries.QUERIES`` and ``queries.ORACLES`` list the registered queries.
"""
