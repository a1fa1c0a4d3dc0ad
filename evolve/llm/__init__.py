"""Operators for preparing training text: thirteen numbered operators, one module
each, and their registered queries (``evolve.llm.queries``).

Nothing else in the library imports this subpackage.
"""
