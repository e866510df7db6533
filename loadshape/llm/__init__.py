"""Training-data operators: the numbered operators, their queries and helpers.

Nothing else in the library imports this subpackage.
"""
