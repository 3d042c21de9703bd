"""Training-data operators: one module for each, their queries in ``queries``.

Nothing else in the library imports this package, so it can be removed as a whole.
"""
