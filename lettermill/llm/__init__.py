"""Training-data operators: one module each, all expressed over DataFrames.

Nothing outside this package imports it; ``queries`` binds the operators to the
tables they are meant for.
"""
