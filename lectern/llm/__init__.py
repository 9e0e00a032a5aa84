"""Training-data operators: one module for each operator, and their queries.

Nothing outside this package imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
