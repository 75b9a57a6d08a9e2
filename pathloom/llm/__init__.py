"""Training-data operators.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries and SQL, and ``__spark_entry__`` adds them when it can be imported.
"""
