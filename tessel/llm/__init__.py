"""Training-data operators: one module for each, queries and SQL in ``registry``."""
