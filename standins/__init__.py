"""Inputs derived from the supplied tables, the registered queries and their SQL twins."""
