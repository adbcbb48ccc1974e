"""Registered queries: the operators applied to the supplied tables, with SQL checks."""
