"""Queries over the given tables and, where SQL can say the same, their SQL counterparts."""
