"""Registered queries: every operator over the given tables, with its SQL where SQL can say it."""
