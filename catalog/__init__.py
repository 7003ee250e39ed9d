"""Registered queries, one module per operator family, each next to an independent SQL statement."""
