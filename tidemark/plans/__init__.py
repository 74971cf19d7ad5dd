"""Declarative specs compiled to expressions, and the registered queries."""
