"""Compositions of operators that answer one user question end to end."""
