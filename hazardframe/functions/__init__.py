"""Column-in, Column-out scalar rules."""
