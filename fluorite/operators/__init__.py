"""Operators on stacks."""
