"""Iterative models: each sweep is one distributed pass; the driver holds what is as large as the axes."""
