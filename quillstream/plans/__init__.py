"""Relational plans over the job log: registry, cache, limits and progress."""
