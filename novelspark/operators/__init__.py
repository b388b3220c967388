"""Distributed operators: joins, walks, sampling and stage tables."""
