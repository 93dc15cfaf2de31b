"""Compound plans: query builder, named questions, workflow traces."""
