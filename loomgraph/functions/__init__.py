"""Column-level functions: ids, typing, tags, globs."""
