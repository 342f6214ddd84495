"""Layout language: tokens, syntax tree, checks, schema inference and column plans."""
