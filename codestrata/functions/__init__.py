"""Column-level helpers: text, state carrying, globs, token weights, rule tables."""
