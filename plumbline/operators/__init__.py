"""The checks and what is derived from their results, each a lazy DataFrame."""
