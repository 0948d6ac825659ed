"""Column-level functions (identity, text, numeric)."""
