"""Column functions. Each takes and returns Columns, so batch and stream share them."""
