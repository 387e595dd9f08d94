"""Charts of variants that are still arriving."""
