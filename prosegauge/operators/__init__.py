"""Text views and the rule families, as column expressions and tables."""
