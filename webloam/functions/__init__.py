"""Column functions: text rules, HTML tokens, fetch outcomes."""
