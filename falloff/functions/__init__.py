"""Column expressions: formulas, text rules, units."""
