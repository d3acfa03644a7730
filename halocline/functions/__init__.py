"""Column expressions: special functions, component profiles, units."""
