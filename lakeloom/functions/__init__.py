"""Column expressions and type rules: typing, normalising and rendering of values.  No Python runs per row."""
