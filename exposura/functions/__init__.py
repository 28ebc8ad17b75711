"""Column expressions and scale helpers shared by all operators."""
