"""Column expressions and scalar helpers shared by the operators."""
