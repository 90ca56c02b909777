"""Column expressions and column-role rules shared by the operators."""
