"""Column helpers, fixed values and small table helpers shared by the operators."""
