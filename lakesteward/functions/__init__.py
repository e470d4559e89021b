"""Column expressions. Each takes and returns a Column and stays inside code generation."""
