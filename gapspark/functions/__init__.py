"""Column expressions: no UDFs, everything stays in generated code."""
