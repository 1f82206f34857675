"""Column functions; all stay within generated code."""
