"""Graph operators: each takes a Graph or its tables and returns a DataFrame."""
