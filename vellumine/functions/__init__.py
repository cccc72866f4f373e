"""Column-level building blocks; everything here is a built-in Spark expression
unless its docstring says otherwise."""
