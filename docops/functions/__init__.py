"""Column functions: no DataFrame, no action, only built-in expressions."""
