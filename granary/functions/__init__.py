"""Column functions: text, numbers, dates.  All are built-in expressions, no user functions."""
