"""Column functions and ranking operators."""
