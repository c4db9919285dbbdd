"""Column functions and regular expressions shared by the operators."""
