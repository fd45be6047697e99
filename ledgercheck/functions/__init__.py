"""Column functions: text to value, value to text, keys and validity."""
