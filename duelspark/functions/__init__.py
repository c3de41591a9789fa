"""Column functions: cleaning, typed parsing, scoring."""
