"""Review operators: every one is a DataFrame to DataFrame function over all sets at once."""
