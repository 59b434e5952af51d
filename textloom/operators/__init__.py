"""DataFrame to DataFrame operators, by theme."""
