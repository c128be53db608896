"""Rule tables: fixed values the operators take as data."""
