"""Column builders: text, match offsets, dates and title comparison."""
