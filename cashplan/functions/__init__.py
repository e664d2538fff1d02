"""Column-level building blocks: text cells to typed values, calendar parts, recurring dates."""
