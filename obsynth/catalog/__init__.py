"""Named queries over the given tables, each with an equivalent ANSI SQL text where SQL can express it."""
