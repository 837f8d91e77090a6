"""The expression language: text to syntax tree to a Spark column."""
