"""The SQL dialect: syntax tree, parser, and translation to columns."""
