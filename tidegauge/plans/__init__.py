"""The SQL dialect, and looks at plans."""
