"""Column builders: everything here takes and returns Columns."""
