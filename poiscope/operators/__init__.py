"""Table-to-table operators, one module per family."""
