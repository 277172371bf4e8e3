"""Training-data operators: one module per operator, used by nothing outside this subpackage."""
