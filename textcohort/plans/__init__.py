"""End-to-end compositions of the operators, and the registry of named queries."""
