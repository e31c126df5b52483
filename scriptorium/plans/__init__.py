"""End-to-end plans built from the operators, and the catalog of registered queries."""
