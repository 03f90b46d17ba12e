"""End-to-end plans composed from the operators, and the query catalog."""
