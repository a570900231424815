"""Query plans composed of operators, and the query catalogue."""
