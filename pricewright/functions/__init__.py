"""Column functions: no session, no UDFs; each returns an expression for Catalyst."""
