"""Tables, views over them, and JSON state."""
