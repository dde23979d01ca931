"""Event-time operators, batch and streaming."""
