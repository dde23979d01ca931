"""Set expressions, parsed and planned."""
