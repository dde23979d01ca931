"""Content analytics over collections of objects, as DataFrame and SQL plans."""
